"""The driver tables as files(project, path, content): SQL that Spark and DuckDB both run.

Single quotes, braces and line feeds in the generated texts are spelled with chr(), since the
two dialects differ in literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.staging import stage

_NL = "chr(10)"
_DOC = "lpad(cast(doc_id as string), 7, '0')"

# Source texts with what the clean-up steps remove; one ignore file per project.
CODE = f"""
select source as project,
  'src/' || lang || '/d' || {_DOC} ||
  case doc_id % 8 when 0 then '.ts' when 1 then '.js' when 2 then '.py' when 3 then '.css'
       when 4 then '.html' when 5 then '.md' when 6 then '.min.js' else '.json' end as path,
  case
    when doc_id % 8 in (0, 1, 6) then
      case when doc_id % 16 = 0 then '/* License: open' || {_NL} || ' * all of it */' || {_NL} else '' end ||
      'import ' || chr(123) || ' d ' || chr(125) || ' from "./d' || lpad(cast(doc_id + 20 as string), 7, '0') || '";' || {_NL} ||
      'import "./side";' || {_NL} || 'const k = require("./k");' || {_NL} || text || '  ' || {_NL} || {_NL} || {_NL} || {_NL} ||
      '// note ' || cast(doc_id as string) || {_NL} || 'let u = "http://x.y/z"; // tail' || {_NL} ||
      '/* two' || {_NL} || 'lines */'
    when doc_id % 8 = 2 then '#!/usr/bin/env python' || {_NL} || text || {_NL} || {_NL} || {_NL} ||
      '# note ' || cast(doc_id as string) || {_NL} || 'x = 1  # tail' || {_NL}
    when doc_id % 8 = 3 then '/* css */' || {_NL} || text
    when doc_id % 8 = 4 then '<!-- one' || {_NL} || 'two -->' || {_NL} || text
    else text
  end as content
from documents
union all
select distinct source as project, '.gitignore' as path,
  '# rules' || {_NL} || '*.log' || {_NL} || 'src/*/d*[05].md' || {_NL} ||
  case when source like '%0' or source like '%2' or source like '%4' then '' else '!src/en/*.md' || {_NL} end ||
  '/src/es/' || {_NL} as content
from documents
"""

PAGES = """
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as project,
  'pages/p' || lpad(cast(page_id as string), 7, '0') || '.html' as path, html as content
from pages
"""

TALKS = """
select 'conv' as project,
  'c/' || lpad(cast(conv_id as string), 6, '0') || '/' || role || '/' || lpad(cast(turn as string), 3, '0') || '.md' as path,
  text as content
from conversations
"""


def _file(k: str) -> str:
    """Stem of file k of a graph project; files are spread over eight folders."""
    return f"'m' || cast(({k}) % 8 as string) || '/f' || lpad(cast({k} as string), 2, '0')"


_PROJECT = "'p' || lpad(cast(cast(floor(doc_id / 64) as bigint) as string), 6, '0')"

# 64 files per project that import each other, with cycles.
GRAPH = f"""
select project,
  'src/' || {_file('k')} || case when k % 5 = 3 then '/index.ts' when k % 5 = 4 then '.js' when k % 7 = 6 then '.tsx' else '.ts' end as path,
  'import ' || chr(123) || ' C, x as y ' || chr(125) || ' from "' || up || {_file('a')} || '";' || {_NL} ||
  'import type ' || chr(123) || ' T ' || chr(125) || ' from ' || chr(39) || up || {_file('b')} || chr(39) || ';' || {_NL} ||
  'import D from "@lib/f' || lpad(cast((k % 8) * 8 as string), 2, '0') || '";' || {_NL} ||
  'import "dep";' || {_NL} ||
  '// import z from "../m0/f00";' || {_NL} ||
  'const r = require("' || up || {_file('c')} || '");' || {_NL} ||
  'const q = import(' || chr(39) || up || {_file('e')} || chr(39) || ');' || {_NL} ||
  'export * from "../m1/f01";' || {_NL} ||
  '@Module(' || chr(123) || ' imports: [C, y], providers: [Loader, Missing] ' || chr(125) || ')' || {_NL} ||
  'export class Loader ' || chr(123) || {_NL} ||
  '  run() ' || chr(123) || {_NL} || '    return "' || chr(123) || '";' || {_NL} || '  ' || chr(125) || {_NL} ||
  '  stop() ' || chr(123) || ' return 1; ' || chr(125) || {_NL} || chr(125) || {_NL} ||
  'function helper() ' || chr(123) || {_NL} || '  return 2;' || {_NL} || chr(125) || {_NL} ||
  '/* ' || text || ' */' as content
from (
  select {_PROJECT} as project, doc_id % 64 as k, text,
    case when (doc_id % 64) % 5 = 3 then '../../' else '../' end as up,
    (2 * (doc_id % 64) + 1) % 64 as a, (2 * (doc_id % 64) + 2) % 64 as b,
    (doc_id % 64 + 7) % 64 as c, (5 * (doc_id % 64) + 3) % 64 as e
  from documents) numbered
"""

# One settings file of each kind per graph project: nestjs, react or neither by project number.
_PACKAGE = """chr(123) ||
  case cast(right(project, 1) as int) % 3
    when 0 then '"dependencies": ' || chr(123) || '"@nestjs/core": "^10.0.0"' || chr(125)
    when 1 then '"dependencies": ' || chr(123) || '"@nestjs/core": "1"' || chr(125) || ', "devDependencies": ' ||
         chr(123) || '"@nestjs/core": "", "react": "18"' || chr(125)
    else '"name": "plain"' end || chr(125)"""
_SETTINGS = """chr(123) || '"compilerOptions": ' || chr(123) || '"paths": ' || chr(123) ||
  '"@lib/*": ["src/m0/*"]' || chr(125) || chr(125) || chr(125)"""
for _path, _content in (("package.json", _PACKAGE), ("tsconfig.json", _SETTINGS),
                        ("node_modules/dep/index.ts", "'export default 1;'")):
    GRAPH += f"""union all
select project, '{_path}' as path, {_content} as content
from (select distinct {_PROJECT} as project from documents) projects
"""

ENTRY = "src/m0/f00.ts"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # The driver tables may be one small file each.
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(spark.sparkContext.defaultParallelism)


def files(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """The files table (project, path, content, size) of one adapter."""
    load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql).select(
        "project", "path", F.col("content").cast("binary").alias("content"),
        F.octet_length("content").cast("long").alias("size"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, CODE, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, PAGES, "pages")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, TALKS, "conversations")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged, as a files table is: the graph steps read a few of its columns several times."""
    return stage(files(spark, sf_dir, GRAPH, "documents"))
