"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import closure, edges, groups, manifest, pack, select, slices, tree
from corpusloom.operators.ordering import numbered, path_order
from corpusloom.plans import export as plan
from corpusloom.sources.files import ingest as ingest_trees, opened
from corpusloom.spec import (Budget, DependencyScan, ExportSpec, Filters, FolderScan, Format, FullScan, Output,
                             PatternScan)
from corpusloom.staging import shared_dir, stage
from workload import adapters

STAMP = datetime(2024, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
BUDGET = 3000

WEB = FolderScan("web", paths=("src/en", "src/fr"), extensions=(".ts", ".js", ".css"))
DOCS = PatternScan("docs", patterns=("**/*.{md,json}",))
REST = FullScan("rest")
SPEC = ExportSpec(
    strategies=(WEB, DOCS, REST),
    output=Output(file_name="corpus-{timestamp}.txt"),
    format=Format(strip_comments=True, strip_imports=True),
    budget=Budget(max_tokens=BUDGET),
    export_ts=STAMP,
)
FOLDER_SPEC = replace(SPEC, output=replace(SPEC.output, mode="multi", group_by="folder"), strategies=(FullScan("talks"),))
DEPTH = 3
FEATURE = DependencyScan("feature", entry=adapters.ENTRY, depth=DEPTH)
PLAIN = Filters(exclude=(), respect_gitignore=False, binary_detection=False)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a final underscore avoids the name of a module."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def _digest(df: DataFrame, changed) -> DataFrame:
    return df.select("project", "path", F.md5(changed.cast("binary")).alias("digest"),
                     F.length(changed).alias("chars"))


def _texts(files: DataFrame) -> DataFrame:
    return files.withColumn("body", text.read_text(F.col("content")))


def _refs(df: DataFrame) -> DataFrame:
    return df.select("project", "path", "strategy", "reason")


# --- scans ---------------------------------------------------------------------------------

@query
def scan_full(spark, sf_dir):
    return _refs(select.scan_refs(adapters.code(spark, sf_dir), 0, FullScan("everything"), Filters()))


@query
def scan_folder(spark, sf_dir):
    return _refs(select.scan_refs(adapters.code(spark, sf_dir), 0, WEB, Filters()))


@query
def scan_folder_file(spark, sf_dir):
    """A target that is a file is taken as it is, although the excludes name it."""
    scan = FolderScan("one", paths=(".gitignore", "src/en"), extensions=(".ts",), exclude=(".gitignore",))
    return _refs(select.scan_refs(adapters.code(spark, sf_dir), 0, scan, Filters()))


@query
def scan_pattern(spark, sf_dir):
    scan = PatternScan("docs", patterns=("src/**/*.{md,json}", ".git*", "!src/fr/**"), exclude=("*5.md",))
    return _refs(select.scan_refs(adapters.code(spark, sf_dir), 0, scan, Filters()))


def _graph(spark, sf_dir, **options) -> tuple[DataFrame, DataFrame]:
    files = adapters.graph(spark, sf_dir)
    return files, closure.stage_edges(edges.keep_edges(edges.all_edges(files), **options))


@query
def scan_dependency(spark, sf_dir):
    files, graph = _graph(spark, sf_dir)
    found = closure.dependency_scan(files, FEATURE.name, FEATURE.entry, graph, FEATURE.depth)
    refs = select.scan_refs(files, 0, FEATURE, PLAIN, {0: found})
    return refs.select("project", "path", "strategy", "reason", "topo_pos")


MANY = (("all", DependencyScan("all", "./" + adapters.ENTRY, depth=DEPTH)),
        ("values", DependencyScan("values", "src/m1/f01.ts", depth=1, include_types=False)),
        ("packages", DependencyScan("packages", "src/x/../m2/f02.ts", depth=2, include_node_modules=True)))


@query
def scan_dependency_many(spark, sf_dir):
    """Three entries with their own depths and kinds of edges in one chain of joins."""
    files = adapters.graph(spark, sf_dir)
    return closure.dependency_scans(files, MANY, closure.stage_edges(edges.all_edges(files))).select(
        "project", "strategy", "path", "depth", "reason")


@query
def read_text(spark, sf_dir):
    """Every text after a byte that is not UTF-8."""
    broken = F.concat(F.unhex(F.lit("FF")), F.col("content"))
    files = adapters.code(spark, sf_dir).withColumn("content", broken)
    return _digest(files, text.read_text(F.col("content")))


@query
def read_latin1(spark, sf_dir):
    return _digest(adapters.code(spark, sf_dir), text.read_text(F.col("content"), "latin1"))


@query
def read_ascii(spark, sf_dir):
    return _digest(adapters.code(spark, sf_dir), text.read_text(F.col("content"), "ascii"))


@query
def read_utf16(spark, sf_dir):
    """Every text in UTF-16 between half a pair and a whole one, with half a unit at its end."""
    units = F.encode(F.col("content").cast("string"), "UTF-16LE")
    files = adapters.code(spark, sf_dir).withColumn(
        "content", F.concat(F.unhex(F.lit("00D8")), units, F.unhex(F.lit("3DD800DE00DC41"))))
    return _digest(files, text.read_text(F.col("content"), "utf-16le"))


@query
def detect_framework(spark, sf_dir):
    return edges.detect_framework(adapters.graph(spark, sf_dir))


@query
def ingest(spark, sf_dir):
    """Write the corpus as real project trees in the shared folder, then list and read them."""
    root = f"{shared_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"

    def write(batches):
        system, base = opened(root)
        for batch in batches:
            for project, path, content in zip(batch["project"], batch["path"], batch["content"]):
                target = f"{base}/{project}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as f:
                    f.write(content)
            yield batch[["project", "path"]]

    written = adapters.code(spark, sf_dir).mapInPandas(write, "project string, path string")
    projects = stage(written).select("project").distinct()
    read = ingest_trees(spark, root, projects)
    return read.select("project", "path", "size", F.md5("content").alias("digest"))


# --- filters -------------------------------------------------------------------------------

@query
def select_strategies(spark, sf_dir):
    """Only the strategies asked for, in config order; the unknown name changes nothing."""
    scans = SPEC.selected(["rest", "docs", "unknown"])
    chosen = select.collect_files(adapters.code(spark, sf_dir), scans, SPEC.filters)
    return chosen.select("project", "path", "strategy", "strategy_idx", "reason")


@query
def filter_exclude(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    whole = select.globs.excluded(F.col("path"), ["fr", "**/*.min.*", "src/*/d*7.json"])
    below = select.globs.excluded(F.col("path"), ["src/en/*5.ts", "d*7.json", "en", "src/de/**"], "src/en")
    return files.select("project", "path", whole.alias("excluded"),
                        (F.startswith("path", F.lit("src/en/")) & below).alias("excluded_below"))


@query
def filter_gitignore(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    return select.with_ignored(files).select("project", "path", F.col("_ignored").alias("ignored"))


@query
def filter_extension(spark, sf_dir):
    """The list is not lower-cased, so '.PY' matches nothing."""
    files = adapters.code(spark, sf_dir)
    return files.where(select.extension_in(F.col("path"), (".ts", ".js", ".PY"))).select("project", "path")


@query
def filter_binary(spark, sf_dir):
    """Every text with a NUL put at its end: it counts only within the first 8192 bytes."""
    files = adapters.code(spark, sf_dir).withColumn(
        "content", F.concat("content", F.unhex(F.lit("00"))))
    return files.select("project", "path", select.is_binary(F.col("content")).alias("is_binary"))


@query
def filter_size(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    return files.where(select.size_within(F.col("size"), 2)).select("project", "path", "size")


@query
def filter_depth(spark, sf_dir):
    """Every file under c and none to four folders, by the size of its text."""
    name = paths.base_name(F.col("path"))
    files = adapters.code(spark, sf_dir).withColumn(
        "path", F.concat(F.lit("c/"), F.repeat(F.lit("d/"), F.pmod(F.col("size"), F.lit(5)).cast("int")), name))
    within = lambda **limit: select.folder_target(FolderScan("x", paths=("./c/",), **limit), PLAIN).isNotNull()
    return files.select("project", "path", within(max_depth=3).alias("within_3"), within(max_depth=2).alias("within_2"),
                        within(recursive=False).alias("direct"))


# --- projections ---------------------------------------------------------------------------

@query
def norm_path(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    return files.select("project", "path", paths.norm_path(F.replace("path", F.lit("/"), F.lit("\\"))).alias("normal"))


@query
def resolve_path(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    base = paths.parent_dir(F.col("path"))
    name = paths.base_name(F.col("path"))
    return files.select(
        "project", "path",
        paths.resolve_path(F.concat(F.lit("./x/../"), name), base).alias("same"),
        paths.resolve_path(F.concat(F.lit("../../"), name), base).alias("up"),
        paths.resolve_path(F.concat(F.lit("/lib/./"), name), base).alias("rooted"))


@query
def ext(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    return files.select("project", "path", paths.extension(F.col("path")).alias("ext"))


@query
def language(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    return files.select("project", "path", text.language(F.col("path")).alias("language"))


@query
def wrap(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    reason = F.when(F.col("project") == "src0", F.lit("")).otherwise("because")
    return _digest(files, text.wrap(F.col("body"), F.col("path"), reason, "<<{path}|{path}>>", "<</{path}>>"))


@query
def group_key(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    refs = select.collect_files(files, SPEC.selected(), SPEC.filters)
    return refs.select(
        "project", "path", groups.group_key("reason").alias("by_reason"), groups.group_key("strategy").alias("by_strategy"),
        groups.group_key("folder").alias("by_folder"), groups.group_key("custom").alias("by_custom"),
        groups.safe_name(groups.group_key("reason")).alias("safe"))


# --- text ----------------------------------------------------------------------------------

@query
def strip_c(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files, text.strip_c_comments(F.col("body")))


@query
def strip_hash(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files, text.strip_hash_comments(F.col("body")))


@query
def strip_html(spark, sf_dir):
    files = _texts(adapters.pages(spark, sf_dir))
    return _digest(files, text.strip_html_comments(F.col("body")))


@query
def license_header(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return files.select("project", "path", text.license_header(F.col("body")).alias("header"))


@query
def strip_imports(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files, text.strip_import_lines(F.col("body")))


@query
def collapse_blank(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files, text.collapse_blank(F.col("body")))


@query
def trim_lines(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files, text.trim_lines(F.concat(F.lit("\ufeff \n"), F.col("body"), F.lit(" \t\n"))))


@query
def line_numbers(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    return _digest(files.withColumn("lines", F.split("body", "\n", -1)), text.line_numbers(F.col("lines")))


@query
def tokens(spark, sf_dir):
    files = _texts(adapters.code(spark, sf_dir))
    wide = F.concat(F.col("body"), F.lit("\U0001F600"))
    return files.select("project", "path", text.tokens(F.col("body")).alias("tokens"),
                        text.tokens(wide).alias("tokens_wide"), text.tokens(F.lit("")).alias("tokens_empty"))


@query
def sizes(spark, sf_dir):
    m = plan.collect(adapters.code(spark, sf_dir), SPEC)
    return m.select("project", "path", "language", "original_size", "processed_size", "tokens",
                    F.md5("content").alias("digest"))


# --- order, sets, aggregation --------------------------------------------------------------

@query
def sort_paths(spark, sf_dir):
    """Names that end in s in capitals: by bytes these would come first."""
    path = F.when(F.endswith("path", F.lit("s")), F.upper("path")).otherwise(F.col("path"))
    files = adapters.code(spark, sf_dir).select("project", path.alias("path"))
    return numbered(files, ["project"], path_order(), "pos")


@query
def dedup_first(spark, sf_dir):
    """The strategies one by one, united; then the first strategy of each path stays."""
    files = adapters.code(spark, sf_dir)
    parts = [select.scan_refs(files, i, scan, SPEC.filters) for i, scan in SPEC.selected()]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return select.first_wins(united).select("project", "path", "strategy_idx", "reason")


@query
def output_order(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    refs = select.collect_files(files, SPEC.selected(), SPEC.filters).select(
        "project", "path", "strategy_idx", "topo_pos")
    return numbered(refs, ["project"], plan.output_order()).select("project", "path", "ord")


@query
def export_totals(spark, sf_dir):
    files = adapters.code(spark, sf_dir)
    texts = plan.collect(files, SPEC).select("project", "tokens", "processed_size")
    sums = manifest.totals(texts, ["project"])
    return files.select("project").distinct().join(sums, "project", "left").fillna(0)


@query
def pack_parts(spark, sf_dir):
    """Raw texts packed into parts, without a preamble."""
    files = _texts(adapters.code(spark, sf_dir)).select(
        "project", "path", text.tokens(text.wrap(F.col("body"), F.col("path"), F.lit(""), SPEC.format.header,
                                                 SPEC.format.footer)).alias("tokens"))
    return pack.pack_parts(stage(files), BUDGET, path_order())


@query
def part_names(spark, sf_dir):
    """Part and file name of every file of the split export."""
    m = plan.measure(adapters.code(spark, sf_dir), SPEC)
    heads = plan._heads(m.ordered, ["project"], F.col("project"), m.projects)
    placed = plan.split_parts(m, SPEC, plan.preamble_rows(m.ordered, ["project"], heads, SPEC))
    return placed.select("project", "path", "ord", "part", pack.part_file_name(
        SPEC.output.file_name, SPEC.iso_ts, F.col("part")).alias("file_name"))


@query
def tree_(spark, sf_dir):
    return tree.tree_lines(adapters.talks(spark, sf_dir), ["project"])


@query
def manifest_(spark, sf_dir):
    m = plan.measure(adapters.code(spark, sf_dir), SPEC)
    heads = plan._heads(m.ordered, ["project"], F.col("project"), m.projects)
    return manifest.manifest_rows(m.ordered, ["project"], heads, SPEC.iso_ts, [s.name for s in SPEC.strategies])


# --- sinks ---------------------------------------------------------------------------------

def _out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("step", F.array_join("step", "/"))


@query
def export_single(spark, sf_dir):
    spec = replace(SPEC, budget=Budget(enabled=False))
    return _out(plan.export_rows(adapters.code(spark, sf_dir), spec))


@query
def export_split(spark, sf_dir):
    return _out(plan.export_rows(adapters.code(spark, sf_dir), SPEC))


@query
def export_multi(spark, sf_dir):
    spec = replace(SPEC, output=replace(SPEC.output, mode="multi", group_by="reason"))
    return _out(plan.export_rows(adapters.code(spark, sf_dir), spec))


@query
def export_multi_folder(spark, sf_dir):
    return _out(plan.export_rows(adapters.talks(spark, sf_dir), FOLDER_SPEC))


@query
def preview(spark, sf_dir):
    return _out(plan.preview_rows(adapters.code(spark, sf_dir), SPEC))


# --- graph ---------------------------------------------------------------------------------

@query
def edges_raw(spark, sf_dir):
    found = edges.edges_raw(adapters.graph(spark, sf_dir))
    return found.select("project", "src", "kind", "ord", "form", "spec", "type_only")


@query
def edges_(spark, sf_dir):
    files = adapters.graph(spark, sf_dir)
    found = edges.keep_edges(edges.import_edges(edges.resolve(edges.edges_raw(files), files)), include_node_modules=True)
    return found.select("project", "src", "dst", "kind", "ord", "reason")


@query
def edges_no_types(spark, sf_dir):
    files = adapters.graph(spark, sf_dir)
    found = edges.keep_edges(edges.import_edges(edges.resolve(edges.edges_raw(files), files)), include_types=False)
    return found.select("project", "src", "dst", "kind", "ord", "reason")


@query
def edges_modules(spark, sf_dir):
    files = adapters.graph(spark, sf_dir)
    found = edges.module_edges(stage(edges.resolve(edges.edges_raw(files), files)), files)
    return found.select("project", "src", "dst", "spec", "reason")


@query
def closure_bfs(spark, sf_dir):
    files, graph = _graph(spark, sf_dir)
    entries = files.where(F.col("path") == adapters.ENTRY).select(
        "project", F.lit("feature").alias("strategy"), F.col("path").alias("entry"))
    return closure.bounded_closure(stage(entries), graph, DEPTH).drop("limits")


@query
def topo_order(spark, sf_dir):
    files, graph = _graph(spark, sf_dir)
    return closure.dependency_scan(files, "feature", adapters.ENTRY, graph, DEPTH).select(
        "project", "strategy", "path", "topo_pos")


@query
def topo_order_joins(spark, sf_dir):
    """The same order by joins alone, the way of closures too large for one task."""
    files, graph = _graph(spark, sf_dir)
    entries = stage(files.where(F.col("path") == adapters.ENTRY).select(
        "project", F.lit("feature").alias("strategy"), F.col("path").alias("entry")))
    reached = stage(closure.bounded_closure(entries, graph, DEPTH))
    return closure.topo_order_by_joins(entries, stage(closure.closure_edges(reached, graph)), reached)


@query
def slice_lines(spark, sf_dir):
    """Lines 3 to 5, 5 to 7 and 20 to 22 of every text, with markers for the gaps."""
    files = _texts(adapters.code(spark, sf_dir))
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((19, 21), (2, 4), (4, 6))])
    return _digest(files.withColumn("lines", F.split("body", "\n", -1)), slices.slice_lines(F.col("lines"), ranges))


@query
def slice_symbols(spark, sf_dir):
    files = edges.scripts(adapters.graph(spark, sf_dir))
    cut = slices.slice_symbols(files, ("Loader.run", "helper"))
    return cut.select("project", "path", "sliced")
