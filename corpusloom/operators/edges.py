"""Import edges between the files of a project, found by expressions and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import base_name, extension_lower, fold_dots, parent_dir, prefixes, resolve_path
from corpusloom.functions.text import read_text
from corpusloom.operators.ordering import spread_join
from corpusloom.staging import stage

# File types that are searched for imports, and the order in which an
# extension-less import is tried.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
TRIED = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".json")
_JS_ENDS = (".js", ".jsx", ".mjs", ".cjs")
_TS_ENDS = (".ts", ".tsx", ".d.ts")

IMPORT, CALL, MODULE = 0, 1, 2
IN_NODE_MODULES = r"(^|/)node_modules/"

_COMMENT = r"(?://[^\n]*+|/\*(?s:.*?)\*/)"
# The same where nothing follows that could make it longer: runs without a star are taken in one go.
_BLOCK = r"/\*(?>[^*]*)(?:\*(?!/)(?>[^*]*))*+\*/"
_SKIPPED = r"(?://[^\n]*+|" + _BLOCK + ")"
_WORD = r"[\w$\s{},*\x{80}-\x{10FFFF}]"
_QUOTED = r"""(?:"[^"\n]*"|'[^'\n]*')"""
_TEMPLATE = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
# Names and signs, and comments between them: the loop turns once per comment.
_CLAUSE = r"(?:" + _WORD + r"*?" + _COMMENT + r")*?" + _WORD + r"*?"
# Left to right, a comment or a string hides what is inside it. A wrong guess about a
# quote costs at most the rest of its line. The look-ahead skips all other characters fast.
_LEXER = "(?=[/ir'\"`])(?:" + "|".join([
    _SKIPPED,
    _TEMPLATE,
    r"\bimport\s+[\w$]+\s*=\s*require\s*\(\s*" + _QUOTED,
    "(" + "|".join([
        r"\bimport(?<![.$]import)\s*\(\s*" + _QUOTED,
        r"\bimport(?<![.$]import)\b\s*(?:" + _CLAUSE + r"\bfrom\s*)?" + _QUOTED,
        r"\brequire(?<![.$]require)\s*\(\s*" + _QUOTED]) + ")",
    _QUOTED,
]) + ")"


def import_tokens(text: Column) -> Column:
    """Import statements and calls with a literal target, in text order."""
    # The group is empty for what is only skipped, so no comment is copied.
    return F.filter(F.regexp_extract_all(text, F.lit(_LEXER), F.lit(1)), lambda t: t != "")


def scripts(files: DataFrame) -> DataFrame:
    return files.where(extension_lower(F.col("path")).isin(*SCRIPT_EXTENSIONS))


def edges_raw(files: DataFrame) -> DataFrame:
    """(project, src, kind, ord, form, spec, type_only, clause) of every import in every script."""
    tokens = scripts(files).select(
        "project", F.col("path").alias("src"), import_tokens(read_text(F.col("content"))).alias("_found"))
    token = F.col("_token")
    # The target is the string at the end; a comment before it may hold anything.
    target = F.regexp_extract(token, _QUOTED + r"\z", 0)
    head = F.regexp_replace(F.substr(token, F.lit(1), F.length(token) - F.length(target)), _COMMENT, " ")
    clause = F.btrim(F.regexp_extract(head, r"(?s)\Aimport\b\s*(.*?)\s*\bfrom\s*\z", 1), F.lit(" \t\r\n"))
    form = (F.when(F.startswith(token, F.lit("require")), "require")
            .when(F.rlike(token, F.lit(r"\Aimport\s*\(")), "dynamic").otherwise("import"))
    # The outer form, or Spark would test the size of the list first and build it twice.
    listed = tokens.select("project", "src", F.posexplode_outer("_found").alias("_pos", "_token"))
    return listed.where("_token is not null").select(
        "project", "src",
        F.when(form == "import", IMPORT).otherwise(CALL).alias("kind"),
        F.col("_pos").cast("long").alias("ord"),
        form.alias("form"),
        F.substr(target, F.lit(2), F.length(target) - 2).alias("spec"),
        ((form == "import") & F.rlike(clause, F.lit(r"\Atype(?:\s+[\w${*]|\s*[{*])"))).alias("type_only"),
        F.when(form == "import", clause).otherwise("").alias("clause"),
    )


def module_keys(files: DataFrame) -> DataFrame:
    """(project, key, rank, dst): every name under which a file can be imported.

    A file has a handful of names, while an import has a dozen candidate files, so the
    names go on the file side and each import joins on one key.
    """
    path, end, stem = F.col("path"), F.col("_end"), F.col("_stem")
    suffix = r"[^/](\.d\.ts|" + "|".join(re.escape(e) for e in TRIED if e != ".d.ts") + r")\z"
    rank = F.array_position(F.lit(list(TRIED)), end).cast("int")

    def named(test: Column, key: Column, value: Column) -> Column:
        return F.when(test, F.struct(key.alias("key"), value.cast("int").alias("rank")))

    names = [
        named(F.lit(True), path, F.lit(5)),
        named(end != "", stem, 10 + rank),
        named(end == ".d.ts", F.concat(stem, F.lit(".d")), F.lit(11)),
        named((end != "") & (base_name(stem) == "index"), parent_dir(stem), 30 + rank),
        # An import of x.js may mean x.ts.
        *[named(end.isin(*_TS_ENDS), F.concat(stem, F.lit(js)), rank) for js in _JS_ENDS],
    ]
    known = files.where(extension_lower(path).isin(*SCRIPT_EXTENSIONS, ".json")).select(
        "project", "path", F.regexp_extract(path, suffix, 1).alias("_end"))
    return known.withColumn("_stem", F.substr(path, F.lit(1), F.length(path) - F.length(end))).select(
        "project", path.alias("dst"), F.inline_outer(F.array_compact(F.array(*names)))
    ).select("project", "key", "rank", "dst")


def _settings(files: DataFrame) -> DataFrame:
    """(project, path, base, paths, folder, parent) of every JSON file with compilerOptions: the folder of its
    baseUrl, its paths and its own folder, and the file it extends."""
    # Comments and trailing commas are allowed there; a string may well hold /* or //.
    bare = F.regexp_replace(read_text(F.col("content")), r'("[^"\n]*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")
    parsed = F.from_json(
        F.regexp_replace(bare, r",(\s*[}\]])", "$1"),
        "struct<extends: string, compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>")
    folder, options = parent_dir(F.col("path")), F.col("_o.compilerOptions")
    named = F.when(F.endswith("_o.extends", F.lit(".json")), F.col("_o.extends")).otherwise(F.concat("_o.extends", F.lit(".json")))
    return files.where(F.endswith("path", F.lit(".json")) & (
        (F.col("path") == "tsconfig.json") | F.contains("content", F.lit(bytearray(b"compilerOptions"))))).select(
        "project", "path", parsed.alias("_o")).select(
        "project", "path", resolve_path(options["baseUrl"], folder).alias("base"), options["paths"].alias("paths"),
        folder.alias("folder"), F.when(F.rlike("_o.extends", F.lit(r"\A(?:\.{1,2})?/")), resolve_path(named, folder)).alias("parent"))


def path_aliases(files: DataFrame) -> DataFrame:
    """(project, aliases) from compilerOptions.paths and baseUrl of the root tsconfig.json and the files of the
    project that it extends, the nearest first. Each round follows all projects one file further."""
    known = stage(_settings(files))
    found = known.where("path = 'tsconfig.json'").withColumn("trail", F.array("path"))
    while True:
        missing = F.col("parent").isNotNull() & (F.col("base").isNull() | F.col("paths").isNull())
        if found.where(missing).isEmpty():
            break
        above = known.select("project", F.col("path").alias("parent"), F.struct("base", "paths", "folder", "parent").alias("up"))
        joined = found.withColumn("parent", F.when(missing, F.col("parent"))).join(above, ["project", "parent"], "left")
        found = stage(joined.select(
            "project", "path", F.coalesce("base", "up.base").alias("base"),
            F.when(F.col("paths").isNull() & F.col("up.paths").isNotNull(), F.col("up.folder")).otherwise(F.col("folder")).alias("folder"),
            F.coalesce("paths", "up.paths").alias("paths"),
            # A file that comes a second time ends the chain.
            F.when(~F.array_contains("trail", F.col("up.parent")), F.col("up.parent")).alias("parent"),
            F.when(F.col("up.parent").isNotNull(), F.array_append("trail", F.col("up.parent"))).otherwise(F.col("trail")).alias("trail")))
    root = F.coalesce("base", "folder")

    def alias(key: Column, targets: Column) -> Column:
        starred = F.contains(key, F.lit("*"))
        return F.struct(
            F.substring_index(key, "*", 1).alias("head"),
            F.when(starred, F.substring_index(key, "*", -1)).otherwise("").alias("tail"),
            starred.alias("starred"),
            F.transform(targets, lambda t: F.when(root == "", t).otherwise(F.concat_ws("/", root, t))).alias("targets"))

    listed = F.transform(
        F.map_entries(F.coalesce("paths", F.create_map().cast("map<string,array<string>>"))),
        lambda e: alias(e["key"], e["value"]))
    anywhere = F.array(alias(F.lit("*"), F.array(F.lit("*"))))
    return found.select("project", F.when(F.col("base").isNotNull(), F.concat(listed, anywhere)).otherwise(listed).alias("_aliases"))


def _step(kind, within, turn) -> Column:
    """Rank of a place to look: relative paths, exact aliases, patterns, packages; then by the two numbers."""
    parts = [(p if isinstance(p, Column) else F.lit(p)).cast("int") for p in (kind, within, turn)]
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("kind", "within", "turn"))))


def candidates(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw plus one row per (step, key) to look up; lower steps win."""
    spec = F.col("spec")
    relative = F.rlike(spec, F.lit(r"\A\.{1,2}(?:/|\z)|\A/"))
    near = F.array(F.struct(_step(0, 0, 0).alias("step"), resolve_path(spec, F.col("_dir")).alias("key")))

    def fits(a: Column) -> Column:
        return F.when(a["starred"], F.startswith(spec, a["head"]) & F.endswith(spec, a["tail"])
                      & (F.length(spec) >= F.length(a["head"]) + F.length(a["tail"]))).otherwise(spec == a["head"])

    def places(a: Column) -> Column:
        star = F.substr(spec, F.length(a["head"]) + 1, F.length(spec) - F.length(a["head"]) - F.length(a["tail"]))
        # An exact alias comes before patterns, a longer prefix before a shorter one.
        kind, shorter = F.when(a["starred"], 2).otherwise(1), F.when(a["starred"], -F.length(a["head"])).otherwise(0)
        return F.transform(a["targets"], lambda t, i: F.struct(
            _step(kind, shorter, i).alias("step"), fold_dots(F.replace(t, F.lit("*"), star)).alias("key")))

    by_alias = F.coalesce(F.flatten(F.transform(F.filter("_aliases", fits), places)),
                          F.array().cast("array<struct<step: struct<kind: int, within: int, turn: int>, key: string>>"))
    # Packages: node_modules of the nearest folder first.
    above = F.reverse(F.concat(F.array(F.lit("")), F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(
        F.transform(prefixes(F.col("_dir")), lambda p: F.concat(p, F.lit("/"))))))
    packaged = F.transform(above, lambda d, i: F.struct(
        _step(3, 0, i).alias("step"), F.concat(d, F.lit("node_modules/"), spec).alias("key")))
    placed = spread_join(raw.withColumn("_dir", parent_dir(F.col("src"))), path_aliases(files), ["project"], "left", "src")
    return placed.where(spec != "").select(
        *raw.columns, F.inline_outer(F.when(relative, near).otherwise(F.concat(by_alias, packaged))))


def resolve(raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw plus dst, the imported file of the same project; unresolved imports are dropped."""
    at = ["project", "src", "kind", "ord"]
    rest = [c for c in raw.columns if c not in at]
    hits = candidates(raw, files).join(module_keys(files), ["project", "key"])
    best = F.min(F.struct("step", "rank", "dst", *rest)).alias("_best")
    return hits.groupBy(*at).agg(best).select(
        *at, *[F.col(f"_best.{c}").alias(c) for c in [*rest, "dst"]])


def import_edges(resolved: DataFrame) -> DataFrame:
    label = (F.when(F.col("form") == "require", "Required by ")
             .when(F.col("form") == "dynamic", "Dynamic imported by ").otherwise("Imported by "))
    return resolved.select(
        "project", "src", "dst", "kind", "ord", "spec", "type_only",
        F.concat(label, "src", F.lit(' ("'), "spec", F.lit('")')).alias("reason"))


def detect_framework(files: DataFrame) -> DataFrame:
    """(project, framework) for every project, from the root package.json."""
    parsed = F.from_json(
        read_text(F.col("content")),
        "struct<dependencies: map<string,string>, devDependencies: map<string,string>>")

    def wanted(name: str) -> Column:
        # devDependencies win; an empty version counts as missing.
        version = F.coalesce(F.try_element_at(F.col("_p.devDependencies"), F.lit(name)),
                             F.try_element_at(F.col("_p.dependencies"), F.lit(name)))
        return F.coalesce(version != "", F.lit(False))

    probed = files.where("path = 'package.json'").select("project", parsed.alias("_p")).select(
        "project",
        F.when(wanted("@nestjs/core") | wanted("@nestjs/common"), "nestjs")
        .when(wanted("react") | wanted("next"), "react").otherwise("generic").alias("framework"))
    return files.select("project").distinct().join(probed, "project", "left").fillna({"framework": "generic"})


_MODULE_PROPS = ("imports", "controllers", "providers", "exports")
_MODULE_TOKENS = "|".join([_COMMENT, _QUOTED, _TEMPLATE, r"@Module\s*+\(", r"[\w$.]+", r"[()\[\]{}:,]"])


def _module_calls(levels: int) -> str:
    """Each @Module(...) that no comment or string hides, with brackets of so many levels in it; one with more, or
    without an end, goes to the end of the text. Every match takes what lies before it, so none starts at each character."""
    hiding = [_SKIPPED, _QUOTED, _TEMPLATE]
    plain = "|".join([r"""[^()\[\]{}/"'`@]++""", *hiding, r"@Module\s*+\(", r"""[/"'`@]"""])
    inside = f"(?:{plain})*+"
    for _ in range(levels):
        inside = rf"(?:{plain}|[(\[{{]{inside}[)\]}}])*+"
    call = rf"(@Module\s*+\((?:{inside}[)\]}}]|(?s:.*)))"
    return r"""(?>[^/"'`@]*)(?:""" + "|".join([*hiding, call, r"""[/"'`@]""", r"\z"]) + ")"


_MODULE_CALLS = _module_calls(6)


def module_calls(text: Column) -> Column:
    """The texts of all @Module(...) calls, in text order."""
    return F.filter(F.regexp_extract_all(text, F.lit(_MODULE_CALLS), F.lit(1)), lambda c: c != "")


def module_names(text: Column) -> Column:
    """array<struct<prop, ident>>: the identifiers listed in the arrays of every @Module({...}), in text order.

    One pass over the tokens of the calls alone that keeps the depth of open brackets: the call is 1, its object 2, an
    array 3. What is nested deeper, as the options of T.forRoot({...}), belongs to its element,
    which then is no identifier.
    """
    def tokens(call: Column) -> Column:
        return F.filter(F.regexp_extract_all(call, F.lit(_MODULE_TOKENS), F.lit(0)),
                        lambda t: ~F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("/*")))

    nothing = F.array().cast("array<struct<prop: string, ident: string>>")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("key"), F.lit("").alias("prop"), F.lit("").alias("item"),
                     nothing.alias("found"))

    # Kinds of tokens apart, since a lambda works out all that a branch holds, and what it holds twice it works out twice.
    def state(depth: Column, found: Column, key=F.lit(""), prop=F.lit(""), item=F.lit("")) -> Column:
        return F.struct(depth.alias("depth"), key.alias("key"), prop.alias("prop"), item.alias("item"), found.alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth, key, prop, item, found = (s[c] for c in ("depth", "key", "prop", "item", "found"))
        named = F.rlike(item, F.lit(r"\A *[A-Za-z_$][\w$]* *\z"))
        more = F.concat(found, F.array(F.struct(prop.alias("prop"), F.btrim(item).alias("ident"))))
        longer = F.concat(item, F.lit(" "), t)
        deeper = F.when(F.contains(F.lit("([{"), t), depth + 1).otherwise(depth - 1)
        listed = (depth == 3) & (prop != "")
        bracket = state(
            deeper, F.when(listed & (t == "]") & named, more).otherwise(found), F.when(depth == 2, t).otherwise(""),
            F.when((depth == 2) & (t == "[") & key.isin(*(p + ":" for p in _MODULE_PROPS)), F.rtrim(key, F.lit(":")))
            .when(deeper < 3, "").otherwise(prop),
            F.when((depth < 3) | (listed & (t == "]")), "").when(listed, longer).otherwise(item))
        return (F.when(depth == 0, state(F.startswith(t, F.lit("@Module")).cast("int"), found))
                .when(F.contains(F.lit("()[]{}"), t), bracket)
                .when(listed & (t == ","), state(depth, F.when(named, more).otherwise(found), prop=prop))
                .when(listed, state(depth, found, prop=prop, item=longer))
                .when(depth == 2, state(depth, found, F.when(t == ":", F.concat(key, t)).otherwise(t)))
                .otherwise(s))

    return F.flatten(F.transform(module_calls(text), lambda c: F.aggregate(tokens(c), start, step, lambda s: s["found"])))


def module_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from the arrays of @Module({...}) in nestjs projects: an identifier leads to the
    file it is imported from, or to its own file if it is declared there. Texts are read where they lie."""
    nest = detect_framework(files).where("framework = 'nestjs'").select("project")
    body = read_text(F.col("content"))
    # What is tested at every character is a literal or a set; the look-behind and the word border come after it.
    bare = F.regexp_replace(F.regexp_replace(body, _BLOCK, ""), r"//(?<!://)[^\n]*", "")
    declared = F.regexp_extract_all(bare, F.lit(r"(?=[cflv])\b(?:class|function|const|let|var)\s+([\w$]+)"), F.lit(1))
    # As variables of a lambda both lists are found once a file. A column beside the exploded one would be worked out for every name.
    per_file = F.transform(F.array(F.struct(module_names(body).alias("names"), declared.alias("declared"))), lambda f: F.transform(
        f["names"], lambda n, i: F.struct(i.cast("long").alias("ord"), n["prop"].alias("prop"), n["ident"].alias("ident"),
                                          F.array_contains(f["declared"], n["ident"]).alias("_own"))))
    listed = scripts(files).where(F.contains(F.col("content"), F.lit(bytearray(b"@Module")))).select(
        "project", F.col("path").alias("src"), F.inline_outer(F.flatten(per_file))).where("ident is not null")
    names = spread_join(listed, nest, ["project"], "inner", "src")
    bindings = import_bindings(resolved).groupBy("project", "src", "ident").agg(
        F.min(F.struct("ord", "dst"))["dst"].alias("dst"))
    # Both sides are spread by file, so this join has no hot key. Names repeat and are small as a file, but not on the driver.
    joined = names.join(bindings.hint("merge"), ["project", "src", "ident"], "left")
    dst = F.coalesce("dst", F.when(F.col("_own"), F.col("src")))
    return joined.select(
        "project", "src", dst.alias("dst"), F.lit(MODULE).alias("kind"), "ord", F.col("ident").alias("spec"),
        F.lit(False).alias("type_only"),
        F.concat(F.lit("NestJS @Module "), "prop", F.lit(" in "), "src", F.lit(" ("), "ident", F.lit(")"))
        .alias("reason")).where("dst is not null")


def import_bindings(resolved: DataFrame) -> DataFrame:
    """(project, src, ord, ident, dst): the local names of import statements."""
    names = F.split(F.regexp_replace(F.regexp_replace("clause", r"\Atype\s+", ""), r"[{}]", ","), ",")
    local = F.regexp_replace(F.btrim("_name", F.lit(" \t\r\n")), r"(?s)\A.*\sas\s+|\Atype\s+", "")
    return resolved.where("form = 'import' and clause <> ''").select(
        "project", "src", "ord", "dst", F.explode(names).alias("_name")).select(
        "project", "src", "ord", local.alias("ident"), "dst").where(F.rlike("ident", F.lit(r"\A[\w$]+\z")))


def keep_edges(edges: DataFrame, include_types: bool = True, include_node_modules: bool = False) -> DataFrame:
    if not include_types:
        edges = edges.where(~F.col("type_only"))
    if not include_node_modules:
        edges = edges.where(~F.rlike("dst", F.lit(IN_NODE_MODULES)))
    return edges


def all_edges(files: DataFrame) -> DataFrame:
    """Import, call and module edges of all projects."""
    resolved = stage(resolve(edges_raw(files), files))
    return import_edges(resolved).unionByName(module_edges(resolved, files))
