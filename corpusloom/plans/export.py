"""The whole job: select, clean, measure, then write parts or groups with manifest and tree."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import clean_root
from corpusloom.functions.text import tokens_of_length, utf16_length
from corpusloom.operators import closure, edges, groups, manifest, pack, tree
from corpusloom.operators.ordering import in_chunks, path_order, positions, spread_join
from corpusloom.operators.process import process
from corpusloom.operators.select import collect_files, size_within
from corpusloom.operators.slices import slice_symbols
from corpusloom.plans.sinks import in_blocks, place, with_texts, write_placed, write_rows
from corpusloom.spec import DependencyScan, ExportSpec
from corpusloom.staging import stage, staged_tables

MANIFEST, TREE, FILE = 0, 1, 2


def output_order():
    """Strategy by strategy; a dependency scan by its walk, the others by path."""
    return [F.col("strategy_idx"), F.col("topo_pos"), *path_order()]


def collect(files: DataFrame, spec: ExportSpec, names=None) -> DataFrame:
    """Wrapped and measured texts of the selected files, not yet in order."""
    scans = spec.selected(names)
    dependent = [(i, s) for i, s in scans if isinstance(s, DependencyScan)]
    closures = {}
    if dependent:
        found = stage(closure.dependency_scans(files, dependent, closure.stage_edges(edges.all_edges(files))))
        closures = {i: found.where(F.col("strategy") == str(i)) for i, _ in dependent}
    chosen = collect_files(files, scans, spec.filters, closures)
    for i, scan in dependent:
        if scan.symbols:
            entry = files.where((F.col("path") == F.lit(clean_root(scan.entry))) & size_within(F.col("size"), spec.format.max_file_kb))
            cut = stage(slice_symbols(entry, scan.symbols))
            chosen = chosen.join(cut.select("project", "path", F.lit(i).alias("strategy_idx"),
                                            F.col("sliced").alias("_cut")),
                                 ["project", "path", "strategy_idx"], "left")
            earlier = F.col("sliced") if "sliced" in chosen.columns else F.lit(None).cast("string")
            chosen = chosen.withColumn("sliced", F.coalesce("_cut", earlier)).drop("_cut")
    return process(chosen, spec.format)


@dataclass
class Measured:
    """Staged texts with their numbers _at, and their narrow ordered rows (with _chunk and _seq) that all later steps work on."""

    texts: DataFrame
    ordered: DataFrame
    projects: DataFrame


def measure(files: DataFrame, spec: ExportSpec, names=None) -> Measured:
    texts = in_blocks(collect(files, spec, names))
    narrow = texts.select("_at", "project", "path", "strategy", "strategy_idx", "topo_pos", "reason",
                          "original_size", "processed_size", "tokens")
    chunks = in_chunks(narrow, ["project"], output_order())
    return Measured(texts, stage(positions(chunks, ["project"])), files.select("project").distinct())


def _heads(files: DataFrame, keys: list[str], title, projects: DataFrame | None = None) -> DataFrame:
    """One row per manifest: title and totals, also for projects that selected nothing."""
    sums = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("tokens").alias("total_tokens"),
        F.max("ord").alias("last_ord"))
    if projects is not None:
        sums = projects.join(sums, keys, "left").fillna(0)
    return sums.withColumn("title", title)


def preamble_rows(files: DataFrame, keys: list[str], heads: DataFrame, spec: ExportSpec) -> DataFrame:
    """(keys, section, seq, step, text): the lines of manifest and tree, in blocks per entry."""
    no_step = F.array().cast("array<string>")
    rows = None
    if spec.output.manifest:
        rows = manifest.manifest_rows(
            files, keys, heads, spec.iso_ts, [s.name for s in spec.strategies]).select(
            *keys, F.lit(MANIFEST).alias("section"), "seq", no_step.alias("step"), "text")
    if spec.output.tree:
        ends = heads.select(*keys, F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("seq"), F.lit("/* FILE TREE:\nProject Tree Structure:\n.").alias("text")),
            F.struct(F.lit(2).cast("long").alias("seq"), F.lit("\n*/").alias("text")))).alias("_e"))
        lines = tree.tree_nodes(files, keys).select(
            *keys, F.lit(TREE).alias("section"), F.lit(1).cast("long").alias("seq"),
            F.split("node", "/").alias("step"), F.col("line").alias("text"))
        drawn = ends.select(*keys, F.lit(TREE).alias("section"), F.col("_e.seq").alias("seq"),
                            no_step.alias("step"), F.col("_e.text").alias("text")).unionByName(lines)
        rows = drawn if rows is None else rows.unionByName(drawn)
    return rows


def preamble_tokens(preamble: DataFrame, spec: ExportSpec) -> DataFrame:
    """(project, tokens) of manifest and tree as one text, from the lengths of their lines."""
    per_block = preamble.groupBy("project", "section").agg(
        (F.sum(utf16_length(F.col("text")) + 1) - 1).alias("units"))
    joined = per_block.groupBy("project").agg(
        (F.sum("units") + (F.count(F.lit(1)) - 1) * len(spec.format.separator)).alias("units"))
    return joined.select("project", tokens_of_length(F.col("units")).alias("tokens"))


def split_parts(m: Measured, spec: ExportSpec, preamble: DataFrame | None) -> DataFrame:
    start = None if preamble is None else preamble_tokens(preamble, spec)
    return pack.pack_chunks(m.ordered, spec.budget.max_tokens or 100_000, start)


def _file_places(placed: DataFrame) -> DataFrame:
    return placed.select("project", "file_name", F.lit(FILE).alias("section"), F.col("ord").alias("seq"), F.array().cast("array<string>").alias("step"),
                         "_at", F.col("processed_size").alias("bytes"), F.lit(None).cast("string").alias("text"))


def _preamble_places(preamble: DataFrame) -> DataFrame:
    return preamble.select("project", "file_name", "section", "seq", "step", F.lit(None).cast("long").alias("_at"),
                           F.octet_length("text").cast("long").alias("bytes"), "text")


def _with_texts(m: Measured, places: DataFrame) -> DataFrame:
    """Rows at places (project, file_name, section, seq, step, _at, text, ...) with their texts: those of files are held by m."""
    columns = [c for c in places.columns if c not in ("_at", "text")]
    held = m.texts.select("_block", "_at", F.col("content").alias("text"))
    found = with_texts(held, places.where("_at is not null").select(*columns, "_at"))
    return found.unionByName(places.where("_at is null").select(*columns, "text"))


def export_rows(files: DataFrame, spec: ExportSpec, names=None) -> DataFrame:
    """(project, file_name, section, seq, step, text): the rows of every output file.

    Sorted by (section, seq, step) they are its text: rows of a block are joined by a line
    feed, blocks by the separator. No row holds more than one file or one line.
    """
    return placed_rows(measure(files, spec, names), spec)


def placed_rows(m: Measured, spec: ExportSpec) -> DataFrame:
    return _with_texts(m, places(m, spec).drop("bytes"))


def places(m: Measured, spec: ExportSpec) -> DataFrame:
    """(project, file_name, section, seq, step, _at, bytes, text): every row of every output file, with the number of its text for
    files and the text itself for lines of manifest and tree."""
    if spec.output.mode == "multi":
        return _multi_places(m, spec)
    stamp, template = spec.iso_ts, spec.output.file_name
    heads = stage(_heads(m.ordered, ["project"], F.col("project"), m.projects))
    preamble = preamble_rows(m.ordered, ["project"], heads, spec)
    if preamble is not None:
        preamble = stage(preamble)
    first = pack.part_file_name(template, stamp, F.lit(1))
    if spec.budget.enabled and spec.budget.split:
        parts = split_parts(m, spec, preamble).select("project", "path", "part")
        # Narrow rows on both sides.
        placed = m.ordered.join(parts, ["project", "path"]).withColumn(
            "file_name", pack.part_file_name(template, stamp, F.col("part")))
    else:
        placed = m.ordered.withColumn("file_name", first)
    rows = _file_places(placed)
    if preamble is not None:
        return rows.unionByName(_preamble_places(preamble.withColumn("file_name", first)))
    if not (spec.budget.enabled and spec.budget.split):
        # An export that is not split has its one file even if that is empty.
        bare = heads.where("total_files = 0").select("project", first.alias("file_name"), F.lit(FILE).alias("section"), F.lit(0).cast("long").alias("seq"),
                                                     F.array().cast("array<string>").alias("step"), F.lit("").alias("text"))
        rows = rows.unionByName(_preamble_places(bare))
    return rows


def _multi_places(m: Measured, spec: ExportSpec) -> DataFrame:
    keyed = m.ordered.withColumn("group_key", groups.group_key(spec.output.group_by))
    keyed = stage(spread_join(keyed, groups.group_files(keyed), ["project", "group_key"]))
    keys = ["project", "file_name"]
    rows = _file_places(keyed)
    names = keyed.groupBy(*keys).agg(F.first("group_key").alias("group_key"))
    heads = stage(_heads(keyed, keys, F.lit("")).join(names, keys).withColumn(
        "title", F.concat("project", F.lit("-"), "group_key")))
    preamble = preamble_rows(keyed, keys, heads, spec)
    return rows if preamble is None else rows.unionByName(_preamble_places(preamble))


def summary(m: Measured) -> DataFrame:
    """(project, total_files, total_tokens, total_size), zeros where nothing was selected."""
    return m.projects.join(manifest.totals(m.ordered, ["project"]), "project", "left").fillna(0)


def preview_rows(files: DataFrame, spec: ExportSpec, names=None) -> DataFrame:
    """The rows of a single unsplit export, for reading without a sink."""
    plain = replace(spec, output=replace(spec.output, mode="single"), budget=replace(spec.budget, enabled=False))
    return export_rows(files, plain, names).drop("file_name")


def write_preview(files: DataFrame, spec: ExportSpec, target: str, names=None) -> None:
    """The previews of all projects as text below target, one folder per project, in the layout of an export."""
    rows = preview_rows(files, spec, names).withColumn("file_name", F.lit("preview"))
    write_rows(rows, spec.format.separator, target)


def output_files(rows: DataFrame) -> DataFrame:
    """(project, file_name, bytes) of every file that an export writes, separators left out."""
    return rows.groupBy("project", "file_name").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def export(spark: SparkSession, files: DataFrame, spec: ExportSpec, target: str, names=None, task_bytes: int | None = None) -> DataFrame:
    """Write every output file below target and return the summary per project, with the number of its files.

    target may be on any file system that pyarrow opens. The intermediate tables are removed at the end; the summary is
    kept. output_files lists the files. A task writes task_bytes of text, see sinks.place.
    """
    with staged_tables(spark) as keep:
        m = measure(files, spec, names)
        placed = place(places(m, spec), task_bytes)
        write_placed(placed, _with_texts(m, placed.rows), spec.format.separator, target)
        count = placed.rows.groupBy("project").agg(F.count_distinct("file_name").alias("output_files"))
        return keep(summary(m).join(count, "project", "left").fillna(0))
