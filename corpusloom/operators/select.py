"""Which files to take, and why.

Full, pattern and folder scans are predicates on a row, so any number of them is one
pass over the files without a shuffle: the first strategy that matches gives the reason.
Only ignore rules (per project) and dependency closures (per file) bring in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths
from corpusloom.functions.ignore import ignored, parse_rules
from corpusloom.functions.text import read_text
from corpusloom.operators.member import with_member
from corpusloom.operators.ordering import spread_join
from corpusloom.staging import stage
from corpusloom.spec import KINDS, DependencyScan, Filters, FolderScan, FullScan, PatternScan

# Fixed value: bytes looked at for a NUL.
SNIFF_BYTES = 8192


def is_binary(content: Column) -> Column:
    return F.coalesce(
        F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(bytearray(b"\x00"))), F.lit(False))


def extension_in(path: Column, extensions) -> Column:
    """The file's extension is lower-cased, the list is taken as given; no list means all."""
    return paths.extension_lower(path).isin(list(extensions)) if extensions else F.lit(True)


def size_within(size: Column, max_kb: float) -> Column:
    return size <= F.lit(int(max_kb * 1024)) if max_kb else F.lit(True)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(project, runs) from the .gitignore at the root of each project."""
    return files.where(F.col("path") == ".gitignore").select(
        "project", parse_rules(read_text(F.col("content"))).alias("_runs"))


def with_ignored(files: DataFrame) -> DataFrame:
    """files plus _ignored.

    The rules of a project are tested on its paths alone, spread over salts, since one project
    may own most of them. What comes back to the files is whether a path is hidden, without moving their contents.
    """
    rules = stage(ignore_rules(files))
    hidden = stage(spread_join(files.select("project", "path"), rules, ["project"])
                   .where(ignored(F.col("path"), F.col("_runs"))).select("project", "path").distinct())
    return with_member(files, hidden, ["project", "path"], "_ignored")


def full_matches(scan: FullScan, filters: Filters, columns) -> Column:
    root = paths.clean_root(scan.root)
    if root is None:
        return F.lit(False)
    path = F.col("path")
    keep = (paths.under(path, root) & extension_in(path, scan.extensions)
            & ~globs.excluded(path, [*filters.exclude, *scan.exclude], root))
    if filters.respect_gitignore and scan.respect_gitignore:
        keep = keep & ~F.col("_ignored")
    if filters.binary_detection:
        keep = keep & ~(F.col("is_binary") if "is_binary" in columns else is_binary(F.col("content")))
    return keep


def pattern_matches(scan: PatternScan, filters: Filters) -> Column:
    return globs.listed(F.col("path"), scan.patterns, [*filters.exclude, *scan.exclude])


def folder_target(scan: FolderScan, filters: Filters) -> Column:
    """NULL, or the kind of the first target that holds the path: 'files' or 'file'."""
    path = F.col("path")
    found = None
    for target in scan.paths:
        folder = paths.clean_root(target)
        if folder is None:
            continue
        inside = (paths.under(path, folder) & extension_in(path, scan.extensions)
                  & ~globs.excluded(path, [*filters.exclude, *scan.exclude], folder))
        levels = paths.depth(path) - (folder.count("/") + 1 if folder else 0)
        if not scan.recursive:
            inside = inside & (levels == 1)
        if scan.max_depth is not None:
            inside = inside & (levels <= scan.max_depth)
        for test, kind in ((path == folder, "file"), (inside, "files")):
            found = F.when(test, kind) if found is None else found.when(test, kind)
    return F.lit(None).cast("string") if found is None else found


def _full(scan: FullScan, filters: Filters, columns):
    return full_matches(scan, filters, columns), F.lit(f"Full strategy: {scan.name}")


def _pattern(scan: PatternScan, filters: Filters, columns):
    return pattern_matches(scan, filters), F.lit(f"Pattern match: {scan.name}")


def _folder(scan: FolderScan, filters: Filters, columns):
    kind = folder_target(scan, filters)
    return kind.isNotNull(), F.concat(F.lit("Folder "), kind, F.lit(f": {scan.name}"))


# Class of a strategy -> function of (scan, filters, columns of files) that gives two Columns over a
# row of files: whether the strategy takes it, and why.
MATCHERS = {FullScan: _full, PatternScan: _pattern, FolderScan: _folder}


def register_strategy(kind: type, matcher) -> None:
    """Add a strategy of one's own: a dataclass with name and type, and its matcher."""
    MATCHERS[kind] = matcher
    KINDS.add(kind.type)


def needs_ignore(scans, filters: Filters) -> bool:
    return filters.respect_gitignore and any(
        isinstance(s, FullScan) and s.respect_gitignore for s in scans)


def collect_files(files: DataFrame, scans, filters: Filters, closures=None) -> DataFrame:
    """Selected rows of files plus strategy_idx, strategy, reason and topo_pos.

    scans is [(index in the config, scan)]; closures maps that index to a table
    (project, path, reason, topo_pos) for every dependency scan.
    """
    columns = files.columns
    if needs_ignore([s for _, s in scans], filters):
        files = with_ignored(files)
    picks = []
    for i, scan in scans:
        topo = F.lit(0)
        if isinstance(scan, DependencyScan):
            closure = closures[i].select(
                "project", "path", F.col("reason").alias(f"_why{i}"), F.col("topo_pos").alias(f"_topo{i}"))
            # Alone, the closure decides; next to other strategies all files stay in play.
            files = files.join(closure, ["project", "path"], "inner" if len(scans) == 1 else "left")
            matches = F.col(f"_topo{i}").isNotNull()
            if scan.exclude:
                matches = matches & ~globs.excluded(F.col("path"), scan.exclude)
            reason, topo = F.col(f"_why{i}"), F.col(f"_topo{i}")
        elif type(scan) in MATCHERS:
            matches, reason = MATCHERS[type(scan)](scan, filters, columns)
        else:
            raise TypeError(f"no matcher is registered for {type(scan).__name__}")
        picks.append(F.when(matches, F.struct(
            F.lit(i).alias("strategy_idx"), F.lit(scan.name).alias("strategy"),
            reason.alias("reason"), topo.cast("long").alias("topo_pos"))))
    if not picks:
        return files.limit(0).select(*columns, F.lit(0).alias("strategy_idx"), F.lit("").alias("strategy"),
                                     F.lit("").alias("reason"), F.lit(0).cast("long").alias("topo_pos"))
    return (
        files.where(~F.col("path").isin("", "."))
        .withColumn("_pick", F.coalesce(*picks)).where(F.col("_pick").isNotNull())
        .select(*columns, "_pick.*")
    )


def scan_refs(files: DataFrame, index: int, scan, filters: Filters, closures=None) -> DataFrame:
    """What one strategy alone selects."""
    return collect_files(files, [(index, scan)], filters, closures).select(
        "project", "path", "strategy", "strategy_idx", "reason", "topo_pos")


def first_wins(refs: DataFrame) -> DataFrame:
    """One row per (project, path): the earliest strategy, then the earliest position.

    A minimum, not a window: copies are merged before the shuffle.
    """
    rest = [c for c in refs.columns if c not in ("project", "path", "strategy_idx", "topo_pos")]
    best = F.min(F.struct("strategy_idx", "topo_pos", *rest)).alias("_best")
    return refs.groupBy("project", "path").agg(best).select("project", "path", "_best.*")
