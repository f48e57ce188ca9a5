"""Bounded closures over import edges, for all projects and entries at once, and their order."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import clean_root
from corpusloom.operators.edges import IN_NODE_MODULES
from corpusloom.operators.ordering import in_chunks
from corpusloom.spec import DependencyScan
from corpusloom.staging import stage, stage_clustered

# Edges of a closure that is walked in one task, at most; a larger one is ordered by joins.
WALKED = 2_000_000


def _limited(entries: DataFrame, max_depth: int) -> DataFrame:
    """entries with `limits`, what its closure may take; all kinds of edges if they do not say."""
    if "limits" in entries.columns:
        return entries
    return entries.withColumn("limits", F.struct(
        F.lit(max_depth).alias("depth"), F.lit(True).alias("types"), F.lit(True).alias("modules")))


def stage_edges(edges: DataFrame) -> DataFrame:
    """Edges written once, clustered by the file they start from, so that no level of a closure moves them again."""
    typed = edges if "type_only" in edges.columns else edges.withColumn("type_only", F.lit(False))
    return stage_clustered(typed.select("project", "src", "dst", "kind", "ord", "reason", "type_only"), ["project", "src"])


def _steps(edges: DataFrame) -> DataFrame:
    typed = edges if "type_only" in edges.columns else edges.withColumn("type_only", F.lit(False))
    return typed.select("project", "src", "dst", F.col("kind").cast("int").alias("kind"), F.col("ord").cast("long").alias("ord"), "reason", "type_only")


def _allowed() -> Column:
    return ((F.col("limits.types") | ~F.col("type_only"))
            & (F.col("limits.modules") | ~F.rlike("dst", F.lit(IN_NODE_MODULES))))


def bounded_closure(entries: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(project, strategy, path, depth, reason, limits) reached from entries (project, strategy, entry).

    Entries may bring their own limits (depth, types, modules), so any number of scans shares one chain
    of joins; max_depth is then the largest depth. Breadth first. The reason comes from the first
    discoverer in queue order: each level is range-partitioned and sorted by (place of the discoverer, kind, ord), and
    its files get their places from that, so a row carries one number however deep it is.
    """
    steps = _steps(edges)
    seen = frontier = _limited(entries, max_depth).select(
        "project", "strategy", F.col("entry").alias("path"), F.lit(0).alias("depth"),
        F.concat(F.lit("Entry file: "), "entry").alias("reason"), "limits", F.lit(0).cast("long").alias("_seq"))
    for level in range(1, max_depth + 1):
        found = (
            frontier.where(F.col("limits.depth") >= level)
            .select("project", "strategy", F.col("path").alias("src"), "limits", "_seq")
            .join(steps, ["project", "src"]).where(_allowed())
            .groupBy("project", "strategy", F.col("dst").alias("path"))
            .agg(F.min(F.struct("_seq", "kind", "ord", "reason", "limits")).alias("_first"))
            .join(seen, ["project", "strategy", "path"], "left_anti")
            .select("project", "strategy", "path", F.lit(level).alias("depth"), "_first")
        )
        columns = ["project", "strategy", "path", "depth", F.col("_first.reason").alias("reason"), F.col("_first.limits").alias("limits")]
        if level == max_depth:
            # Nobody asks for the places of the last level.
            return seen.drop("_seq").unionByName(found.select(*columns))
        frontier = in_chunks(found, ["project", "strategy"], [F.col(f"_first.{c}") for c in ("_seq", "kind", "ord")]).select(*columns, "_seq")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("_seq")


def closure_edges(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, strategy, src, dst, turn): the edges that the walk may take, numbered per file.

    Files at the depth limit are kept but not expanded.
    """
    opened = closure.where(F.col("depth") < F.col("limits.depth")).select(
        "project", "strategy", F.col("path").alias("src"), "limits")
    taken = opened.join(_steps(edges), ["project", "src"]).where(_allowed())
    # A repeated edge counts where it is met first; self edges change nothing.
    return taken.where("src <> dst").groupBy("project", "strategy", "src", "dst").agg(F.min(F.struct("kind", "ord")).alias("turn"))


def _post_order(rows: pa.Table) -> pa.Table:
    """Depth-first post-order from the entry; an edge back into the open branch is skipped. Closures are many and mostly
    small, so what a call costs counts."""
    rows = rows.sort_by([(c, "ascending") for c in ("src", "kind", "ord", "dst")])
    entry, targets = None, {}
    for src, dst in zip(rows["src"].to_pylist(), rows["dst"].to_pylist()):
        if dst is None:
            entry = src
        else:
            targets.setdefault(src, []).append(dst)
    order, met, branch = [], {entry}, [(entry, iter(targets.get(entry, ())))]
    while branch:
        node, rest = branch[-1]
        child = next((c for c in rest if c not in met), None)
        if child is None:
            order.append(node)
            branch.pop()
        else:
            met.add(child)
            branch.append((child, iter(targets.get(child, ()))))
    keys = {c: pa.repeat(rows[c][0], len(order)) for c in ("project", "strategy")}
    return pa.table(keys | {"path": pa.array(order, pa.string()), "topo_pos": pa.array(range(len(order)), pa.int64())})


def _walked(entries: DataFrame, edges: DataFrame) -> DataFrame:
    rows = edges.select("project", "strategy", "src", "dst", "turn.kind", "turn.ord").unionByName(
        entries.select("project", "strategy", F.col("entry").alias("src"), F.lit(None).cast("string").alias("dst"),
                       F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord")))
    return rows.groupBy("project", "strategy").applyInArrow(
        _post_order, "project string, strategy string, path string, topo_pos long")


def _merged(df: DataFrame) -> DataFrame:
    """For joins of many rounds: a table that just passes for small would go through the driver once a round."""
    return df.hint("merge")


def _numbers(tree: DataFrame, rounds: int) -> DataFrame:
    """(id, pre, last, post) of a forest (id, root, parent, kind, ord): the place of a node in pre-order, that of the last node below
    it, and its place in post-order, each within its tree.

    The walk around a tree enters and leaves each node once: event 2 * id and 2 * id + 1. Every event knows
    the next one and, by doubling its reach in each round, how many entries and leaves come after it.
    """
    children = Window.partitionBy("parent").orderBy("kind", "ord")
    linked = tree.withColumn("_next", F.lead("id").over(children)).withColumn("_nth", F.row_number().over(children))
    firsts = linked.where("parent is not null and _nth = 1").select(F.col("parent").alias("id"), F.col("id").alias("_child"))
    after_leave = F.when(F.col("parent").isNull(), F.lit(None)).otherwise(F.coalesce(2 * F.col("_next"), 2 * F.col("parent") + 1))
    events = stage(linked.join(_merged(firsts), "id", "left").select("root", F.inline(F.array(
        F.struct((2 * F.col("id")).alias("event"), F.coalesce(2 * F.col("_child"), 2 * F.col("id") + 1).alias("next"),
                 F.lit(1).cast("long").alias("enters"), F.lit(0).cast("long").alias("leaves")),
        F.struct((2 * F.col("id") + 1).alias("event"), after_leave.alias("next"),
                 F.lit(0).cast("long").alias("enters"), F.lit(1).cast("long").alias("leaves"))))))
    for _ in range(rounds):
        ahead = events.select(F.col("event").alias("next"), F.col("next").alias("_next"), F.col("enters").alias("_enters"), F.col("leaves").alias("_leaves"))
        events = stage(events.join(_merged(ahead), "next", "left").select(
            "root", "event", F.col("_next").alias("next"), (F.col("enters") + F.coalesce("_enters", F.lit(0))).alias("enters"),
            (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves")))
    entered = (F.col("event") % 2) == 0
    sizes = events.groupBy("root").agg(F.max("leaves").alias("_n"))
    per_node = events.groupBy("root", F.shiftright("event", 1).alias("id")).agg(
        F.max(F.when(entered, F.col("enters"))).alias("_in"), F.max(F.when(~entered, F.col("enters"))).alias("_out"),
        F.max(F.when(~entered, F.col("leaves"))).alias("_left"))
    return per_node.join(_merged(sizes), "root").select(
        "id", (F.col("_n") - F.col("_in")).alias("pre"), (F.col("_n") - F.col("_out") - 1).alias("last"), (F.col("_n") - F.col("_left")).alias("post"))


def topo_order_by_joins(entries: DataFrame, edges: DataFrame, depths: DataFrame) -> DataFrame:
    """The same order by joins alone, for closures too large for one task; depths (project, strategy, path, depth) is the closure.

    Starts from a breadth-first tree. A tree is the depth-first one if no edge leads to a file that the walk
    around the tree has not met when it comes to that edge. Files for which one does are moved below the
    first such edge, all at once, and the tree is numbered anew. What comes before the first such edge is
    final, so this ends; a chain of files is right from the start. Rows hold a few numbers, however long a branch is.
    The order is sequential by nature: a graph at random takes a number of rounds in proportion to its files.
    """
    keys = ["project", "strategy"]
    nodes = in_chunks(depths.select(*keys, "path", "depth"), keys, [F.col("path")]).select(*keys, "path", "depth", F.col("_seq").alias("id"))
    roots = nodes.where("depth = 0").select(*keys, F.col("id").alias("root"))
    largest = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = math.ceil(math.log2(2 * largest)) if largest else 0

    def end(side: str) -> DataFrame:
        return nodes.select(*keys, F.col("path").alias(side), F.col("id").alias(f"{side}_id"), F.col("depth").alias(f"{side}_depth"))

    steps = stage(edges.join(_merged(end("src")), [*keys, "src"]).join(_merged(end("dst")), [*keys, "dst"]).select(
        F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "turn.kind", "turn.ord", (F.col("dst_depth") == F.col("src_depth") + 1).alias("down")))
    above = steps.where("down").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("kind", "ord", F.col("src").alias("parent"))).alias("at"))
    tree = stage(nodes.join(_merged(roots), keys).join(_merged(above), "id", "left").select(
        "id", "root", F.when(F.col("depth") > 0, F.col("at.parent")).alias("parent"), "at.kind", "at.ord"))
    before = Window.partitionBy("src").orderBy("kind", "ord").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        numbers = stage(_numbers(tree, rounds))
        inside = tree.select(F.col("id").alias("dst"), F.col("parent").alias("src"), F.lit(True).alias("taken"))
        met = (steps.join(_merged(inside), ["src", "dst"], "left")
               .join(_merged(numbers.select(F.col("id").alias("dst"), F.col("pre").alias("dst_pre"), "last")), "dst")
               .join(_merged(numbers.select(F.col("id").alias("src"), "pre")), "src")
               # The last file that the walk has met when it comes to this edge.
               .withColumn("met", F.coalesce(F.max(F.when(F.col("taken"), F.col("last"))).over(before), F.col("pre"))))
        moved = stage(met.where("taken is null and met < dst_pre").groupBy(F.col("dst").alias("id")).agg(
            F.min(F.struct("met", (-F.col("pre")).alias("up"), "kind", "ord", F.col("src").alias("parent"))).alias("to")))
        if moved.isEmpty():
            return nodes.join(_merged(numbers), "id").select(*keys, "path", F.col("post").alias("topo_pos"))
        tree = stage(tree.join(_merged(moved), "id", "left").select("id", "root", *(F.coalesce(f"to.{c}", c).alias(c) for c in ("parent", "kind", "ord"))))


def topo_order(entries: DataFrame, edges: DataFrame, depths: DataFrame, walked: int = WALKED) -> DataFrame:
    """(project, strategy, path, topo_pos): dependencies before the files that need them.

    entries (project, strategy, entry), edges as from closure_edges, depths (project, strategy, path, depth) as from bounded_closure.
    A depth-first order is sequential, so a closure of up to `walked` edges is walked in one task, all closures of all
    projects at once; larger ones are ordered by joins.
    """
    keys = ["project", "strategy"]
    edges = stage(edges)
    large = stage(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > walked).select(*keys))
    if large.isEmpty():
        return _walked(entries, edges)
    small, huge = (lambda df: df.join(large, keys, "left_anti")), (lambda df: df.join(large, keys, "left_semi"))
    return _walked(small(entries), small(edges)).unionByName(topo_order_by_joins(huge(entries), huge(edges), huge(depths)))


def dependency_scans(files: DataFrame, scans, edges: DataFrame) -> DataFrame:
    """(project, strategy, path, depth, reason, topo_pos) of all scans [(label, DependencyScan)] in one chain of
    joins; strategy holds the label.

    edges should be staged by the caller, best by stage_edges(); they are read once per level. An entry may be written as
    './src/main.ts'; one that leads out of the project, or is not there, has no closure.
    """
    wanted = [F.struct(F.lit(str(label)).alias("strategy"), F.lit(clean_root(scan.entry)).cast("string").alias("entry"), F.struct(
        F.lit(scan.depth).alias("depth"), F.lit(scan.include_types).alias("types"),
        F.lit(scan.include_node_modules).alias("modules")).alias("limits")) for label, scan in scans]
    entries = stage(files.select("project", "path", F.inline(F.filter(F.array(*wanted), lambda w: w["entry"] == F.col("path"))))
                    .select("project", "strategy", "entry", "limits").distinct())
    closure = stage(bounded_closure(entries, edges, max(scan.depth for _, scan in scans)))
    order = topo_order(entries, closure_edges(closure, edges), closure)
    return closure.drop("limits").join(order, ["project", "strategy", "path"])


def dependency_scan(files: DataFrame, strategy: str, entry: str, edges: DataFrame, depth: int = 2) -> DataFrame:
    """dependency_scans for one entry and edges that are chosen already."""
    return dependency_scans(files, [(strategy, DependencyScan(strategy, entry, depth=depth, include_node_modules=True))], edges)
