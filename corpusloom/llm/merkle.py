"""Merkle manifest of a dataset: aligned subtrees in van Emde Boas layout, a tier of blocks over the roots of the tier below."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import present
from corpusloom.operators.ordering import numbered
from corpusloom.staging import stage

# A block holds the nodes over at most 2 ** HEIGHT leaves.
HEIGHT = 10
DIGEST = 32
# A step of a path: 0 if the node has no sibling, 1 if it is on the left, 2 on the right; then its digest.
STEP = 1 + DIGEST
TOP = ""


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slots of nodes of a binary tree of that many levels, by their depth and their number in it.

    The tree is cut at half height: first the upper part, then the lower subtrees from left to right, each
    laid out in the same way. A walk from leaf to root so stays in few cache lines or pages of any size.
    """
    slot = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = depth - upper
        slot = slot + ((1 << upper) - 1 + (index >> below) * ((1 << (levels - upper)) - 1))
        index = index & ((1 << below) - 1)
        levels, depth = levels - upper, below
    return slot


@lru_cache(maxsize=64)
def slots(height: int, depth: int) -> np.ndarray:
    """address() of all nodes of one depth of a subtree of that height."""
    return address(height + 1, depth, np.arange(1 << depth))


def parent(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def build_nodes(leaves: list[bytes], height: int) -> bytes:
    """The nodes over the leaves in van Emde Boas order. A run that is cut short, even to one node, is hashed like
    the others; slots without a node are zero."""
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    level = [d.hex() for d in leaves]
    for depth in range(height, -1, -1):
        nodes[slots(height, depth)[:len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [parent(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return nodes.tobytes()


def inner_paths(nodes: bytes, height: int, n: int) -> np.ndarray:
    """(n, height * STEP) bytes: the siblings of each leaf inside its block, from below."""
    table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    steps = np.zeros((n, height, STEP), np.uint8)
    leaf = np.arange(n)
    for up in range(height):
        mine = leaf >> up
        other = mine ^ 1
        there = other < -(-n >> up)
        steps[there, up, 0] = np.where(other < mine, 1, 2)[there]
        steps[there, up, 1:] = table[slots(height, height - up)[other[there]]]
    return steps.reshape(n, height * STEP)


def steps_of(path: bytes) -> list[tuple[int, str]]:
    """(side, sibling in hex) of each step of a path."""
    return [(path[i], path[i + 1:i + STEP].hex()) for i in range(0, len(path), STEP)]


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for side, other in steps:
        leaf = parent(other, leaf) if side == 1 else parent(leaf, other) if side == 2 else parent(leaf)
    return leaf


def proof_digest(steps: list[tuple[int, str]]) -> str:
    return parent(*(other for side, other in steps if side))


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, or '-'."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """(tree, block, n, height, last, nodes) over leaves (tree, pos, digest), pos from 0."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("of"))
    # At most 2 ** height digests meet in a row.
    grouped = leaves.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"].alias("digests"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("tree", "block", "digests", "of")}
                last = row["of"] <= 1 << height
                high = (row["of"] - 1).bit_length() if last else height
                yield pa.RecordBatch.from_pydict({
                    "tree": [row["tree"]], "block": [row["block"]], "n": pa.array([len(row["digests"])], pa.int32()),
                    "height": pa.array([high], pa.int32()), "last": [last], "nodes": [build_nodes(row["digests"], high)]})

    return grouped.join(sizes, "tree").mapInArrow(run, "tree string, block long, n int, height int, last boolean, nodes binary")


def _tiers(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Blocks over the leaves, blocks over their roots, and so on until each tree has one root. A tier is 2 ** height
    times smaller than the one below."""
    tiers = []
    while True:
        tiers.append(stage(_blocks(leaves, height)))
        leaves = tiers[-1].where(~F.col("last")).select("tree", F.col("block").alias("pos"), _root())
        if leaves.isEmpty():
            return tiers


def _root() -> Column:
    # The root has the first slot of its block.
    return F.substring("nodes", 1, DIGEST).alias("digest")


@dataclass
class Manifest:
    """leaves (tree, pos, ...), the tiers of blocks of all trees, the trees (tree, pos, digest) and the tiers over their roots."""

    leaves: DataFrame
    tiers: list[DataFrame]
    named: DataFrame
    top: list[DataFrame]
    height: int


def build(leaves: DataFrame, order: list[Column], height: int = HEIGHT) -> Manifest:
    """The manifest over rows (tree, digest, ...), by tree in the given order, trees in order of their names.

    tree and digest (32 bytes) may not be null, order must be total up to equal digests. Positions come
    from a range shuffle, so a tree may own any share of the rows. No leaves: no blocks.
    """
    placed = stage(numbered(leaves, ["tree"], order, "pos").withColumn("pos", F.col("pos") - 1))
    tiers = _tiers(placed.select("tree", "pos", "digest"), height)
    roots = None
    for tier in tiers:
        found = tier.where("last").select("tree", _root())
        roots = found if roots is None else roots.unionByName(found)
    named = numbered(roots.select(F.lit(TOP).alias("over"), "tree", "digest"), ["over"], [F.col("tree")], "pos")
    named = stage(named.select("over", "tree", (F.col("pos") - 1).alias("pos"), "digest"))
    top = _tiers(named.select(F.col("over").alias("tree"), "pos", "digest"), height)
    return Manifest(placed, tiers, named, top, height)


_WAY = "path binary, subroot binary, root binary"


def _below(blocks: DataFrame, ways: DataFrame, height: int) -> DataFrame:
    """(tree, pos, digest, path, subroot, root) of the leaves of blocks, from those of the blocks' own roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, high, nodes = row["n"], row["height"], row["nodes"]
                inner = inner_paths(nodes, high, n)
                at = slots(high, high)[:n] * DIGEST
                yield pa.RecordBatch.from_pydict({
                    "tree": [row["tree"]] * n, "pos": [(row["block"] << height) + i for i in range(n)],
                    "digest": [nodes[a:a + DIGEST] for a in at.tolist()],
                    "path": [inner[i].tobytes() + row["path"] for i in range(n)],
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()), "root": pa.array([row["root"]] * n, pa.binary())})

    return blocks.join(ways, ["tree", "block"]).mapInArrow(run, f"tree string, pos long, digest binary, {_WAY}")


def _ways(tiers: list[DataFrame], trees: DataFrame, height: int) -> DataFrame:
    """(tree, block, path, subroot, root) of the blocks of the lowest tier, from those (tree, ...) of the trees."""
    found = None
    for at in range(len(tiers) - 1, -1, -1):
        own = tiers[at].where("last").select("tree", "block").join(trees, "tree")
        if found is not None:
            deeper = _below(tiers[at + 1], found, height).withColumnRenamed("pos", "block").drop("digest")
            own = own.unionByName(deeper)
        found = stage(own)
    return found


def prove(manifest: Manifest, keep: list[str], claimed: str = "claimed") -> DataFrame:
    """The columns `keep` of every leaf with leaf, subroot, root, proof_sha256 and folded_root (lowercase hex).

    The proof is the list of siblings up to the root of the tree and on to that over all trees; folded_root is
    what they give with the digest in the column `claimed`, or the leaf's own where that is null. Paths
    go down tier by tier, a row per block; leaves meet them a block at a time.
    """
    top, height = manifest.top, manifest.height
    nothing = F.lit(b"")
    over = top[-1].where("last").select("tree", nothing.alias("path"), F.lit(None).cast("binary").alias("subroot"),
                                        F.substring("nodes", 1, DIGEST).alias("root"))
    subroots = _below(top[0], _ways(top, over, height), height).select("pos", "path", F.col("digest").alias("subroot"), "root")
    trees = stage(manifest.named.select("tree", "pos").join(subroots, "pos").drop("pos"))
    ways = _ways(manifest.tiers, trees, height)
    claims = manifest.leaves.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *keep, claimed))).alias("claims"))
    rows = manifest.tiers[0].join(ways, ["tree", "block"]).join(claims, ["tree", "block"])
    kept = [f"`{c}` {manifest.leaves.schema[c].dataType.simpleString()}" for c in keep]
    out = [*keep, "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at = {c: row.column(c)[0].as_py() for c in ("nodes", "height", "n", "path", "subroot", "root")}
                inner = inner_paths(at["nodes"], at["height"], at["n"])
                above, own = steps_of(at["path"]), slots(at["height"], at["height"]) * DIGEST
                claimed_rows = row.column("claims").flatten()
                said = claimed_rows.field(claimed).to_pylist()
                made = []
                for k in range(at["n"]):
                    steps = steps_of(inner[k].tobytes()) + above
                    leaf = at["nodes"][own[k]:own[k] + DIGEST].hex()
                    made.append((leaf, at["subroot"].hex(), at["root"].hex(), proof_digest(steps),
                                 fold(leaf if said[k] is None else said[k].hex(), steps)))
                yield pa.RecordBatch.from_arrays([*(claimed_rows.field(c) for c in keep), *map(pa.array, zip(*made))], out)

    return rows.mapInArrow(run, ", ".join([*kept, *(f"{c} string" for c in out[len(keep):])]))


def audit_documents(docs: DataFrame, changed: Column, as_changed: dict[str, Column], columns=("doc_id", "source", "lang", "n_chars", "text"),
                    tree: str = "lang", key: str = "doc_id", height: int = HEIGHT) -> DataFrame:
    """Builds the manifest over documents, one tree per lang, then proves each row with the values it is found with.

    changed tells the rows that are found with the values as_changed (column -> value) in place of their own.
    Result: key, leaf, subroot, root, proof_sha256, folded_root, verified, one row per row of docs. A null in any
    column is a value of its own ('-'); rows without a lang are a tree of their own, the first. In a tree rows without an id
    come first; rows of one id are ordered by their digest, so repeated rows have leaves of their own and
    reruns agree. Other columns are not looked at. An empty table gives an empty result.
    """
    own = [F.col(c) for c in columns]
    found = [as_changed.get(c, F.col(c)) for c in columns]
    # Texts are read once; all later steps work on digests.
    leaves = stage(docs.select(
        present(F.col(tree)).alias("tree"), F.col(key).alias("id"), F.unhex(leaf_digest(*own)).alias("digest"),
        F.when(F.coalesce(changed, F.lit(False)), F.unhex(leaf_digest(*found))).alias("claimed")))
    manifest = build(leaves, [F.col("id").asc_nulls_first(), F.col("digest")], height)
    proved = prove(manifest, ["id"])
    return proved.select(F.col("id").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
