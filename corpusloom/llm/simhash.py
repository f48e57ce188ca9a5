"""SimHash near-duplicates: deletion variants of fingerprint segments, equality joins, components."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.rows import map_slices, octets
from corpusloom.staging import stage

BITS = 64
# Fingerprints that may share a segment before their other bits are looked at.
CROWDED = 256
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint: bit i is set if it is set in over half of the shingle hashes.

    Shingles are runs of words of the text with A-Z in lower case, repeats included. A text of
    fewer words is one shingle, a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), _CHUNK):
        part = grams[i:i + _CHUNK]
        hashes = np.fromiter(map(digest, part), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, fp is the fingerprint as a signed long. A null text has no words."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        return each

    return map_slices(docs.select("doc_id", octets().alias("text")), "text", "doc_id long, fp long", make)


def _segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(first: int, width: int, of: Column) -> Column:
    if width == BITS:
        return of
    return F.shiftrightunsigned(of, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _listed(cut: list[tuple[int, int]], of: Column, no: str, part: str) -> Column:
    """The segments of some bits, one struct (no, part, w) each."""
    return F.array(*[F.struct(F.lit(i).alias(no), _bits(a, w, of).alias(part), F.lit(w).alias("w"))
                     for i, (a, w) in enumerate(cut)])


def _variants(part: str) -> Column:
    """A segment of w bits itself and with each one of its set bits deleted."""
    return F.expr(f"array_distinct(concat(array({part}), transform(sequence(0, w - 1), i -> {part} & ~shiftleft(1L, i))))")


def links(distinct: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints of the column fp with at most `distance` differing bits.

    distance // 2 + 1 segments leave one that differs by at most one bit. Of two segments that
    differ in one bit, the one that has the bit, with that bit deleted, equals the other. So the
    index holds every segment with none or one of its set bits deleted (the one-wildcard
    variants without repeats), and the segments themselves look it up by equality.

    A segment that more than `crowded` fingerprints share, as in a large group of near copies, would
    compare each with all. There the other bits are cut in the same way, and two fingerprints meet only
    if they also share a variant of one of these smaller segments.
    """
    cut = _segments(distance)
    probe = distinct.select(F.col("fp").alias("y"), F.inline(_listed(cut, F.col("fp"), "no", "part"))).drop("w")
    index = distinct.select(F.col("fp").alias("x"), F.inline(_listed(cut, F.col("fp"), "no", "part"))).select(
        "x", "no", F.explode(_variants("part")).alias("part"))
    # Fewer rows than fingerprints / crowded for each segment.
    full = stage(probe.groupBy("no", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).drop("n"))

    def inner(rows: DataFrame, fp: str) -> DataFrame:
        """Rows at crowded segments, once for each variant of each smaller segment of their other bits."""
        others = None
        for i, (a, w) in enumerate(cut):
            # The bits above and below the segment, side by side.
            high = BITS - a - w
            rest = (F.shiftleft(_bits(a + w, high, F.col(fp)), a) if high else F.lit(0).cast("long")).bitwiseOR(
                _bits(0, a, F.col(fp)) if a else F.lit(0).cast("long"))
            found = _listed(_segments(distance, BITS - w), rest, "in_no", "in_part")
            others = F.when(F.col("no") == i, found) if others is None else others.when(F.col("no") == i, found)
        if len(cut) == 1:
            # All bits are in the one segment: nothing is left to cut.
            others = F.array(F.struct(F.lit(0).alias("in_no"), F.lit(0).cast("long").alias("in_part"), F.lit(1).alias("w")))
        return rows.join(full, ["no", "part"], "left_semi").select(fp, "no", "part", F.inline(others)).select(
            fp, "no", "part", "in_no", F.explode(_variants("in_part")).alias("in_part"))

    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    plain = index.join(full, ["no", "part"], "left_anti").join(probe.join(full, ["no", "part"], "left_anti"), ["no", "part"])
    close = inner(index, "x").join(inner(probe, "y"), ["no", "part", "in_no", "in_part"])
    return plain.where(near).select(*pair).union(close.where(near).select(*pair)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id, n_links): the component of every document under links of near fingerprints.

    component_id is the smallest doc_id reachable, n_links counts the other fingerprints a
    document's own is linked to. Documents of equal fingerprint meet before any join, so copies
    never make pairs. Rows without a doc_id are linked like others and never name a component
    (null where a component has no id at all). Repeated rows come back as often as they came.
    An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, shingle))
    owners = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = stage(links(owners, distance))
    labels = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    member = owners.join(labels.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    heads = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = member.join(heads, "label").select("fp", "component_id", "n_links")
    # A fingerprint may own a third of the documents: a plain merge join, which Spark splits.
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id", "n_links")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The documents with all their columns, without those whose component has a smaller doc_id.

    Rows of one doc_id are one document and stay if one of them names its component. Rows without a
    doc_id stay. Only ids meet the texts, in an anti-join with those that go.
    """
    found = near_duplicates(docs, shingle, distance)
    gone = (found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("head"))
            .where("not head").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
