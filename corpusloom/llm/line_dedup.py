"""Line dedup over batches: levelled sorted runs of line hashes, compacted from time to time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.rows import BLANKS, map_slices, octets, unused
from corpusloom.staging import stage, stage_clustered

KEY = ["hi", "lo"]
MIN_CHARS = 10
BATCHES = 6
FAN_IN = 3
_BLANK_BYTES = BLANKS.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without blanks at its ends, A-Z in lower case; None if it has too few code points."""
    key = line.strip(_BLANK_BYTES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars:
        return None
    return key


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo): the 128-bit hashes of the different keys of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, digests = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                keys = {line_key(line, min_chars) for line in text.split(b"\n")}
                keys.discard(None)
                digests.extend(map(xxhash.xxh3_128_digest, keys))
                at.extend([i] * len(keys))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["doc_id", *KEY])
        return each

    return map_slices(docs.select("doc_id", octets().alias("text")), "text", "doc_id long, hi long, lo long", make)


class LineRuns:
    """Which document was the first to hold a line, for batches in ascending order of documents.

    A run is a Parquet table of (hi, lo, owner) without repeats, bucketed by the hash and sorted in
    each bucket. A new batch is reduced to its own least document per line, merge-anti-joined with the
    runs (which need no shuffle, being bucketed alike) and written as a run of level 0. When a
    level holds fan_in runs they are merged into one of the next level, so n batches leave
    about fan_in * log(n) runs. Everything lies in the shared folder.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        return stage_clustered(rows, list(KEY), buckets=self.buckets, ordered=True)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add the lines (doc_id, hi, lo) of one batch; its ids must not lie below those of earlier batches."""
        new = batch.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), KEY, "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            merged = self._write(self.owners(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    def owners(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """(hi, lo, owner) of all runs; no line is in two of them."""
        return reduce(DataFrame.union, self.runs() if runs is None else runs)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, keys): for documents that lose lines, the 16-byte hashes of these lines.

    Batches are ranges of doc_id with about as many documents each. Documents without an id come
    last and count as one document, which owns a line only if no other document holds it.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))
    no = reduce(lambda rest, i: F.when(F.col("doc_id") <= cuts[i], i).otherwise(rest), reversed(range(len(cuts))), F.lit(len(cuts)))
    lines = stage(line_hashes(docs, min_chars).withColumn("batch", no))
    held = LineRuns(spark, fan_in)
    for i in range(len(cuts) + 1):
        held.add(lines.where(F.col("batch") == i).drop("batch"))
    # A line may be in a third of all documents: plain merge join, whose large keys Spark splits.
    lost = lines.join(held.owners().hint("merge"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def _with_kept(docs: DataFrame, min_chars: int, schema: str, make, batches: int, fan_in: int) -> DataFrame:
    lost = repeated_lines(docs, min_chars, batches, fan_in)
    keys, owner = unused("lost_keys", docs), unused("lost_id", docs)
    lost = lost.select(F.col("doc_id").alias(owner), F.col("keys").alias(keys))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost[owner]), "left").drop(owner)
    return map_slices(joined.withColumn("text", octets()), "text", schema, lambda: make(keys))


def _split(batch: pa.RecordBatch, keys: str, min_chars: int):
    """(number of lines, kept lines) of every text."""
    for text, lost in zip(batch.column("text").to_pylist(), batch.column(keys).to_pylist()):
        lines = text.split(b"\n")
        if not lost:
            yield len(lines), lines
            continue
        gone = {np.array([k["hi"], k["lo"]], "<i8").tobytes() for k in lost}

        def stays(line: bytes) -> bool:
            key = line_key(line, min_chars)
            return key is None or xxhash.xxh3_128_digest(key) not in gone

        yield len(lines), list(filter(stays, lines))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines that an earlier document holds.

    A line's key is the line without blanks at its ends and with A-Z in lower case. Lines whose
    key has min_chars code points or more and is found in several documents stay only in the
    smallest doc_id (with all their repeats there). Null and empty texts are one empty line. Rows that
    repeat a doc_id are one document. Empty tables give an empty result.
    """

    def make(keys: str):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(_split(batch, keys, min_chars))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([n - len(kept) for n, kept in found], pa.int64()),
                 pa.array([b"\n".join(kept) for _, kept in found], pa.binary())],
                ["doc_id", "n_lines", "n_dropped", "kept"])
        return each

    return _with_kept(docs.select("doc_id", "text"), min_chars,
                      "doc_id long, n_lines long, n_dropped long, kept binary", make, batches, fan_in)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """The documents with all their columns, texts without the lines of earlier documents; n_chars follows the text."""

    def make(keys: str):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = pa.array([b"\n".join(lines) for _, lines in _split(batch, keys, min_chars)], pa.binary())
            return batch.set_column(batch.schema.get_field_index("text"), "text", kept).drop_columns([keys])
        return each

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    out = _with_kept(docs, min_chars, fields, make, batches, fan_in).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
