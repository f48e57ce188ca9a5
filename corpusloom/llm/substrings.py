"""Substring dedup: lines cut into units by their content, digests grouped globally, the earliest one stays."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import map_slices, octets

# Of every ANCHOR_WINDOW neighbouring words the one of least checksum ends a unit, and so does a line of as many words. Units
# inside a passage therefore do not depend on what is around it, but for about that many words at its ends.
ANCHOR_WINDOW = 8
# Words of a unit, at least, unless the text has fewer: an end that has another one so near behind it (or a line end beside it) is none.
LEAST_UNIT = 3
# Words of a run of repeated units that is removed, at least.
LEAST_RUN = 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
# 96 bits of a digest, as a long and an int: at 10 ** 12 units two unequal ones share them with a probability below 1e-5.
_DIGEST = ["hi", "lo"]
_HALVES = np.dtype([("hi", "<i8"), ("lo", "<i4")])


def units(text: bytes) -> tuple[list[bytes], list[int]]:
    """(words with A-Z in lower case, where units end): unit k holds words[ends[k - 1]:ends[k]].

    Short lines, as of verse, are no borders, and a text of one word over and over is one unit, so every word is in a unit
    that is compared.
    """
    words: list[bytes] = []
    lines = []
    for line in text.lower().split(b"\n"):
        before = len(words)
        words += line.split()
        if len(words) - before >= ANCHOR_WINDOW:
            lines.append(len(words))
    if not words:
        return words, []
    fixed = np.unique(np.array([*lines, len(words)], np.int64))
    if len(words) < ANCHOR_WINDOW:
        return words, fixed.tolist()
    checks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    windows = np.lib.stride_tricks.sliding_window_view(checks, ANCHOR_WINDOW)
    # The rightmost least one: the first from the back.
    last = ANCHOR_WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    ends = np.unique(np.arange(len(windows)) + last + 1)
    ends = ends[np.diff(ends, append=len(words) + LEAST_UNIT) >= LEAST_UNIT]
    near = np.searchsorted(fixed, ends - LEAST_UNIT, side="right")
    ends = ends[np.abs(fixed[np.minimum(near, len(fixed) - 1)] - ends) >= LEAST_UNIT]
    return words, np.union1d(ends, fixed).tolist()


def digests(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first word, number of words, digest of the words joined by one blank) of every unit of a text."""
    words, ends = units(text)
    return [(a, b - a, xxhash.xxh3_128_digest(b" ".join(words[a:b]))[:_HALVES.itemsize]) for a, b in zip([0, *ends], ends)]


def _with_own(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text): rows without an id are told apart by their text, so that they are no group."""
    text = octets()
    return docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(0).alias("own"), text.alias("text"))


def unit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, own, no, hi, lo) of every unit, from (doc_id, own, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, nos, found = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                listed = digests(text)
                at += [i] * len(listed)
                nos += range(len(listed))
                found += [d for _, _, d in listed]
            halves = np.frombuffer(b"".join(found), _HALVES)
            at = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("own").take(at), pa.array(nos, pa.int32()), pa.array(halves["hi"].copy()), pa.array(halves["lo"].copy())],
                ["doc_id", "own", "no", *_DIGEST])
        return each

    return map_slices(docs, "text", "doc_id long, own long, no int, hi long, lo int", make)


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, own, units): the units (no, hi, lo, first_id) of a document that are not the first of their digest.

    The first is that of the smallest doc_id, rows without one coming last, and there the earliest.
    Units are computed twice rather than kept, and only digests move.
    """
    found = unit_digests(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "no")
    first = found.groupBy(*_DIGEST).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A digest may be that of a very common passage: a plain merge join, whose large keys Spark splits.
    later = found.join(first.hint("merge"), _DIGEST).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own")) & (F.col("no") == F.col("first.no"))))
    return later.groupBy("doc_id", "own").agg(F.collect_list(F.struct(
        "no", *_DIGEST, F.col("first.doc_id").alias("first_id"))).alias("units"))


def removed_spans(text: bytes, repeated: dict[tuple[int, bytes], int | None], least_run: int) -> tuple[int, list[tuple[int, int, set]]]:
    """(number of units, spans (start, end, first ids) to remove): runs of repeated units of least_run words
    or more; in bytes, from the first word to the last."""
    listed = digests(text)
    runs: list[tuple[int, int, set]] = []
    first = last = None
    words, ids = 0, set()

    def close() -> None:
        if first is not None and words >= least_run:
            runs.append((listed[first][0], listed[last][0] + listed[last][1] - 1, ids))

    for no, (_, n, digest) in enumerate(listed if repeated else ()):
        if (no, digest) in repeated:
            if first is None:
                first, words, ids = no, 0, set()
            last = no
            words += n
            ids.add(repeated[no, digest])
        else:
            close()
            first = None
    close()
    if not runs:
        return len(listed), []
    places = [m.span() for m in _WORD.finditer(text)]
    return len(listed), [(places[a][0], places[b][1], found) for a, b, found in runs]


def _found(marked: list[dict] | None) -> dict[tuple[int, bytes], int | None]:
    return {(u["no"], np.array((u["hi"], u["lo"]), _HALVES).tobytes()): u["first_id"] for u in marked or ()}


def dedup_substrings(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, n_units, n_removed, removed, first_ids, text): every document without passages that came before.

    removed lists the removed spans (start, end) in code points of the original text, first_ids the
    documents that keep them, text is what is left. n_removed counts the spans. A null text is
    empty. Rows of one doc_id are one document, and so are rows without an id of one text; these come last. Equal texts lose all but the
    smallest doc_id's if they have least_run words. Other columns are not looked at; an empty table gives an empty result.
    """
    texts = _with_own(docs)
    marks = repeated_units(texts)
    joined = texts.alias("l").join(marks.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.own") == F.col("r.own")), "left").select(
        "l.doc_id", "text", "units")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, marked in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist()):
                n, spans = removed_spans(text, _found(marked), least_run)
                chars, kept, at = [], [], 0
                for a, b, _ in spans:
                    kept.append(text[at:a])
                    before = len(text[:a].decode(errors="replace")) if not chars else chars[-1]["end"] + len(text[at:a].decode(errors="replace"))
                    chars.append({"start": before, "end": before + len(text[a:b].decode(errors="replace"))})
                    at = b
                kept.append(text[at:])
                ids = sorted({i for s in spans for i in s[2] if i is not None})
                rows.append((n, len(spans), chars, ids, b"".join(kept)))
            n, k, spans, ids, left = map(list, zip(*rows)) if rows else ([],) * 5
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(ids, pa.list_(pa.int64())), pa.array(left, pa.binary())],
                ["doc_id", "n_units", "n_removed", "removed", "first_ids", "text"])
        return each

    schema = ("doc_id long, n_units long, n_removed long, removed array<struct<start long, end long>>, "
              "first_ids array<long>, text binary")
    return map_slices(joined, "text", schema, make).withColumn("text", F.col("text").cast("string"))
