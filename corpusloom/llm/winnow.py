"""Document fingerprints by winnowing, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.rows import BLANKS

GRAM = 4
WINDOW = 8
# A packed gram is 32 bits of hash above 31 bits that fall as the position rises: arrays have fewer than
# 2^31 entries, so the position always fits, and the least value is the least hash, rightmost on ties.
_POSITION_BITS = 31
_LAST = (1 << _POSITION_BITS) - 1
ROWS_PER_CHUNK = 200_000
LEAST_CHUNKS = 64


def _folded(df: DataFrame, column: str, span: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Replace an array by its runs of `span` neighbours, each joined into one value, in log2(span) passes.

    Every pass is a projection of its own, so that no array is computed twice. Where too few
    values are left for a pass they stay as they are, that is as shorter runs.
    """
    done = 1
    while done < span:
        step = min(done, span - done)
        a, n = F.col(column), F.size(column)
        joined = F.zip_with(F.slice(a, F.lit(1), n - step), F.slice(a, F.lit(step + 1), n - step), join)
        df = df.withColumn(column, F.when(n > step, joined).otherwise(a))
        done += step
    return df


def winnow(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the packed fingerprint of a text column: array<long>, in text order, a value per selected gram.

    Words (white space apart, lower case) are hashed once, the hash of a gram of `gram` words is joined
    from those of its halves. Of every `window` neighbouring grams the one of least hash is
    selected, the rightmost on ties, so two texts that share gram + window - 1 words in a row
    share a hash. A text of fewer words has shorter grams and windows; one without words, or null, has none.
    """
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    df = df.withColumn(out, words)
    df = df.withColumn(out, F.transform(F.filter(out, lambda w: w != ""), lambda w: F.xxhash64(w)))
    df = _folded(df, out, gram, lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(out, F.transform(out, lambda g, i: F.shiftleft(
        g.bitwiseAND(F.lit((1 << 32) - 1)), _POSITION_BITS).bitwiseOR(F.lit(_LAST) - i)))
    df = _folded(df, out, window, lambda a, b: F.least(a, b))
    return df.withColumn(out, F.array_distinct(out))


def entries(packed: str) -> Column:
    """A packed fingerprint as array<struct<hash, position>>; positions count words from 0."""
    return F.transform(packed, lambda x: F.struct(
        F.shiftright(x, _POSITION_BITS).alias("hash"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int").alias("position")))


def hashes(packed: str) -> Column:
    """The different hashes of a packed fingerprint."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, _POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of different hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def digest(packed: str) -> Column:
    """128 bits of a fingerprint, positions included, as hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(packed), F.xxhash64(F.lit(1), packed))))


def _place(value: str, cuts: list[int]) -> Column:
    """Number of cuts (ascending) below a value, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    held = F.lit(cuts)
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.element_at(held, F.least(at + step, F.lit(len(cuts)))) < F.col(value)), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def in_order(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """(doc_id, text, chunk, after): the documents dealt by ranges of doc_id, each range in one place.

    The first documents of a range come a second time, with after = 1, in the range before (those of the
    first range in the last), so a row's successor never lies elsewhere. Texts are shuffled once.
    Only range ends and first ids pass the driver, one for ROWS_PER_CHUNK documents.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if chunks is None:
        chunks = max(LEAST_CHUNKS, docs.count() // ROWS_PER_CHUNK)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / chunks for i in range(1, chunks)], 10 * chunks)).first()[0] if chunks > 1 else []
    placed = docs.withColumn("chunk", _place("doc_id", sorted(set(cuts or []))))
    heads = sorted(placed.groupBy("chunk").agg(F.min(F.struct("doc_id")).alias("head")).collect())
    ranges = [(r.chunk, heads[i - 1].chunk, r.head.doc_id) for i, r in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(ranges, "chunk int, before int, head long")
    twice = placed.join(F.broadcast(first), "chunk", "left").withColumn("at", F.explode(F.when(
        F.col("doc_id").eqNullSafe(F.col("head")),
        F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("after")), F.struct(F.col("before").alias("chunk"), F.lit(1).alias("after")))
    ).otherwise(F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("after"))))))
    return twice.select("doc_id", "text", "at.chunk", "at.after").repartition("chunk")


def fingerprint_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, chunks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): fingerprints of
    every text, of its edited text and the likeness to that and to the next document's.

    The edited text has the first code points of the next document, by ascending doc_id, in place of
    the last half; the last document is followed by the first. Rows without a doc_id come first; rows of one doc_id
    follow each other by text, so equal rows are each other's next. A null text is empty. A single
    document is its own next one, an empty table gives an empty result.
    """
    own = winnow(in_order(docs, chunks), "text", "fp", gram, window)
    then = Window.partitionBy("chunk").orderBy("after", "doc_id", "text")
    rows = (own.withColumn("next", F.lead("text").over(then)).withColumn("next_fp", F.lead("fp").over(then))
            .where("after = 0").withColumn("n_chars", F.char_length("text").cast("long")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    rows = winnow(rows.select("doc_id", "n_chars", "edited", "fp", "next_fp"), "edited", "edited_fp", gram, window)
    rows = rows.select("*", hashes("fp").alias("_a"), hashes("edited_fp").alias("_b"), hashes("next_fp").alias("_c"))
    return rows.select("doc_id", "n_chars", "edited", F.col("fp").alias("fingerprint"),
                       F.col("edited_fp").alias("edited_fingerprint"),
                       likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"))
