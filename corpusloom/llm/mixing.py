"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts, epochs. No Python rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.rows import WORD, unused
from corpusloom.operators.ordering import in_chunks, numbered
from corpusloom.staging import stage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def words(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """Hash-random key of a document; rows of one id share it."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the size of all
    by them. A target stops at max_epochs times its source; the excess goes to the others by
    weight until none is above. Each round is one sum over the table of sources.
    """
    # A constant name order makes null last; pre-aggregation leaves one row per source and task.
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(per_source.withColumn("_all", F.lit(0)), ["_all"],
                       [F.col("source").isNull(), F.col("source")], "_pos")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(ordered.select("source", "source_size", turn.alias("weight")))
    limit = F.col("source_size") * max_epochs
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = 0.0, -1
    while True:
        capped = limit < F.lit(level) * F.col("weight") if capped_before >= 0 else F.lit(False)
        n, held, free = table.agg(
            F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == capped_before or not free:
            break
        level, capped_before = (total - held) / free, n
    return table.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, cut_key) from staged rows (source, size, key).

    A source gives all its documents `epochs` times and those with a key up to cut_key once
    more. In key order a document belongs to the last epoch if at least half of it lies within
    the budget, so a source ends within half a document of its target. cut_key is null if the
    last epoch is empty.
    """
    targets = stage(source_targets(rows, weights, max_epochs).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    chunked = in_chunks(rows.where("size > 0").select("source", "key", "size"), ["source"], [F.col("key"), F.col("size")])
    sums = chunked.groupBy("source", "_chunk").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = chunked.withColumn("_upto", F.sum("size").over(within))
    keyed = F.col("l.source").eqNullSafe(F.col("r.source"))
    # Only the chunk in which the budget ends has to be searched; earlier ones lie below the cut.
    ends = bases.alias("l").join(targets.alias("r"), keyed).where("_base < rest").select(
        F.col("l.source").alias("source"), "_chunk", "_base", "rest")
    at = F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l._chunk") == F.col("r._chunk"))
    cut = (last.alias("l").join(ends.alias("r"), at)
           .where(F.col("_base") * 2 + F.col("_upto") * 2 - F.col("size") <= F.col("rest") * 2)
           .groupBy("l.source").agg(F.max("key").alias("cut_key")))
    return targets.alias("l").join(cut.alias("r"), keyed, "left").select(
        "l.source", "source_size", "target", "epochs", "cut_key")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words().alias("size"), order_key().alias("key"))


def mix_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what the mix takes of every document, in words.

    Null texts have size 0 and are taken 0 times their size. Rows with one doc_id share a key
    and are taken alike; rows without a source are a source of their own. An empty table gives
    an empty result. Texts are read once, all else works on the narrow staged table.
    """
    rows = stage(_sized(docs))
    plan = stage(mix_plan(rows, weights, max_epochs))
    again = F.when(F.col("key") <= F.col("cut_key"), 1).otherwise(0)
    return rows.alias("l").join(plan.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "doc_id", "l.source", "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + again)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, with all their columns: a row for each time a document is taken.

    Documents without words have no share and are left out. The plan of a source joins its rows
    by source; Spark splits a source that is too large for a task.
    """
    rows = stage(_sized(docs).select("source", "size", "key"))
    plan = stage(mix_plan(rows, weights, max_epochs).select(
        F.col("source").alias("_mix_source"), F.col("epochs").alias("_mix_epochs"), F.col("cut_key").alias("_mix_cut")))
    plan = plan.toDF(*(unused(c, docs) for c in plan.columns))
    source, epochs, cut = plan.columns
    copies = F.col(epochs) + F.when(order_key() <= F.col(cut), 1).otherwise(0)
    copy = unused("_mix_copy", docs, plan)
    return (docs.where(words() > 0).join(plan, docs["source"].eqNullSafe(plan[source]))
            .withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int")))))
            .select(*docs.columns))
