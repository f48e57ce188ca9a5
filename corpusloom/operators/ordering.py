"""Positions and joins that do not depend on how even the keys are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import stage

SALTS = 16


def path_order(path: str = "path") -> list[Column]:
    """Locale order of paths; ties by bytes, so that the order is total."""
    return [F.collate(F.col(path), "UNICODE"), F.col(path)]


def spread_join(rows: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner",
                salt_by: str = "path") -> DataFrame:
    """Join rows with a table of one row per key, when one key may own a third of the rows.

    Rows of a key go to SALTS join buckets and the dim row is repeated for each. No hint is
    given: if Spark finds the dim side small enough it broadcasts, else it sorts and merges.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def in_chunks(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partitioned, sorted and staged rows with _chunk and _seq.

    (keys, _chunk) is a piece of one key that fits a partition, and _seq counts
    without gaps inside it, because the rows of a key are neighbours.
    """
    by = [F.col(k) for k in keys] + order
    return stage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )


def chunk_bases(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, _chunk): its first _seq and the number of rows of the key before it.

    The window runs over one row per chunk, never over the rows themselves.
    """
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *keys, "_chunk", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def positions(chunked: DataFrame, keys: list[str], name: str = "ord") -> DataFrame:
    """1-based position of every row in its key."""
    return (
        chunked.join(chunk_bases(chunked, keys), [*keys, "_chunk"])
        .withColumn(name, (F.col("_before") + F.col("_seq") - F.col("_first") + 1).cast("long"))
        .drop("_first", "_before")
    )


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "ord") -> DataFrame:
    return positions(in_chunks(rows, keys, order), keys, name).drop("_chunk", "_seq")
