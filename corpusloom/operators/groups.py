"""Keys and file names of grouped exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import numbered


def group_key(by: str | Column) -> Column:
    """reason, strategy, folder (first segment, or root), or any Column of the caller."""
    if isinstance(by, Column):
        return by
    if by in ("reason", "strategy"):
        value = F.coalesce(F.col(by), F.lit(""))
        return F.when(value == "", "default").otherwise(value)
    if by == "folder":
        parts = F.split("path", "/")
        return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit("root"))
    return F.lit("custom")


def safe_name(key: Column) -> Column:
    # JavaScript counts UTF-16 units, so a character beyond the BMP becomes two underscores.
    wide = F.regexp_replace(key, r"[\x{10000}-\x{10FFFF}]", "__")
    return F.regexp_replace(wide, "[^a-zA-Z0-9_-]", "_")


def group_files(keyed: DataFrame) -> DataFrame:
    """(project, group_key, file_name), one row per group.

    Keys that clean up to the same name are told apart by ~2, ~3, ... in key order;
    '~' never occurs in a cleaned name.
    """
    groups = keyed.select("project", "group_key").distinct().withColumn("_safe", safe_name(F.col("group_key")))
    ranked = numbered(groups, ["project", "_safe"], [F.col("group_key")], "_rank")
    suffix = F.when(F.col("_rank") == 1, "").otherwise(F.concat(F.lit("~"), F.col("_rank").cast("string")))
    return ranked.select("project", "group_key", F.concat("_safe", suffix, F.lit(".txt")).alias("file_name"))
