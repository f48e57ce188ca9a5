"""The directory tree of a set of paths, one row per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import base_name, parent_dir, prefixes
from corpusloom.operators.ordering import numbered, spread_join
from corpusloom.staging import stage

# How branches are drawn.
_LAST, _MORE = "└── ", "├── "
_LAST_BELOW, _MORE_BELOW = "    ", "│   "


def tree_nodes(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, parent, line): a line for every folder and file.

    Only distinct folders are spelled out level by level. The last child of a folder is
    a maximum, which merges before the shuffle, so a flat folder of any size is fine.
    """
    paths = files.select(*keys, "path")
    folders = paths.select(*keys, parent_dir(F.col("path")).alias("dir")).where("dir <> ''").distinct()
    nodes = (
        paths.select(*keys, F.col("path").alias("node"))
        .unionByName(folders.select(*keys, F.explode_outer(prefixes(F.col("dir"))).alias("node")))
        .distinct()
        .withColumn("parent", parent_dir(F.col("node")))
        .withColumn("name", base_name(F.col("node")))
    )
    last = stage(nodes.groupBy(*keys, "parent").agg(F.max("name").alias("last_name")))
    # How far the lines below a folder are indented: one flag per level of the folder itself.
    levels = last.where("parent <> ''").select(
        *keys, F.col("parent").alias("dir"), F.posexplode_outer(prefixes(F.col("parent"))).alias("level", "step"))
    flags = spread_join(
        levels.withColumn("parent", parent_dir(F.col("step"))), last, [*keys, "parent"], "inner", "dir"
    ).select(*keys, "dir", "level", F.when(base_name(F.col("step")) == F.col("last_name"), _LAST_BELOW)
             .otherwise(_MORE_BELOW).alias("bar"))
    indents = flags.groupBy(*keys, "dir").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "bar"))), lambda s: s["bar"]), "")
        .alias("indent"))
    above = last.join(indents.withColumnRenamed("dir", "parent"), [*keys, "parent"], "left").select(
        *keys, "parent", "last_name", F.coalesce("indent", F.lit("")).alias("indent"))
    return spread_join(nodes, above, [*keys, "parent"], "inner", "node").select(
        *keys, "node", "parent",
        F.concat("indent", F.when(F.col("name") == F.col("last_name"), _LAST).otherwise(_MORE), "name").alias("line"))


def tree_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, line) of the lines below the heading, in print order."""
    nodes = tree_nodes(files, keys).withColumn("_by", F.split("node", "/"))
    return numbered(nodes, keys, [F.col("_by")], "line_no").select(*keys, "line_no", "line")
