"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
# The open scopes of this thread of work; another one's tables are not ours to remove.
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set(_CONF, made)
    return made


def stage(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back.

    Later uses see the same rows (also after an executor is lost), start from a
    short lineage, and read only the columns they need.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    for scope in _open_scopes.get():
        scope.append(target)
    df.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def stage_clustered(df: DataFrame, keys: list[str], sent: bool = True, buckets: int | None = None, ordered: bool = False) -> DataFrame:
    """Like stage(), with the rows of equal keys in one bucket of a bucketed table, so that joins and aggregates by these
    keys do not move them. The entry in the catalog is only needed to write and open the table and is dropped at once.

    With sent the rows of a bucket are sent to one task that writes it; without, each task writes its own part of
    every bucket that it has rows of, and no row is moved. Tables that meet in joins need the same number of buckets (that of
    shuffle partitions if not given); ordered ones are sorted by the keys in each bucket file.
    """
    spark = df.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    target = f"{shared_dir(spark).rstrip('/')}/{name.replace('_', '-')}"
    for scope in _open_scopes.get():
        scope.append(target)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, *keys) if sent else df
    writer = rows.write.bucketBy(n, *keys)
    if ordered:
        writer = writer.sortBy(*keys)
    (writer.option("path", target).option("compression", "zstd").format("parquet").saveAsTable(name))
    table = spark.table(name)
    # A table with a path of its own leaves its files where they are.
    spark.sql(f"drop table {name}")
    return table


@contextmanager
def staged_tables(spark: SparkSession):
    """Remove the tables staged inside the block when it ends; yields stage() for those to keep."""
    scope: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        table = stage(df)
        kept.append(scope[-1])
        return table

    token = _open_scopes.set((*_open_scopes.get(), scope))
    try:
        yield keep
    finally:
        _open_scopes.reset(token)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for name in set(scope) - set(kept):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)
