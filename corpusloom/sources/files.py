"""Sources of the files table (project, path, content, size)."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import norm_path
from corpusloom.operators.select import is_binary
from corpusloom.schemas import FILES, LISTING
from corpusloom.staging import stage

_BATCH_BYTES = 64 * 1024 * 1024


def read_files_table(spark: SparkSession, path: str) -> DataFrame:
    """A prepared Parquet table; the usual source of large corpora."""
    return spark.read.schema(FILES).parquet(path)


def with_binary_flag(files: DataFrame) -> DataFrame:
    """Store the NUL test once, so that later selections need not read content."""
    return files.withColumn("is_binary", is_binary(F.col("content")))


def read_binary_files(spark: SparkSession, root: str, project: Column | None = None) -> DataFrame:
    """Spark's binaryFile source. It skips names that start with '.' or '_': use ingest() where
    those matter. By default the first folder below root is the project."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    marker = root.rstrip("/") + "/"
    below = F.substring_index("path", marker, -1)
    owner = project if project is not None else F.substring_index(below, "/", 1)
    inner = below if project is not None else F.regexp_replace(below, "^[^/]*/", "")
    return raw.select(owner.alias("project"), norm_path(inner).alias("path"), "content",
                      F.col("length").alias("size"))


def opened(root: str):
    """(file system, path on it) of a root URI or plain path; anything pyarrow can open, made anew in every task."""
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root.removeprefix("file:")


def _list_dirs(root: str, max_kb: float):
    def run(batches):
        system, base = opened(root)
        most = int(max_kb * 1024) if max_kb else None
        for batch in batches:
            for project, folder in zip(batch["project"], batch["path"]):
                here = "/".join(p for p in (base.rstrip("/"), project, folder) if p)
                found = []
                for e in system.get_file_info(pafs.FileSelector(here, allow_not_found=True)):
                    # A file that went away meanwhile, or is neither a file nor a folder, has no row.
                    is_dir = e.type == pafs.FileType.Directory
                    if not is_dir and e.type != pafs.FileType.File:
                        continue
                    if isinstance(system, pafs.LocalFileSystem) and os.path.islink(e.path):
                        continue
                    size = 0 if is_dir else e.size
                    if most is not None and size > most:
                        continue
                    found.append((project, f"{folder}/{e.base_name}" if folder else e.base_name, is_dir, size))
                    if len(found) >= 50_000:
                        yield pd.DataFrame(found, columns=LISTING.names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=LISTING.names)
    return run


def _read_contents(root: str):
    def run(batches):
        system, base = opened(root)
        for batch in batches:
            rows, held = [], 0
            for project, path in zip(batch["project"], batch["path"]):
                try:
                    with system.open_input_file("/".join((base.rstrip("/"), project, path))) as f:
                        data = f.read()
                except (FileNotFoundError, PermissionError):
                    continue  # a file that is gone or forbidden has no row; after other errors Spark tries again
                rows.append((project, path, data, len(data)))
                held += len(data)
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=FILES.names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=FILES.names)
    return run


def ingest(spark: SparkSession, root: str, projects: DataFrame, max_file_kb: float = 0) -> DataFrame:
    """Read project trees below root, a path or URI of a file system that every executor reaches.

    projects (project) names folders below root. Folders are listed level by level, each
    level spread over the tasks, so neither the driver nor one task walks a whole project. Files of
    more than max_file_kb are left out by their listed size and never opened; 0 takes all.
    """
    folders = projects.select("project", F.lit("").alias("path"))
    listed = None
    while True:
        found = stage(folders.repartition("project", "path").mapInPandas(_list_dirs(root, max_file_kb), LISTING))
        level = found.where("not is_dir")
        listed = level if listed is None else listed.unionByName(level)
        folders = found.where("is_dir").select("project", "path")
        if folders.isEmpty():
            break
    return listed.select("project", "path").repartition("project", "path").mapInPandas(_read_contents(root), FILES)
