import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files as sources
from corpusloom.staging import shared_dir, stage
from tests.helpers import corpus


def build(root):
    for path, data in {"p0/src/a.ts": b"a", "p0/.gitignore": b"x\n", "p0/src/__init__.py": b"", "p0/.hid/k": b"\xff\x00",
                       "p1/b": b"bb", "loose": b"1"}.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    os.symlink(root / "p0/src/a.ts", root / "p0/link.ts")
    os.symlink(root / "p0/src", root / "p0/linked")


def test_ingest_reads_hidden_names_and_skips_links(spark, tmp_path):
    build(tmp_path)
    projects = spark.createDataFrame([("p0",), ("p1",), ("missing",)], "project string")
    rows = sources.ingest(spark, str(tmp_path), projects).collect()
    assert sorted((r.project, r.path, bytes(r.content), r.size) for r in rows) == [
        ("p0", ".gitignore", b"x\n", 2), ("p0", ".hid/k", b"\xff\x00", 2), ("p0", "src/__init__.py", b"", 0),
        ("p0", "src/a.ts", b"a", 1), ("p1", "b", b"bb", 2)]


def test_large_files_are_left_out_by_their_listed_size(spark, tmp_path):
    build(tmp_path)
    (tmp_path / "p1/huge").touch()
    os.truncate(tmp_path / "p1/huge", 1 << 40)
    projects = spark.createDataFrame([("p1",)], "project string")
    rows = sources.ingest(spark, tmp_path.as_uri(), projects, max_file_kb=500).collect()
    assert [(r.path, r.size) for r in rows] == [("b", 2)]


def test_binary_file_source(spark, tmp_path):
    (tmp_path / "p0/src").mkdir(parents=True)
    (tmp_path / "p0/src/a.ts").write_bytes(b"abc")
    rows = sources.read_binary_files(spark, str(tmp_path)).collect()
    assert [(r.project, r.path, bytes(r.content), r.size) for r in rows] == [("p0", "src/a.ts", b"abc", 3)]


def test_files_table_with_a_stored_binary_flag(spark, tmp_path):
    made = sources.with_binary_flag(corpus(spark, {"a": b"x\0", "b": b"y"}))
    made.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.path: r.is_binary for r in back.collect()} == {"a": True, "b": False}
    plain = sources.read_files_table(spark, str(tmp_path / "t"))
    assert plain.columns == ["project", "path", "content", "size"]


def test_size_filter_reaches_the_scan(spark, tmp_path):
    from corpusloom.operators.process import process
    from corpusloom.spec import Format
    corpus(spark, {"a": "x"}).write.parquet(str(tmp_path / "t"))
    files = sources.read_files_table(spark, str(tmp_path / "t")).withColumn("reason", F.lit("r"))
    plan = process(files, Format())._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,512000)" in plan


def test_staged_rows_are_read_back_by_column(spark):
    staged = stage(spark.range(10).withColumn("wide", F.repeat(F.lit("x"), 100)))
    plan = staged.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert staged.count() == 10
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


class Failing:
    def __init__(self, error):
        self.error = error

    def open_input_file(self, path):
        raise self.error


def test_only_missing_or_forbidden_files_have_no_row(monkeypatch):
    batch = pd.DataFrame({"project": ["p"], "path": ["a"]})
    for error in (FileNotFoundError("gone"), PermissionError("forbidden")):
        monkeypatch.setattr(sources, "opened", lambda root, error=error: (Failing(error), root))
        assert list(sources._read_contents("/r")([batch])) == []
    monkeypatch.setattr(sources, "opened", lambda root: (Failing(TimeoutError("slow store")), root))
    with pytest.raises(TimeoutError):
        list(sources._read_contents("/r")([batch]))
