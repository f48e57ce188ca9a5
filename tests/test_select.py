from dataclasses import dataclass

import pytest

from pyspark.sql import functions as F

from corpusloom.operators import select
from corpusloom.spec import (DependencyScan, ExportSpec, Filters, FolderScan, FullScan, Output, PatternScan)
from tests.helpers import PLAIN, corpus

TREE = {"src/app/index.ts": 'console.log("app");', "src/app/util.ts": "export const a = 1;", "config.json": "{}"}


def picked(files, scan, filters=PLAIN):
    return sorted((r.path, r.reason) for r in select.scan_refs(files, 0, scan, filters).collect())


def test_full_scan(spark):
    files = corpus(spark, TREE)
    got = picked(files, FullScan("full-test"), Filters(exclude=("**/config.json",), respect_gitignore=False))
    assert got == [("src/app/index.ts", "Full strategy: full-test"), ("src/app/util.ts", "Full strategy: full-test")]
    assert picked(files, FullScan("f", root="missing")) == []
    assert [p for p, _ in picked(files, FullScan("f", root="src"))] == ["src/app/index.ts", "src/app/util.ts"]
    assert picked(files, FullScan("f", root="../x")) == []


def test_pattern_scan(spark):
    assert picked(corpus(spark, TREE), PatternScan("pattern-test", ("**/*.json",))) == [
        ("config.json", "Pattern match: pattern-test")]


def test_folder_scan(spark):
    files = corpus(spark, TREE)
    assert len(picked(files, FolderScan("f", ("src/app",), extensions=(".ts",)))) == 2
    assert picked(files, FolderScan("f", ("src/app",), max_depth=0)) == []
    assert picked(files, FolderScan("f", ("src",), recursive=False)) == []
    assert len(picked(files, FolderScan("f", ("src",), max_depth=2))) == 2
    assert picked(files, FolderScan("f", ("none", "config.json"), extensions=(".ts",), exclude=("*.json",))) == [
        ("config.json", "Folder file: f")]
    # Two targets hold the file; the first one gives the reason.
    assert picked(files, FolderScan("f", ("./", "config.json"), extensions=(".json",))) == [("config.json", "Folder files: f")]


def test_extension_list_is_taken_as_given(spark):
    files = corpus(spark, {"a.TS": "", "b.ts": "", ".bashrc": ""})
    assert [p for p, _ in picked(files, FullScan("f", extensions=(".ts",)))] == ["a.TS", "b.ts"]
    assert picked(files, FullScan("f", extensions=(".TS",))) == []


def test_binary_detection_looks_at_8192_bytes(spark):
    files = corpus(spark, {"in": b"a" * 8191 + b"\0", "out": b"a" * 8192 + b"\0", "empty": b""})
    filters = Filters(exclude=(), respect_gitignore=False)
    assert [p for p, _ in picked(files, FullScan("f"), filters)] == ["empty", "out"]
    # Only the full scan sniffs.
    assert len(picked(files, PatternScan("p", ("**/*",)), filters)) == 3


def test_first_strategy_wins(spark):
    files = corpus(spark, TREE)
    scans = [(0, FolderScan("a", ("src/app",))), (1, PatternScan("b", ("**/*.json",))), (2, FullScan("c"))]
    rows = select.collect_files(files, scans, PLAIN).collect()
    assert sorted((r.path, r.strategy) for r in rows) == [
        ("config.json", "b"), ("src/app/index.ts", "a"), ("src/app/util.ts", "a")]
    united = select.scan_refs(files, 2, scans[2][1], PLAIN).unionByName(select.scan_refs(files, 0, scans[0][1], PLAIN))
    assert sorted((r.path, r.strategy_idx) for r in select.first_wins(united).collect()) == [
        ("config.json", 2), ("src/app/index.ts", 0), ("src/app/util.ts", 0)]


def test_row_wise_scans_do_not_shuffle(spark):
    files = corpus(spark, TREE)
    scans = [(0, FolderScan("a", ("src/app",))), (1, PatternScan("b", ("**/*.json",))), (2, FullScan("c"))]
    plan = select.collect_files(files, scans, PLAIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_strategy_of_ones_own(spark):
    @dataclass(frozen=True)
    class LargeScan:
        name: str
        least: int
        type: str = "large"

    with pytest.raises(ValueError, match="type"):
        ExportSpec(strategies=(LargeScan("big", 2),))
    select.register_strategy(LargeScan, lambda scan, filters, columns: (F.col("size") >= scan.least, F.lit(f"Large: {scan.name}")))
    spec = ExportSpec(strategies=(LargeScan("big", 2), FullScan("rest")))
    found = select.collect_files(corpus(spark, {"a": "x", "b": "xyz"}), spec.selected(), PLAIN).collect()
    assert sorted((r.path, r.reason) for r in found) == [("a", "Full strategy: rest"), ("b", "Large: big")]


def test_strategies_by_name():
    spec = ExportSpec(strategies=(FullScan("a"), FullScan("b"), FullScan("c")))
    assert [s.name for _, s in spec.selected(["c", "a", "zzz"])] == ["a", "c"]
    assert len(spec.selected([])) == 3


@pytest.mark.parametrize("options, place", [
    ({"output": Output(mode="both")}, "output.mode"),
    ({"output": Output(group_by="size")}, "output.group_by"),
    ({"strategies": (FullScan(""),)}, "strategies[0].name"),
    ({"strategies": (PatternScan("p"),)}, "strategies[0].patterns"),
    ({"strategies": (FolderScan("p"),)}, "strategies[0].paths"),
    ({"strategies": (FullScan("a"), DependencyScan("d"))}, "strategies[1].entry"),
    ({"strategies": (FullScan("a", type="half"),)}, "strategies[0].type"),
])
def test_bad_settings(options, place):
    with pytest.raises(ValueError, match=place.replace("[", r"\[").replace("]", r"\]")):
        ExportSpec(**options)
