import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import member, select
from corpusloom.spec import Filters, FullScan
from tests.helpers import corpus


@pytest.fixture
def filters_only(spark, monkeypatch):
    """Small filters with many wrong answers, and no broadcast but theirs."""
    monkeypatch.setattr(member, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("per_block, most", [(32, 8), (150, 8), (400, 3)])
def test_membership_is_exact(filters_only, monkeypatch, per_block, most):
    monkeypatch.setattr(member, "KEYS_PER_BLOCK", per_block)
    monkeypatch.setattr(member, "MOST_FILTERS", most)
    rng = random.Random(per_block)
    rows = [(f"p{rng.randrange(3)}", f"f{i}", i) for i in range(4000)]
    table = filters_only.createDataFrame(rows, "project string, path string, v int")
    chosen = table.where("v % 3 = 1").select("project", "path")
    got = member.with_member(table, chosen, ["project", "path"], "flag").collect()
    assert len(got) == len(rows) and all(r.flag == (r.v % 3 == 1) for r in got)


def test_a_filter_hits_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    blocks = member._blocks(20_000)
    bits = member.build(keys, ["k"], 3, blocks)
    asked = spark.range(60_000).select(F.col("id").cast("string").alias("k"), "id")
    hit = {r.id: r._hit for r in member.with_hit(asked, bits, ["k"], 3, blocks, "_hit").collect()}
    assert all(hit[i] for i in range(20_000)) and sum(hit[i] for i in range(20_000, 60_000)) < 400


def test_no_members(spark):
    rows = spark.range(5).select(F.col("id").cast("string").alias("k"))
    assert {r.flag for r in member.with_member(rows, rows.limit(0), ["k"], "flag").collect()} == {False}


def test_contents_of_a_full_scan_are_not_moved(filters_only):
    trees = [{".gitignore": "*.log\nsub/\n!keep.log", **{f"{d}/f{i}.{e}": "x" for d in ("a", "sub") for i in range(12) for e in ("log", "ts")},
              "keep.log": "y"} for _ in range(3)]
    files = corpus(filters_only, *trees)
    found = select.collect_files(files, [(0, FullScan("all"))], Filters(exclude=()))
    assert {(r.project, r.path) for r in found.collect()} == {
        (f"p{i}", p) for i in range(3) for p in trees[i] if not p.startswith("sub/") and (not p.endswith(".log") or p == "keep.log")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "content" in plan
