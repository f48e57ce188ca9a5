import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pack
from corpusloom.operators.ordering import numbered, path_order, spread_join


@pytest.fixture
def many_chunks(spark):
    """Keep all range partitions, so that a project is cut into several chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def greedy(sizes, budget, preamble=None):
    """One file after the other."""
    part, fill, empty = 1, preamble or 0, preamble is None
    parts = []
    for size in sizes:
        if not empty and fill + size > budget:
            part, fill = part + 1, 0
        fill, empty = fill + size, False
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed", range(4))
def test_parts_equal_the_sequential_rule(many_chunks, seed):
    spark, rng = many_chunks, random.Random(seed)
    budget = rng.choice([10, 50, 300])
    # The first project holds most rows and spans many chunks; some files exceed the budget.
    sizes = {"hot": 1500, "small": 7, "one": 1, "mid": 200}
    rows, want, starts = [], {}, []
    for project, n in sizes.items():
        tokens = [rng.choice([1, 2, 5, rng.randint(1, budget), budget, budget + 3]) for _ in range(n)]
        rows += [(project, f"f{i:05d}", t) for i, t in enumerate(tokens)]
        first = rng.choice([None, 1, budget, budget * 3]) if project != "hot" else 4
        if first is not None:
            starts.append((project, first))
        for i, part in enumerate(greedy(tokens, budget, first)):
            want[project, f"f{i:05d}"] = (i + 1, part)
    rng.shuffle(rows)
    files = spark.createDataFrame(rows, "project string, path string, tokens long")
    preamble = spark.createDataFrame(starts, "project string, tokens long")
    got = pack.pack_parts(files, budget, path_order(), preamble).collect()
    assert {(r.project, r.path): (r.ord, r.part) for r in got} == want
    assert len(got) == len(want)


def applied(function, fill, budget):
    total, fits, ends, opened = function
    at = pack._first_start(fits, fill, budget)
    return (int(ends[at]), int(opened[at])) if at < len(fits) else (fill + total, 0)


def test_functions_compose_in_any_tree():
    rng = random.Random(5)
    for _ in range(300):
        budget = rng.choice([3, 20, 100, 5000])
        chunks = [np.array([rng.choice([1, 2, rng.randint(1, budget + 5)]) for _ in range(rng.randint(1, 9))]) for _ in range(rng.randint(1, 9))]
        nodes = [pack._steps(c, budget) for c in chunks]
        while len(nodes) > 1:
            at = rng.randrange(len(nodes) - 1)
            nodes[at:at + 2] = [pack._then(*nodes[at:at + 2], budget)]
        tokens = [int(t) for c in chunks for t in c]
        for fill in {-1, 0, 1, budget - 1, budget, budget + 7, rng.randint(0, budget)}:
            parts = greedy(tokens, budget, None if fill < 0 else fill)
            last = [t for t, p in zip(tokens, parts) if p == parts[-1]]
            first = 0 if fill < 0 else 1
            end = sum(last) + (fill if parts[-1] == first else 0)
            assert applied(nodes[0], fill, budget) == (end, parts[-1] - first)
        # Steps are bounded by the budget, whatever the number of chunks.
        assert len(nodes[0][1]) <= budget + 1


def test_very_many_chunks_in_one_project(spark):
    rng = random.Random(6)
    budget, n = 40, 20_000
    tokens = [rng.randint(1, 30) for _ in range(n)]
    table = pd.DataFrame({"project": "p", "idx": np.arange(n, dtype=np.int32)})
    table["total"] = tokens
    steps = {t: pack._steps(np.array([t]), budget) for t in set(tokens)}
    for name, at in (("fits", 1), ("fill", 2), ("opened", 3)):
        table[name] = [steps[t][at].tolist() for t in tokens]
    nodes = spark.createDataFrame(table, f"project string, idx int, {pack._TYPES}").repartition(8)
    start = spark.createDataFrame([("p", -1, 0)], "project string, fill_in long, part_in long")
    got = {r.idx: r for r in pack.chain(nodes, start, budget, n).collect()}
    parts = greedy(tokens, budget)
    assert len(got) == n and [got[i + 1].part_in for i in range(n - 1)] == parts[:-1]


def test_part_properties(many_chunks):
    rng = random.Random(9)
    rows = [("p", f"f{i:04d}", rng.randint(1, 130)) for i in range(900)]
    files = many_chunks.createDataFrame(rows, "project string, path string, tokens long")
    packed = pack.pack_parts(files, 100, path_order())
    sums = packed.groupBy("part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t <= 100 or r.n == 1 for r in sums)
    in_order = sorted(packed.collect(), key=lambda r: r.ord)
    assert [r.path for r in in_order] == [f"f{i:04d}" for i in range(900)]
    assert [r.part for r in in_order] == sorted(r.part for r in in_order)


def test_oversized_preamble_is_a_part_of_its_own(spark):
    files = spark.createDataFrame([("p", "a", 5), ("p", "b", 5)], "project string, path string, tokens long")
    start = spark.createDataFrame([("p", 999)], "project string, tokens long")
    got = pack.pack_parts(files, 10, path_order(), start).collect()
    assert sorted((r.path, r.part) for r in got) == [("a", 2), ("b", 2)]


def test_no_files(spark):
    files = spark.createDataFrame([], "project string, path string, tokens long")
    assert pack.pack_parts(files, 10, path_order()).count() == 0


def test_part_names(spark):
    rows = spark.range(1, 4).select(
        pack.part_file_name("x-{timestamp}.out.txt", "2024-01-02T03:04:05.006Z", F.col("id")).alias("a"),
        pack.part_file_name("plain", "t", F.col("id")).alias("b")).collect()
    assert [r.a for r in rows] == ["x-2024-01-02T03-04-05-006Z.out.txt", "x-2024-01-02T03-04-05-006Z.out-part2.txt",
                                   "x-2024-01-02T03-04-05-006Z.out-part3.txt"]
    assert [r.b for r in rows] == ["plain", "plain-part2", "plain-part3"]


def test_positions_of_a_hot_key(many_chunks):
    rows = [("hot", f"{i:05d}") for i in range(3000)] + [("cold", f"{i:05d}") for i in range(10)]
    random.Random(1).shuffle(rows)
    df = many_chunks.createDataFrame(rows, "project string, path string")
    got = {(r.project, r.path): r.ord for r in numbered(df, ["project"], path_order()).collect()}
    assert got == {(p, s): int(s) + 1 for p, s in rows}


def test_locale_order(spark):
    names = ["b", "A", "a", "B", "_x", "a/b", "é", "f"]
    df = spark.createDataFrame([("p", n) for n in names], "project string, path string")
    got = sorted(numbered(df, ["project"], path_order()).collect(), key=lambda r: r.ord)
    assert [r.path for r in got] == ["_x", "a", "A", "a/b", "b", "B", "é", "f"]


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "x"), ("c", "y")], "k string, path string")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert spread_join(rows, dim, ["k"]).count() == 51
    left = spread_join(rows, dim, ["k"], "left")
    assert left.count() == 52 and left.where("v is null").count() == 1
