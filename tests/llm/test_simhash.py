import random

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.components import components
from tests.llm.helpers import DOCS, corpus, frame


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance):
    """prints: [(id, fingerprint)]; the smallest id reachable of each fingerprint."""
    group = {p: {p} for _, p in prints}
    todo = list(group)
    for a in todo:
        for b in todo:
            if bin(a ^ b).count("1") <= distance and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {p: min((i for i, q in prints if q in group[p] and i is not None), default=None) for p in group}


def check(spark, rows):
    got = simhash.near_duplicates(frame(spark, rows)).withColumn("hex", simhash.hex_fingerprint()).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    comp = brute_components(prints, 2)
    want = sorted(((i, f"{p:016x}", comp[p]) for i, p in prints), key=str)
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=str) == want


def test_documents_equal_brute_force(spark):
    check(spark, corpus())


def test_missing_ids_and_repeated_rows(spark):
    rows = corpus(2)
    check(spark, rows + rows[:15] + [(None, rows[12][1], "x", None, None), (None, "only here and nowhere else", None, None, None)])


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_links_find_every_near_pair(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for flips in (1, 2, 3, 4):
            for _ in range(4):
                p = c
                for b in rng.sample(range(64), flips):
                    p ^= 1 << b
                prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (0, 1, 2, 3, 4):
        got = {(r.a, r.b) for r in simhash.links(df, distance).collect()}
        assert got == {(r.a, r.b) for r in simhash.links(df, distance, crowded=2).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
        assert got == want


def test_a_crowded_segment_is_cut_further(spark):
    rng = random.Random(6)
    low, spots = 0x9E3779B9, rng.sample(range(32, 64), 14)
    prints = {low | sum(1 << b for b in spots if rng.random() < 0.5) for _ in range(900)}
    prints |= {p ^ (1 << rng.randrange(32)) for p in rng.sample(sorted(prints), 80)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    for crowded in (10, 300, 10_000):
        assert {(r.a, r.b) for r in simhash.links(df, 2, crowded).collect()} == want


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    pairs = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1002), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in order}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_one_of_each_keeps_columns_and_one_id(spark):
    rows = corpus(4)
    docs = frame(spark, rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], brute_print(r[1])) for r in rows]
    assert {r.doc_id for r in kept.collect()} == set(brute_components(prints, 2).values())


def test_one_of_each_without_ids(spark):
    rows = [(None, "a b c d", "x", "s", 1), (3, "a b c d", "x", "s", 1), (3, "a b c d", "x", "s", 1), (5, "a b c d", "x", "s", 1)]
    assert sorted((r.doc_id for r in simhash.one_of_each(frame(spark, rows, DOCS)).collect()), key=str) == [3, 3, None]
