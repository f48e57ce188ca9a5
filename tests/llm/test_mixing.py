from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import mixing
from tests.llm.helpers import corpus, frame, words


def brute_targets(sizes):
    """sizes: {source: size}; the excess over three times a source is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / free if free else 0
        above = {s for s in names if s not in full and 3 * sizes[s] < level * weight[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def check(spark, rows):
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    sizes, largest = Counter(), Counter()
    for r in rows:
        n = len(words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return taken, target, largest


def test_sources_come_within_half_a_document(spark):
    rows = corpus(1, 120)
    taken, target, largest = check(spark, rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_a_small_source_is_capped_and_the_rest_reshared(spark):
    rows = [(i, "w " * (5 + i % 7), "x", "abc"[0 if i < 200 else 1 + i % 2], 1) for i in range(220)]
    taken, target, _ = check(spark, rows)
    assert target["b"] == 3 * taken["b"] / 3 and target["c"] == taken["c"]
    assert abs(sum(target.values()) - sum(len(words(r[1])) for r in rows)) < 1e-6


def test_reruns_and_other_partitions_agree(spark):
    rows = corpus(3)
    one = mixing.mix_sizes(frame(spark, rows)).collect()
    two = mixing.mix_sizes(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_empty_tables_and_empty_texts(spark):
    assert mixing.mix_sizes(frame(spark, [])).count() == 0
    got = mixing.mix_sizes(frame(spark, [(1, None, "x", None, 0), (2, "", "x", "s", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in sorted(got)] == [(0, 0.0, 0)] * 2
    assert mixing.mix(frame(spark, [(1, None, "x", None, 0)])).count() == 0


def test_repeated_rows_and_missing_ids_are_taken_alike(spark):
    rows = [(7, "a b c", "x", "s", 5)] * 6 + [(None, "d e", "x", "s", 3)] * 2 + [(9, "f " * 40, "x", "t", 80)]
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    assert len({r.taken for r in got if r.doc_id == 7}) == 1 and len(got) == 9


def test_mix_repeats_documents_with_their_columns(spark):
    rows = corpus(5, 90)
    docs = frame(spark, rows).withColumn("target", F.lit("mine")).withColumn("_mix_cut", F.lit(2)).withColumn("key", F.lit(None).cast("int"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_sizes(docs).collect() if r.size and r.taken}
    assert times == want
