import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import quality
from tests.llm.helpers import corpus, frame, words

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    ws = words(text)
    runs = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {i + k for i in range(len(ws) - 2) if runs[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def junk(rng, i):
    return " ".join(f"w{rng.randrange(900)}###" for _ in range(60 + i % 50))


def good(rng, i):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(60 + i % 50)) + "."


def labelled(n, seed=1, noise=0.0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, junk(rng, i) if bad else good(rng, i)))
        if i % 3:
            labels.append((i, int(bad if rng.random() < noise else not bad), 0))
    return docs, labels


def test_counts_equal_brute_force(spark):
    rows = [(r[0], r[1]) for r in corpus(11)] + [(900, "a b c a b c x a b c"), (901, "z z z z z"), (902, "q\nq\n q\nq|<"), (903, "a b c d a b c d")]
    got = quality.with_counts(frame(spark, rows, "doc_id long, text string")).select("doc_id", *quality.BASE_COUNTS).collect()
    assert sorted(map(tuple, got)) == sorted((d, *brute(t)) for d, t in rows)


def test_rules_separate_held_out_documents(spark):
    docs, labels = labelled(900)
    table = frame(spark, docs, "doc_id long, text string")
    rules = quality.learn_rules(table, frame(spark, labels, LABELS))
    assert rules and all(len(r) <= 4 for r in rules) and "symbols_per_word" in str(rules[0][0])
    verdict = {r.doc_id: r for r in quality.judge(table, frame(spark, labels, LABELS)).collect()}
    held_out = [d for d, _ in docs if d % 3 == 0]
    assert all(verdict[d].kept == (d % 4 != 0) for d in held_out)
    assert all((r.rule is None) == r.kept for r in verdict.values() if not r.base_failed)


def test_noisy_labels_do_not_cost_good_documents(spark):
    docs, labels = labelled(1500, 2, noise=0.05)
    kept = {r.doc_id for r in quality.keep_good(frame(spark, docs, "doc_id long, text string"), frame(spark, labels, LABELS)).collect()}
    good_ids = {d for d, _ in docs if d % 4}
    assert len(good_ids - kept) <= 0.01 * len(good_ids) and len(kept - good_ids) <= 0.05 * len(docs)


def test_order_and_partitions_of_the_rows_do_not_matter(spark):
    docs, labels = labelled(600, 3, noise=0.03)
    one = quality.learn_rules(frame(spark, docs, "doc_id long, text string"), frame(spark, labels, LABELS), sample=300)
    two = quality.learn_rules(frame(spark, docs[::-1], "doc_id long, text string").repartition(7), frame(spark, labels[::-1], LABELS), sample=300)
    assert one == two


def test_labels_without_information_make_no_rules(spark):
    rng = np.random.RandomState(4)
    table = {n: rng.rand(500) for n, _, _ in quality.STATISTICS}
    assert quality.learn(table, rng.rand(500) < 0.1, rng.randint(0, 3, 500)) == []
    assert quality.learn({n: t[:0] for n, t in table.items()}, np.zeros(0, bool), np.zeros(0, int)) == []


def test_a_conjunction_is_grown_and_pruned():
    rng = np.random.RandomState(5)
    table = {n: rng.rand(6000) for n, _, _ in quality.STATISTICS}
    bad = (table["upper_share"] > 0.7) & (table["digit_share"] < 0.4)
    rules = quality.learn(table, bad, rng.randint(0, 3, 6000))
    hit = np.zeros(6000, bool)
    for rule in rules:
        hit |= quality._covered(rule, table, 6000)
    assert (hit == bad).mean() > 0.99


def test_odd_rows_and_clashing_columns(spark):
    rows = corpus(12) + corpus(12)[:8]
    docs = frame(spark, rows).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(3)).withColumn("rule", F.lit("x"))
    judged = quality.judge(docs, frame(spark, [], LABELS))
    assert len(judged.columns) == len(set(judged.columns)) and judged.count() == len(rows)
    for r in judged.collect():
        n, _, _, _, again = brute(r.text)
        assert r.n_words == n and r.kept == (not (n < 50 or 100 * again > 50 * n))
    assert quality.keep_good(docs, frame(spark, [(None, 1, 0), (3, None, 0)], LABELS)).columns == docs.columns
    assert quality.judge(frame(spark, []), frame(spark, [], LABELS)).count() == 0
