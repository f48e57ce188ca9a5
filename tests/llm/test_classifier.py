import random
import zlib

import numpy as np

from corpusloom.llm import classifier
from tests.llm.helpers import corpus, frame

LABELS = "doc_id long, quality int, toxic int"
PAIR = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n)) + "."


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return prose(rng, n).upper().replace(" ", "!! ")
    if kind == 1:
        return prose(rng, n).replace(" ", "### ")
    return " ".join(w for w in prose(rng, max(2, n // 6)).split() for _ in range(6))


def labelled(n, seed=1):
    rng = random.Random(seed)
    docs = [(i, (junk if i % 4 == 0 else prose)(rng, rng.randrange(5, 90))) for i in range(n)]
    return docs, [(i, int(i % 4 != 0), 0) for i in range(n) if i % 3]


def found(spark, docs, labels, schema=PAIR, **options):
    return {r.doc_id: r for r in classifier.classify(frame(spark, docs, schema), frame(spark, labels, LABELS), **options).collect()}


def objective(rows, signs, ratio, costs, weights, bias):
    """The primal value at learned weights (in the scale of the indicators)."""
    w = np.divide(weights, ratio, out=np.zeros_like(weights), where=ratio != 0)
    margins = np.array([weights[r].sum() / np.sqrt(len(r)) + bias for r in rows])
    return (w @ w + bias * bias) / 2 + (costs * np.maximum(0, 1 - signs * margins)).sum()


def test_grams_are_words_pairs_and_shapes():
    grams = classifier.Grams(18)
    assert len(grams.of(b"")) == 1 and len(grams.of(b"one")) == 3
    # Words a, b; shape a; pairs ab, ba; pair of shapes; length.
    assert len(grams.of(b"a b a b a b")) == 7
    assert set(grams.of(b"The the")) & set(grams.of(b"tHE"))
    again = classifier.Grams(18)
    text = prose(random.Random(1), 3000).encode()
    assert list(again.of(text)) == list(grams.of(text)) == list(grams.of(text))
    # A repeated word looks alike whatever the word is.
    same = set(grams.of(b"xyz xyz xyz")) & set(grams.of(b"qrs qrs qrs")) - set(grams.of(b"xyz qrs tuv"))
    assert same


def test_the_table_of_words_may_be_dropped_at_any_time(monkeypatch):
    texts = [prose(random.Random(i), 50).encode() for i in range(20)]
    grams = classifier.Grams(18)
    want = [list(grams.of(t)) for t in texts]
    monkeypatch.setattr(classifier, "_REMEMBERED", 10)
    grams = classifier.Grams(18)
    assert [list(grams.of(t)) for t in texts] == want


def test_dual_descent_reaches_the_least_hinge_loss():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(60)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    signs, ratio, costs = np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.normal(size=40), np.full(60, 0.7)
    weights, bias = classifier.dual_descent(rows, signs, ratio, costs, passes=3000, enough=1e-9)
    best = objective(rows, signs, ratio, costs, weights, bias)
    for _ in range(300):
        moved = weights + ratio * rng.normal(size=40) * 10 ** rng.uniform(-4, 0)
        assert objective(rows, signs, ratio, costs, moved, bias + rng.normal() * 10 ** rng.uniform(-4, 0)) >= best - 1e-6


def test_ratios_follow_the_counts():
    counts = np.array([[0, 9], [9, 0], [5, 5]])
    r = classifier.ratios(counts)
    assert r[0] > 0 > r[1] and abs(r[2]) < 1e-9 and abs(r[0] - np.log(10)) < 1e-9


def test_held_out_documents_are_told_apart_and_never_learned(spark):
    docs, labels = labelled(900)
    got = found(spark, docs, labels)
    assert set(got) == {d for d, _ in docs}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].predicted == (d % 4 != 0) for d in out]) > 0.97
    # Labels of held-out rows change nothing.
    turned = [(d, 1 - q if got[d].held_out else q, t) for d, q, t in labels]
    assert {d: r.score for d, r in found(spark, docs, turned).items()} == {d: r.score for d, r in got.items()}


def test_odd_texts_ids_and_labels(spark):
    docs, labels = labelled(200, 4)
    docs += [(1000 + r[0], r[1]) for r in corpus(8)] + [(None, "x y"), (None, None), (5, docs[5][1]), (5, "another text of this id")]
    labels += [(None, 1, 0), (5, None, 0), (5, 7, 0), (7, 0, 0), (999_999, 1, 0)]
    rows = [(d, t, 1, "a", "b", 2.0) for d, t in docs]
    table = frame(spark, rows, PAIR + ", score int, places string, quality string, turn double")
    got = classifier.classify(table, frame(spark, labels, LABELS)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _ in docs)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    empty = {r.score for r, t in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(docs, key=lambda d: str(d[0]))) if r.doc_id is not None and not (t[1] or "").split()}
    assert len(empty) == 1
    model = classifier.learn(table, frame(spark, labels, LABELS))
    full = classifier.with_score(table, model)
    assert full.columns == ["doc_id", "text", "places", "quality", "turn", "score"]


def test_no_labels_one_kind_and_no_rows(spark):
    docs, labels = labelled(40)
    assert {r.score for r in found(spark, docs, []).values()} == {0.5}
    ones = [r for r in labels if r[1] == 1]
    scores = {r.score for r in found(spark, docs, ones).values()}
    assert len(scores) == 1 and scores.pop() > 0.8
    assert found(spark, [], labels) == {}


def test_a_sample_is_the_same_for_every_order(spark):
    docs, labels = labelled(300)
    first = found(spark, docs, labels, sample=100, fitted=60)
    again = found(spark, docs[::-1], labels[::-1], sample=100, fitted=60)
    assert {d: r.score for d, r in first.items()} == {d: r.score for d, r in again.items()}
