import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import winnow
from tests.llm.helpers import corpus, frame, text_of, words


def h(data, seed=42):
    v = xxhash.xxh64_intdigest(data, seed=seed)
    return v - (1 << 64) if v >> 63 else v


def both(a, b):
    return h(struct.pack("<q", b), h(struct.pack("<q", a)) & ((1 << 64) - 1))


def spans(values, span, join):
    done = 1
    while done < span:
        step = min(done, span - done)
        if len(values) > step:
            values = [join(a, b) for a, b in zip(values, values[step:])]
        done += step
    return values


def brute(text, gram=4, window=8):
    """(hash, position) of the rightmost least gram of every window."""
    grams = spans([h(w.lower().encode()) for w in words(text)], gram, both)
    found = []
    size = window
    while size > 1 and len(grams) < size:
        size -= 1
    marks = spans([((g & 0xFFFFFFFF), -i) for i, g in enumerate(grams)], window, min)
    for m in marks:
        if (m[0], -m[1]) not in found:
            found.append((m[0], -m[1]))
    return found


def near(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(spark, rows, chunks):
    rows = [(r[0], r[1]) for r in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        want.append((d, len(t), edited, brute(t), brute(edited), near(brute(t), brute(edited)), near(brute(t), brute(nxt))))
    got = winnow.fingerprint_edits(frame(spark, rows, "doc_id long, text string").repartition(4), chunks=chunks).select(
        "doc_id", "n_chars", "edited", winnow.entries("fingerprint"), winnow.entries("edited_fingerprint"), "near_edited", "near_next").collect()
    got = [(r[0], r[1], r[2], [tuple(x) for x in r[3]], [tuple(x) for x in r[4]], round(r[5], 12), round(r[6], 12)) for r in got]
    want = [(*w[:5], round(w[5], 12), round(w[6], 12)) for w in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equals_brute_force(spark):
    check(spark, corpus(7), 5)


def test_missing_ids_and_repeated_rows(spark):
    rows = corpus(8, 36)
    check(spark, rows + rows[:12] + [(None, "no id here", "", "", 1), (None, None, "", "", 1)], 7)


def test_one_document_one_chunk_and_none(spark):
    check(spark, [(5, "a single text of several words here", "", "", 1)], 4)
    check(spark, corpus(9, 36), 1)
    assert winnow.fingerprint_edits(frame(spark, [])).count() == 0


def test_a_shared_passage_shares_a_hash(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        shared = text_of(rng, winnow.GRAM + winnow.WINDOW - 1)
        for k in (0, 1):
            rows.append((2 * i + k, f"{text_of(rng, rng.randrange(30))} {shared} {text_of(rng, rng.randrange(30))}"))
    df = winnow.winnow(frame(spark, rows, "doc_id long, text string"), "text", "fp").withColumn("hashes", winnow.hashes("fp"))
    found = {r.doc_id: set(r.hashes) for r in df.collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(40))


def test_equal_texts_have_equal_digests_and_no_python_runs(spark):
    df = winnow.fingerprint_edits(frame(spark, [(1, "a b c d e f", "", "", 1), (2, "a b c d e f", "", "", 1), (3, "g", "", "", 1)]))
    got = {r.doc_id: r for r in df.withColumn("d", winnow.digest("fingerprint")).collect()}
    assert got[1].d == got[2].d != got[3].d and got[1].near_next == 1.0 and len(got[1].d) == 32
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edited_digest(spark):
    df = winnow.fingerprint_edits(frame(spark, [(1, "abcd", "", "", 1), (2, "xyzuvw", "", "", 1)]))
    got = {r.doc_id: r[1] for r in df.select("doc_id", F.sha2(F.col("edited").cast("binary"), 256)).collect()}
    assert got == {1: hashlib.sha256(b"abxy").hexdigest(), 2: hashlib.sha256(b"xyzabc").hexdigest()}
