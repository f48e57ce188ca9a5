import random
import re
import zlib

from pyspark.sql import functions as F

from corpusloom.llm import substrings
from tests.llm.helpers import corpus, frame, words

SCHEMA = "doc_id long, text string"


def rows_with_passages(seed):
    """Fresh words everywhere but for 8 passages of 51 to 90 words, each put into the middle of 3 documents."""
    rng = random.Random(seed)

    def fresh(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** 9):x}" + ("\n" if rng.random() < 0.05 else "") for _ in range(n)]

    passages = [fresh(rng.randrange(51, 90)) for _ in range(8)]
    rows = []
    for i in range(60):
        body = fresh(rng.randrange(60, 200))
        if i < 24:
            at = rng.randrange(len(body))
            body[at:at] = passages[i % 8]
        rows.append((i, " ".join(body)))
    return rows, passages


def test_passages_stay_in_the_first_document_alone(spark):
    rows, passages = rows_with_passages(1)
    got = {r.doc_id: r for r in substrings.dedup_substrings(frame(spark, rows, SCHEMA)).collect()}
    for i, text in rows:
        assert (got[i].n_removed > 0) == (8 <= i < 24), i
        if got[i].n_removed:
            assert got[i].first_ids == [i % 8]
            left = " ".join(words(got[i].text))
            assert sum(w.strip() in left for w in passages[i % 8]) <= 2 * substrings.ANCHOR_WINDOW
        else:
            assert got[i].text == text


def test_units_of_a_passage_do_not_depend_on_its_place():
    rng = random.Random(6)
    passage = [f"w{rng.randrange(10 ** 6)}" for _ in range(70)]
    inside = [d for a, n, d in substrings.digests(" ".join(passage).encode()) if 8 <= a and a + n <= 62]
    for _ in range(30):
        around = [f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 40))]
        k = rng.randrange(len(around))
        found = {d for _, _, d in substrings.digests(" ".join(around[:k] + passage + around[k:]).encode())}
        assert set(inside) <= found and len(inside) >= 6


def plain_units(text):
    """The same cutting, word by word: lists of (start, end) of the words of each unit."""
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    words = [text[a:b].lower() for a, b in places]
    lines, count = set(), 0
    for line in text.split(b"\n"):
        n = len(line.split())
        count += n
        if n >= 8:
            lines.add(count)
    n = len(words)
    if not n:
        return []
    fixed = lines | {n}
    anchors = set()
    for i in range(n - 7):
        checks = [zlib.crc32(w) for w in words[i:i + 8]]
        anchors.add(i + max(k for k in range(8) if checks[k] == min(checks)) + 1)
    kept = {a for a in anchors if not anchors & {a + 1, a + 2}}
    kept = {a for a in kept if not fixed & {a - 2, a - 1, a, a + 1, a + 2}}
    ends = sorted(kept | fixed)
    return [[(places[i], words[i]) for i in range(a, b)] for a, b in zip([0, *ends], ends)]


def brute(rows, least_run):
    """The same by one global table of texts of units in memory."""
    listed = {k: plain_units((t or "").encode()) for k, (_, t) in enumerate(rows)}
    name = {k: (i is None, i or 0, (t or "") if i is None else "") for k, (i, t) in enumerate(rows)}
    first = {}
    for k in listed:
        for no, unit in enumerate(listed[k]):
            key = tuple(w for _, w in unit)
            first[key] = min(first.get(key, ((True, 1 << 62, ""), 0)), (name[k], no))
    out = []
    for k, (i, t) in enumerate(rows):
        data, spans, run = (t or "").encode(), [], []
        for no, unit in enumerate([*listed[k], None]):
            if unit is not None and first[tuple(w for _, w in unit)] != (name[k], no):
                run += unit
                continue
            if len(run) >= least_run:
                spans.append((run[0][0][0], run[-1][0][1]))
            run = []
        chars = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in spans]
        left, at = "", 0
        for a, b in chars:
            left += (t or "")[at:a]
            at = b
        out.append((i, len(listed[k]), len(chars), chars, left + (t or "")[at:]))
    return out


def test_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in corpus(41)] + [(None, corpus(41)[20][1]), (None, None)]
    got = substrings.dedup_substrings(frame(spark, rows, SCHEMA).repartition(5)).collect()
    have = [(r.doc_id, r.n_units, r.n_removed, [tuple(s) for s in r.removed], r.text) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, brute(rows, substrings.LEAST_RUN)))


def test_verse_and_texts_of_one_word(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"{rng.randrange(10 ** 9):x}" for _ in range(n)]
    verse = fresh(80)
    verse = "\n".join(" ".join(verse[i:i + 2]) for i in range(0, 80, 2))
    rows = [(i, " ".join(fresh(50)) + "\n" + verse + "\n" + " ".join(fresh(50))) for i in range(2)]
    rows += [(2, "word " * 300), (3, "word " * 300), (None, "again " * 40), (None, "again " * 40), (None, "other " * 40)]
    got = {}
    for r in substrings.dedup_substrings(frame(spark, rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[0][0].n_removed == 0 and got[1][0].first_ids == [0]
    assert sum(b - a for a, b in got[1][0].removed) > 0.7 * len(verse)
    assert got[2][0].n_removed == 0 and got[3][0].text.strip() == ""
    assert [r.n_removed for r in got[None]] == [0, 0, 0]


def test_recall_on_passages_of_many_shapes(spark):
    """Passages of 51 to 120 words in lines of any length are found in at least 0.9 of the documents that repeat them."""
    rng = random.Random(9)
    rows, later = [], set()
    for k in range(60):
        words_ = [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** 7):x}" for _ in range(rng.randrange(51, 120))]
        step = rng.choice([1, 2, 3, 5, 9, 200])
        passage = "\n".join(" ".join(words_[i:i + step]) for i in range(0, len(words_), step))
        for copy in range(2):
            body = [f"{rng.randrange(10 ** 9):x}" for _ in range(rng.randrange(10, 80))]
            at = rng.randrange(len(body))
            rows.append((2 * k + copy, " ".join(body[:at]) + rng.choice([" ", "\n"]) + passage + rng.choice([" ", "\n"]) + " ".join(body[at:])))
            if copy:
                later.add(2 * k + 1)
    got = {r.doc_id for r in substrings.dedup_substrings(frame(spark, rows, SCHEMA)).where("n_removed > 0").collect()}
    assert got <= later and len(got) >= 0.9 * len(later)


def test_offsets_are_those_of_the_original_text(spark):
    rows, _ = rows_with_passages(2)
    rows = [(i, "é日 " + t) for i, t in rows]
    text = dict(rows)
    for r in substrings.dedup_substrings(frame(spark, rows, SCHEMA)).collect():
        left, at = "", 0
        for a, b in r.removed:
            left += text[r.doc_id][at:a]
            at = b
        assert left + text[r.doc_id][at:] == r.text


def test_repeated_rows_other_columns_and_empty_table(spark):
    rows = [(3, "one two three four five six seven " * 9)] * 2
    docs = frame(spark, rows, SCHEMA).withColumn("units", F.lit("mine")).withColumn("own", F.lit("x")).withColumn("hi", F.lit(1))
    a, b = substrings.dedup_substrings(docs).collect()
    assert a == b
    assert substrings.dedup_substrings(frame(spark, [], SCHEMA)).count() == 0
