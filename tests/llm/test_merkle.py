import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from tests.llm.helpers import DOCS, corpus, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **changed):
    row = {c: changed.get(c, row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row.values()))


def levels(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, pos):
    for level in tree[:-1]:
        run = level[pos // 2 * 2:pos // 2 * 2 + 2]
        yield pos % 2, [x for k, x in enumerate(run) if k != pos % 2]
        pos //= 2


def brute(rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    names = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted((r for r in rows if r["lang"] == name), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = own, levels([leaf(r) for r in own])
    top = levels([trees[n][1][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        own, tree = trees[name]
        for pos, r in enumerate(own):
            path = [*steps(tree, pos), *steps(top, place)]
            at = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                at = leaf(r, n_chars=r["n_chars"] + 1)
            for right, others in path:
                at = h(*others, at) if right else h(at, *others)
            out.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0], h(*(x for _, o in path for x in o)), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, height, schema=DOCS):
    docs = frame(spark, rows, schema)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(map(tuple, merkle.audit_documents(docs, changed, {"n_chars": F.col("n_chars") + 1}, height=height).collect()), key=str)


ODD = [(None, None, None, None, None), (None, "x", None, "s", 1), (900, "a", "", "s", 1), (900, "a", "", "s", 1), (900, "b", "", "s", 1),
       (901, "é" * 50_000, "日本", None, 50_000), (903, "z", "de", "s", None)]


def test_addresses_fill_the_layout_and_keep_subtrees_together():
    for levels_ in range(1, 13):
        every = np.concatenate([merkle.address(levels_, d, np.arange(1 << d)) for d in range(levels_)])
        assert sorted(every) == list(range((1 << levels_) - 1))
    # Ten levels: the upper five, then each lower subtree in one piece.
    under = [merkle.address(10, 5 + d, np.arange(3 << d, 4 << d)) for d in range(5)]
    assert sorted(np.concatenate(under)) == list(range(31 + 3 * 31, 31 + 4 * 31))


@pytest.mark.parametrize("height", [1, 3, 10])
def test_equals_brute_force(spark, height):
    rows = corpus(5)[:40] + ODD
    rows = [(*r[:2], ["en", "fr", "en", "de"][i % 4], *r[3:]) if i < 40 else r for i, r in enumerate(rows)]
    assert found(spark, rows, height) == brute(rows)


def test_tampering_is_found_and_nothing_else(spark):
    rows = corpus(6)
    for r in found(spark, rows, 4):
        given = next(x for x in rows if x[0] == r[0])
        assert r[-1] == (given[4] is None or zlib.crc32(str(r[0]).encode()) % 7 != 0)


def test_one_row_and_no_rows(spark):
    one = [(7, "a", "en", "s", 1)]
    ((_, own, subroot, root, proof, folded, verified),) = found(spark, one, 3)
    assert own == subroot == root == leaf(dict(doc_id=7, text="a", lang="en", source="s", n_chars=1)) and proof == h()
    assert found(spark, [], 3) == []


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, f"t{i}", "en", "s", 2, "x", 1, "y", "z") for i in range(5)]
    schema = DOCS + ", tree string, pos int, digest string, claimed string"
    assert found(spark, rows, 2, schema) == brute([r[:5] for r in rows])
