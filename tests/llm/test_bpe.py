import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from tests.llm.helpers import corpus, frame

with open(public_tokenizers.path(bpe.RANKS), "rb") as lines:
    RANKS = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREES = {leaf: bpe.Bpe(RANKS, leaf=leaf) for leaf in (1, 3, 17)}
PARTS = ["a", "the", " ", "  ", "\n", " \n ", "é", "'", "'re", "'s", "12", "日本", "\t", "\xa0", " ", "!", "##", "ing", "\x1c", "\r\n", "🙂", "aaaa"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40))
def test_every_tree_gives_the_encoding_of_the_whole(text):
    want = WHOLE.encode_ordinary(text)
    for tree in TREES.values():
        assert tree.encode(text) == want
        assert tree.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["", "x" * 20_000, "ab " * 5000, " " * 3000 + "x", "\n" * 999, "éa" * 4000])
def test_long_texts(text):
    assert bpe.load(bpe.RANKS).encode(text) == TREES[17].encode(text) == WHOLE.encode_ordinary(text)


def test_long_runs_without_a_border():
    text = "".join(random.Random(2).choice("abcdeinorst") for _ in range(30_000))
    assert bpe.load(bpe.RANKS).encode(text) == WHOLE.encode_ordinary(text)


def test_documents(spark):
    rows = corpus(21) + corpus(21)[:5] + [(None, "no id", None, None, 1)]
    docs = frame(spark, rows).withColumn("n_tokens", F.lit("mine")).withColumn("_octets", F.lit(1))
    got = bpe.encode_documents(docs)
    assert len(got.columns) == len(set(got.columns)) and "_octets" in got.columns

    def row(r):
        ids = WHOLE.encode_ordinary(r[1] or "")
        return (r[0], ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((r[1] or "").encode()).hexdigest())

    have = [tuple(r) for r in got.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(map(str, have)) == sorted(str(row(r)) for r in rows)


def test_empty_table(spark):
    assert bpe.encode_documents(frame(spark, [])).collect() == []
