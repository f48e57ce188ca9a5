import re

import corpus_pipeline
from corpusloom.llm import bpe, quality, simhash
from corpusloom.staging import stage

SF = "/root/testdata/sf0.001"


def test_stages_in_order_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources", "bpe encoding"]
    kept = {}
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, SF))
        if name != "bpe encoding":
            assert after.columns == docs.columns and after.schema == before.schema
        kept[name], before = (before, after), after

    given, left = kept["quality rules"]
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in quality.judge(given, labels).where("kept").collect()}

    given, left = kept["line dedup"]
    texts, seen = {r.doc_id: r.text for r in given.collect()}, set()
    out = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert set(out) == set(texts)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        want = "\n".join(x for x, k in zip(lines, keys) if len(k) < 10 or k not in seen)
        assert out[i] == (want, len(want))
        seen.update(k for k in keys if len(k) >= 10)

    given, left = kept["simhash near-dedup"]
    heads = {r.component_id for r in simhash.near_duplicates(given).collect()}
    assert sorted(r.doc_id for r in left.collect()) == sorted(heads)

    given, left = kept["mixing sources"]
    assert {r.doc_id for r in left.collect()} <= {r.doc_id for r in given.collect()}

    given, left = kept["bpe encoding"]
    encoder = bpe.load(bpe.RANKS)
    assert sorted((r.doc_id, tuple(r.ids)) for r in left.collect()) == sorted((r.doc_id, tuple(encoder.encode(r.text))) for r in given.collect())


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
