"""The training-data pipeline: documents in, token ids out, through five operators of corpusloom.llm.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows, ties, extra columns of any
name and no rows at all; what it makes of them is said below.
"""

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, line_dedup, mixing, quality, simhash
from corpusloom.staging import stage, staged_tables

# The contract of the near-duplicate operator: words in a shingle, and bits in which linked fingerprints differ at most.
SHINGLE, DISTANCE = 3, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base tests and no learned rule rejects. A null or empty text fails; repeated rows are
    judged alike; rows without an id are judged by their text; no documents, or no labels, are no error."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id holds; n_chars is that of the new text. A null text becomes
    an empty one; rows of one id, and all rows without an id, count as one document, the latter as the last."""
    return line_dedup.drop_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest id. Texts without words have one fingerprint and
    so are one group; rows of one id stay or go together; rows without an id stay."""
    return simhash.one_of_each(docs, SHINGLE, DISTANCE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time they are taken. A null source is a source of its own, the last; documents
    without words are not taken; repeated rows are taken each for itself."""
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text. A null or empty text has no ids."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("bpe encoding", bpe_encode),
]

# The fingerprints, the learned rules and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table that the next stage reads. Only the table that the last
    stage reads is left at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staged_tables(spark) as keep:
        for _, step in STAGES[:-2]:
            docs = stage(step(spark, docs, sf_dir))
        docs = keep(STAGES[-2][1](spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
