"""Token files: Parquet with a dictionary-encoded list of ids per document, in order of documents."""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.rows import map_slices, octets, texts
from corpusloom.staging import shared_dir, stage

VOCABULARY = "byte_bpe_50k.json"
END = 0
# Bytes of text in a file, and in a slice that is encoded at once; a longer text comes alone.
FILE_BYTES = 32 << 20
SLICE_BYTES = 8 << 20
ROW_GROUP = 16 << 20
PAGE = 128 << 10
# Words that the tokenizer gets in one text, and that a worker remembers (about 50 MB) before it starts anew.
_TOGETHER = 1000
MOST_WORDS = 1 << 20
# A border between a non-blank and a blank is one for the tokenizer whatever lies around it. Texts with
# white space before a blank are encoded whole.
_BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                 (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_BLANKS = "".join(chr(c) for a, b in _BLANK_RANGES for c in range(a, b + 1))
# Marks that are a piece of their own between a letter and a blank.
_MARKS = ".,;:!?"
_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _BLANKS) + "]"
_BLANK_BEFORE_BLANK = _BLANK + " "


class Encoder:
    """The tokenizers library, asked once for every different word that the table holds, since texts repeat most of theirs.

    Texts are cut before their blanks. Words that are new go to the tokenizer as one text, whose ids are cut
    at the words' ends by the byte lengths of the tokens; one that ends in a letter and a mark is made of the word
    before the mark and the mark. The table lives as long as its worker and starts anew beyond MOST_WORDS, so small
    slices of texts cost no more than large ones.
    """

    def __init__(self, name: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character of the byte alphabet for each byte
        self.marks = {m: self._plain(m) for m in _MARKS}
        self._clear()

    def _clear(self) -> None:
        # Entry k is ids[ends[k]:ends[k + 1]]; entry 0 is empty. Words with a blank before them are a plain array, which takes
        # a tenth of the memory of a dictionary; first words, without a blank, are few.
        self.known, self.numbers = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.first: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.entries = 1

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """The number of the first of new entries."""
        used, first = int(self.ends[self.entries]), self.entries
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(counts) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used:used + len(ids)] = ids
        self.ends[first + 1:first + 1 + len(counts)] = used + np.cumsum(counts)
        self.entries += len(counts)
        return first

    def _one(self, text: str) -> int:
        ids = self._plain(text)
        return self._add(ids, np.array([len(ids)]))

    def _learn(self, words: pa.StringArray, marked: np.ndarray, bases: pa.StringArray, base_entries: np.ndarray) -> np.ndarray:
        """Entries for new words that stand after a blank; marked are those made of a base and a mark, with the bases' entries or -1."""
        whole, missing = words.filter(pa.array(~marked)), bases.filter(pa.array(base_entries < 0))
        plain = pc.unique(pa.concat_arrays([whole, missing]))
        # A word at the end of a text may be empty or end in white space: it must not meet a next one.
        lone = pc.or_(pc.equal(pc.binary_length(plain), 0), pc.match_substring_regex(plain, _BLANK + "$")).to_numpy(zero_copy_only=False)
        together = plain.filter(pa.array(~lone))
        sizes = pc.binary_length(together).to_numpy().astype(np.int64) + 1
        listed, first = together.to_pylist(), self.entries
        for i in range(0, len(listed), _TOGETHER):
            ids = self._plain(" " + " ".join(listed[i:i + _TOGETHER]))
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[i:i + _TOGETHER])) + 1
            self._add(ids, np.diff(ends, prepend=0))
        numbers = np.zeros(len(plain), np.int32)
        numbers[~lone] = np.arange(first, first + len(listed))
        numbers[lone] = [self._one(" " + word) for word in plain.filter(pa.array(lone)).to_pylist()]
        found = np.zeros(len(words), np.int32)
        found[~marked] = numbers[pc.index_in(whole, value_set=plain).to_numpy()]
        if marked.any():
            at = base_entries.copy()
            at[at < 0] = numbers[pc.index_in(missing, value_set=plain).to_numpy()]
            marks = pc.utf8_slice_codeunits(words.filter(pa.array(marked)), -1).to_pylist()
            parts = [x for n, m in zip(at.tolist(), marks) for x in (self.ids[self.ends[n]:self.ends[n + 1]], self.marks[m])]
            counts = np.diff(self.ends)[at] + np.array([len(self.marks[m]) for m in marks])
            first = self._add(np.concatenate(parts), counts)
            found[marked] = np.arange(first, first + len(at))
        self.known = pa.concat_arrays([self.known, plain, words.filter(pa.array(marked))])
        self.numbers = np.concatenate([self.numbers, numbers, found[marked]])
        return found

    def encode(self, texts: pa.StringArray, end: int | None = None) -> pa.ListArray:
        """The ids of every text, as a list array of 32-bit integers, each with the id `end` behind it if given."""
        if len(self.known) + len(self.first) > MOST_WORDS:
            self._clear()
        cut = pc.split_pattern(texts, " ")
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())]).astype(np.int64)
        whole = pc.match_substring_regex(texts, _BLANK_BEFORE_BLANK).to_numpy(zero_copy_only=False)
        # The first word has no blank before it; a text encoded whole is one entry and then nothing.
        outer = [starts[:-1], *(np.arange(starts[t], starts[t + 1]) for t in np.flatnonzero(whole))]
        used = np.bincount(index, minlength=len(words))
        np.subtract.at(used, index[np.unique(np.concatenate(outer))], 1)
        # One look into the table for the words, and for the bases of those that end in a mark.
        marked = pc.match_substring_regex(words, r"\pL[" + _MARKS + "]$").to_numpy(zero_copy_only=False)
        bases = pc.utf8_slice_codeunits(words.filter(pa.array(marked)), 0, -1)
        at = pc.fill_null(pc.index_in(pa.concat_arrays([words, bases]), value_set=self.known), -1).to_numpy()
        both = np.append(self.numbers, np.int32(-1))[at]
        found, base_entries = both[:len(words)].copy(), both[len(words):]
        new = (found < 0) & (used > 0)
        if new.any():
            wanted = new[marked]
            found[new] = self._learn(words.filter(pa.array(new)), marked[new], bases.filter(pa.array(wanted)), base_entries[wanted])
        entry = found[index]
        for at in outer:
            entry[at] = 0
        plain = np.flatnonzero(~whole)
        for t, word in zip(plain, flat.take(pa.array(starts[plain])).to_pylist()):
            if word not in self.first:
                self.first[word] = self._one(word)
            entry[starts[t]] = self.first[word]
        kept = self.entries
        for t in np.flatnonzero(whole):
            entry[starts[t]] = self._one(texts[int(t)].as_py())
        bounds = starts
        if end is not None:
            entry = np.insert(entry, starts[1:], self._add(np.array([end], np.int32), np.array([1])))
            bounds = starts + np.arange(len(starts))
        ends = np.concatenate([[0], np.cumsum(np.diff(self.ends[:self.entries + 1])[entry])])[bounds]
        table = pa.LargeListArray.from_arrays(pa.array(self.ends[:self.entries + 1]), pa.array(self.ids[:self.ends[self.entries]]))
        ids = table.take(pa.array(entry)).flatten()
        # What only this slice has is forgotten.
        self.entries = kept
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)


@lru_cache(maxsize=2)
def load(name: str) -> Encoder:
    # A task has one core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(name)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, partitions: int | None = None) -> None:
    """Write (doc_id, n_tokens, ids) in ascending order of doc_id, rows without one first; n_tokens counts the end id.

    Files hold ranges of doc_id and sort like their names' numbers; `file_no` tells the range and `row_no` the place in
    it. Ids are dictionary-encoded, so they take as many bits as the ids of a row group need; row
    groups and pages are small enough to read single documents by the page index of doc_id. The
    texts, which are smaller than ids, are what is shuffled. Rows of one doc_id are ordered by text.
    A null or empty text has the end id alone, bytes that are not UTF-8 are replaced; an empty table writes no rows.
    """

    def make():
        encoder = load(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = encoder.encode(texts(batch.column("text")), end)
            lengths = pc.list_value_length(got).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths, got], ["doc_id", "n_tokens", "ids"])
        return each

    spark = docs.sparkSession
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    ordered = (docs.select("doc_id", octets().alias("text")).repartitionByRange(partitions, "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    encoded = map_slices(ordered, "text", "doc_id long, n_tokens long, ids array<int>", make, SLICE_BYTES)
    (encoded.withColumn("file_no", F.spark_partition_id())
     .withColumn("row_no", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
     .write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
     .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(path))


def with_start(rows: DataFrame) -> DataFrame:
    """Rows (file_no, row_no, n_tokens, ...) with start, the ids of all documents before.

    The window over all files runs on one row per file, the other inside a file.
    """
    sums = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file_no", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(bases, "file_no").withColumn("start", F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids). The starts are made from the lengths alone; a filter on doc_id
    reads only the pages that the index names."""
    table = spark.read.parquet(path)
    starts = with_start(table.select("file_no", "row_no", "n_tokens")).select("file_no", "row_no", "start")
    return table.join(starts, ["file_no", "row_no"]).select("doc_id", "start", "n_tokens", "ids")


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from token files of the documents.

    Null and empty texts have the end id alone; rows without a doc_id come first, rows of one doc_id by their text; other
    columns are not looked at; no documents give no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        flat = flat.astype("<u4", copy=False)
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "file_no", "row_no", "n_tokens")), pa.array(crcs, pa.int64())],
            ["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"])

    # The ids are read where they lie; only numbers are joined.
    table = spark.read.parquet(path).select("doc_id", "file_no", "row_no", "n_tokens", "ids")
    crcs = table.mapInArrow(lambda batches: map(each, batches), "doc_id long, file_no int, row_no long, n_tokens long, ids_crc32 long")
    return with_start(stage(crcs)).select("doc_id", "start", "n_tokens", "ids_crc32")
