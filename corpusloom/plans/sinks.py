"""Sink: one folder per output file, whose pieces in name order are its text, byte by byte.

Rows are placed before they are moved: output file, position, task and the end of each file are found on narrow
rows, and a text is sent once, to the task that writes it.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusloom.operators.ordering import in_chunks
from corpusloom.sources.files import opened
from corpusloom.staging import stage_clustered

KEYS = ("project", "file_name")
_ORDER = (*KEYS, "section", "seq", "step")
# Rows that are found again by their number come in blocks of up to 2 ** BLOCK.
BLOCK = 8
# Bytes of text that one task writes, at most, but for a single longer row, and at least.
TASK_BYTES, LEAST_TASK_BYTES = 64 << 20, 1 << 20


def _block() -> Column:
    return F.shiftright("_at", BLOCK).alias("_block")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Staged rows with _at, a number of their own, clustered by blocks of these numbers. Nothing is moved."""
    counted = rows.withColumn("_at", F.monotonically_increasing_id())
    return stage_clustered(counted.withColumn("_block", _block()), ["_block"], sent=False)


def with_texts(held: DataFrame, placed: DataFrame) -> DataFrame:
    """placed rows with the text of the row of held that has their _at. The texts stay where they lie: what is known about a
    block comes to it in a row of at most 2 ** BLOCK places."""
    places = [c for c in placed.columns if c != "_at"]
    packed = placed.groupBy(_block()).agg(F.collect_list(F.struct("_at", *places)).alias("_places"))
    met = held.select("_block", F.col("_at").alias("_here"), "text").join(packed.hint("shuffle_hash"), "_block")
    return met.select("text", F.inline(F.filter("_places", lambda p: p["_at"] == F.col("_here")))).select(*places, "text")


def terminated(rows: DataFrame, separator: str) -> DataFrame:
    """text with what follows it: the separator after a block, a line feed between rows of one block.

    Files are blocks of their own; manifest and tree end with the row of the highest seq,
    which is the one that closes the comment.
    """
    closes = (F.col("section") == 2) | F.endswith("text", F.lit("\n*/"))
    return rows.withColumn("text", F.concat("text", F.when(closes, separator).otherwise("\n")))


@dataclass
class Placed:
    """rows (project, file_name, section, seq, step, ..., task, last): where each row goes; n tasks."""

    rows: DataFrame
    tasks: int


def place(narrow: DataFrame, task_bytes: int | None = None) -> Placed:
    """Tasks of about equal bytes for rows (project, file_name, section, seq, step, bytes, ...) in the order of their files.

    Bytes are summed in chunks of the sorted rows and over one row per chunk; a hot output file is just in many chunks.
    last marks the last row of an output file.
    """
    spark = narrow.sparkSession
    chunked = in_chunks(narrow, list(KEYS), [F.col(c) for c in _ORDER[2:]])
    ends = chunked.groupBy("_chunk").agg(F.sum("bytes").alias("_bytes"), F.min_by(F.struct(*KEYS), "_seq").alias("_first"))
    every = Window.orderBy("_chunk")
    # One row per task of the sort.
    known = ends.select("_chunk", F.coalesce(F.sum("_bytes").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                        F.lead("_first").over(every).alias("_then"))
    total = ends.agg(F.sum("_bytes")).first()[0] or 0
    if task_bytes is None:
        task_bytes = max(LEAST_TASK_BYTES, min(TASK_BYTES, -(-total // spark.sparkContext.defaultParallelism)))
    inside = Window.partitionBy("_chunk").orderBy("_seq")
    here = F.struct(*KEYS)
    then = F.coalesce(F.lead(here).over(inside), "_then")
    rows = chunked.join(F.broadcast(known), "_chunk").withColumn(
        "_upto", F.coalesce(F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before"))
    return Placed(rows.withColumn("last", ~here.eqNullSafe(then)).withColumn("task", F.floor(F.col("_upto") / task_bytes).cast("int"))
                  .drop("_chunk", "_seq", "_before", "_then", "_upto", "bytes"), max(1, -(-total // task_bytes)))


def folder_name(name: str, value: str) -> str:
    """A partition folder as Spark names it."""
    return f"{name}=" + re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


@dataclass
class Pieces(WriterCommitMessage):
    """Pieces that a task attempt has written below its own folder."""

    names: list[str] = field(default_factory=list)


class PieceWriter(DataSourceArrowWriter):
    """Writes rows (project, file_name, task, text) in the order in which they come. A task attempt writes to a folder of its own;
    only the pieces of attempts that Spark commits are moved to their place, all at the end."""

    def __init__(self, target: str):
        self.target, self.attempts = target.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Pieces:
        system, base = opened(self.target)
        own, done, out, here = f"{self.attempts}/{uuid.uuid4().hex}", Pieces(), None, None
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("project", "file_name", "task", "text")]
                for project, file_name, task, text in zip(*columns):
                    if here != (project, file_name):
                        if out is not None:
                            out.close()
                        here = project, file_name
                        folder = "/".join((own, folder_name("project", project), folder_name("file_name", file_name), f"piece={task:012d}"))
                        system.create_dir(f"{base}/{folder}", recursive=True)
                        done.names.append(f"{folder}/part-00000.txt")
                        out = system.open_output_stream(f"{base}/{done.names[-1]}")
                    out.write(text.encode())
        finally:
            if out is not None:
                out.close()
        return done

    def _clear(self) -> None:
        system, base = opened(self.target)
        if system.get_file_info(f"{base}/{self.attempts}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/{self.attempts}")

    def commit(self, messages: list[Pieces | None]) -> None:
        system, base = opened(self.target)
        system.create_dir(base, recursive=True)
        for name in (n for m in messages if m is not None for n in m.names):
            place_ = f"{base}/{name.split('/', 2)[2]}"
            system.create_dir(place_.rpartition("/")[0], recursive=True)
            system.move(f"{base}/{name}", place_)
        self._clear()
        system.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clear()


class PieceSource(DataSource):
    """Format corpusloom_pieces: save(target) writes exact bytes."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_pieces"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"])


def sent_rows(placed: Placed, rows: DataFrame, separator: str) -> DataFrame:
    """(project, file_name, task, text) of placed rows with their texts, ended as in their file, sorted in their tasks.
    The one exchange of the texts: each goes to the task of its number."""
    ended = F.when(F.col("last"), F.col("text")).otherwise(F.col("_ended"))
    columns = [*_ORDER, "task", ended.alias("text")]
    full = terminated(rows.withColumn("_text", F.col("text")), separator).withColumnRenamed("text", "_ended").withColumnRenamed("_text", "text")
    return full.select(*columns).repartitionById(placed.tasks, "task").sortWithinPartitions(*_ORDER).select(*KEYS, "task", "text")


def write_placed(placed: Placed, rows: DataFrame, separator: str, target: str) -> None:
    """Write placed rows that have their texts. The last block of a file has no separator behind it; any separator will do."""
    spark = rows.sparkSession
    spark.dataSource.register(PieceSource)
    sent_rows(placed, rows, separator).write.format(PieceSource.name()).mode("append").save(target)


def write_rows(rows: DataFrame, separator: str, target: str, task_bytes: int | None = None) -> None:
    """Write rows (project, file_name, section, seq, step, text), one output file over as many tasks as its bytes need.

    Each task writes its piece of a file to a folder piece=000000000042, twelve digits, so that names sort in
    text order for any number of tasks.
    """
    held = in_blocks(rows)
    placed = place(held.select(*_ORDER, F.octet_length("text").cast("long").alias("bytes"), "_at"), task_bytes)
    write_placed(placed, with_texts(held, placed.rows), separator, target)
