"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that one call of a row function gets (a single longer text comes alone).
SLICE_BYTES = 8 << 20
# ASCII white space, as bytes.split() takes it.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about `most` bytes of the column; no rows for an empty batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def map_slices(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
               most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow whose function, made once per task, gets slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or make()
            for part in sliced(batch, column, most):
                yield each(part)

    return df.mapInArrow(run, schema)


def octets(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def texts(column: pa.Array) -> pa.StringArray:
    """Bytes as text; what is not UTF-8 is replaced."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode(errors="replace") for t in column.to_pylist()], pa.string())


def present(value: Column) -> Column:
    """A value as text that is never null; text sorts as before, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
