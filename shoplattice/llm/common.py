"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that are read, so that other columns can't clash with results."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def _returned() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it returns memory by its own rules


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task builds for a batch stays small too."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    _returned()
