"""Packing token ids into rows of one length, best fit decreasing.

Documents longer than a row are split without loss into full rows and a rest. The other pieces, longest first, go each
to the open row with the least room that still holds it, which a segment tree over capacities finds in logarithmic time.
A row holds its ids (padded), the cumulative lengths of its segments and position ids that start anew at each segment.

Each task packs its documents in blocks of about ``BLOCK_TOKENS``, so memory is bounded, nothing is shuffled, and only
the last rows of a block are less full. A document's pieces all stay in one block unless it alone is larger than that.

Defined results: every document ends with an end token, so null and empty texts are one segment of one token; repeated
rows are packed as often as they occur; a null doc_id stays null; an empty table gives no rows; only doc_id and the ids
are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.llm.common import id_and_text, slices, utf8

ROW = 4096
BLOCK_TOKENS = 4_000_000
#: Ids of the byte vocabulary: 0 to 255 are bytes.
END, PAD = 256, 257
#: Bytes of an id in the byte vocabulary and as the BPE encoder packs it.
SHORT, LONG = 2, 4
_ROWS = 200


class Capacities:
    """Open rows by room left: a segment tree of counts whose leaves are the capacities 0 to ``most``."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, taken out: (room, row)."""
        node = need + self.leaves
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Indices of the pieces in each row; every size is between 1 and ``row``."""
    open_rows, packed = Capacities(row), []
    for piece in sorted(range(len(sizes)), key=lambda at: (-sizes[at], at)):
        found = open_rows.take(sizes[piece])
        room, to = found if found else (row, len(packed))
        if not found:
            packed.append([])
        packed[to].append(piece)
        if room > sizes[piece]:
            open_rows.add(room - sizes[piece], to)
    return packed


def byte_ids(docs: DataFrame) -> DataFrame:
    """doc_id and ``ids``: the text's UTF-8 bytes and the end token, as packed little-endian 16-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u2").tobytes()
        for batch in slices(batches):
            ids = [np.frombuffer(text, np.uint8).astype("<u2").tobytes() + end for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = id_and_text(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def ended(encoded: DataFrame, end: int) -> DataFrame:
    """doc_id and ``ids`` of the BPE encoder, with an end token after each document."""
    mark = F.lit(bytearray(np.array([end], "<u4").tobytes()))
    return encoded.select("doc_id", F.concat(F.coalesce("ids", F.lit(bytearray())), mark).alias("ids"))


def pack(documents: DataFrame, row: int = ROW, pad: int = PAD, width: int = SHORT) -> DataFrame:
    """Rows from documents (doc_id, ids as integers of ``width`` bytes): ``ids`` (``row`` of them, as wide) and ``positions``
    (packed 16-bit integers), ``cu_seqlens`` (0 and the end of each segment), and for each segment doc_id and its offset in
    the document."""
    if row > 1 << 16:
        raise ValueError("positions have 16 bits")
    if width not in (SHORT, LONG) or pad >> 8 * width:
        raise ValueError("ids have 2 or 4 bytes, which hold the padding")
    ids_kind = f"<u{width}"
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["ids", "positions", "cu_seqlens", "doc_ids", "offsets"]

    def packed(held: list[tuple[object, np.ndarray]]) -> Iterator[dict]:
        pieces = [(doc_id, ids[at:at + row], at) for doc_id, ids in held for at in range(0, len(ids), row)]
        for inside in best_fit_decreasing([len(ids) for _, ids, _ in pieces], row):
            ends = np.cumsum([0, *(len(pieces[p][1]) for p in inside)])
            ids, positions = np.full(row, pad, ids_kind), np.zeros(row, "<u2")
            for p, start, stop in zip(inside, ends, ends[1:]):
                ids[start:stop] = pieces[p][1]
                positions[start:stop] = np.arange(stop - start)
            yield {"ids": ids.tobytes(), "positions": positions.tobytes(), "cu_seqlens": ends.tolist(), "doc_ids": [pieces[p][0] for p in inside], "offsets": [pieces[p][2] for p in inside]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: pa.DataType = pa.int64()

        def batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            types = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
            some: list[dict] = []
            for each in rows:
                some.append(each)
                if len(some) == _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(names, types)], names)
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(names, types)], names)

        held, tokens = [], 0
        for batch in slices(batches):
            id_type = batch.column("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((doc_id, np.frombuffer(ids.as_py() or b"", ids_kind)))
                tokens += len(held[-1][1])
                if tokens >= BLOCK_TOKENS:
                    yield from batches_of(packed(held))
                    held, tokens = [], 0
        yield from batches_of(packed(held))

    return documents.select("doc_id", "ids").mapInArrow(run, f"ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, offsets array<bigint>")


def write(rows: DataFrame, path: str) -> None:
    """The packed matrix with its segment tables as Parquet files in a folder that all executors share."""
    rows.write.mode("overwrite").parquet(path)


def unpack(rows: DataFrame, width: int = SHORT) -> DataFrame:
    """doc_id, offset and ids (of ``width`` bytes) of every segment: what was packed."""
    segments = rows.select("ids", F.posexplode(F.arrays_zip("doc_ids", "offsets")).alias("nth", "segment"), "cu_seqlens")
    return segments.select(F.col("segment.doc_ids").alias("doc_id"), F.col("segment.offsets").alias("offset"), F.expr(
        f"substring(ids, {width} * cu_seqlens[nth] + 1, {width} * (cu_seqlens[nth + 1] - cu_seqlens[nth]))").alias("ids"))
