"""Compressed vector codes; the nearest codebook entry is found by slicing sorted coordinates and intersecting bitmasks.

A vector of whole numbers is cut into equal parts, and each part is replaced by the number of its nearest entry in that
part's codebook. For every dimension of a codebook its entries are sorted, and each place in that order carries the mask
of the entries before it. A radius around a coordinate selects a range of places: two prefix masks, XORed, are the
entries within it. The ranges of all dimensions, ANDed as uint64 words, leave every entry that can lie within the
radius, and only these are measured. The first radius is a part of the distance to the nearest of a few pivots; where no
entry is found within it, the best distance known is the second radius, which can't miss the nearest. Results are exact.

Each round is one pass over the table; a task sends the sums of its parts by entry, not rows. Codebooks hold ENTRIES
entries at each part, so that only they go through the driver.

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped; so is one whose length
differs from that of the vector with the smallest vec_id, or isn't a multiple of the number of parts. Whole numbers beyond
``MOST`` count as ``MOST``. Rows with a null vec_id come after all others, repeated ids in the order of their vectors;
repeated rows come back repeated. With fewer vectors than entries the codebooks are smaller. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplattice.session import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Largest whole number: squares of differences over 4,096 dimensions stay within 64 bits.
MOST = 1 << 24
#: Entries whose distance gives the first radius, and the share of it that is tried first.
PIVOTS, SHARE = 32, 0.5
_ROWS = 4096
_SPAN = 1 << 14


class Slices:
    """A codebook's sorted coordinates with the masks of the entries before each place."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.most = entries, int(np.abs(entries).max())
        count, width = entries.shape
        words = -(-count // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        bits = np.zeros((count, words), np.uint64)
        bits[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.sorted = [np.ascontiguousarray(entries[order[:, d], d]) for d in range(width)]
        self.before = [np.concatenate((np.zeros((1, words), np.uint64), np.bitwise_or.accumulate(bits[order[:, d]]))) for d in range(width)]
        self.pivots = np.unique(np.linspace(0, count - 1, min(PIVOTS, count)).astype(np.int64))
        #: Where coordinates span few values, the masks stand under every value, so that no search is needed.
        self.dense = [before[places.searchsorted(np.arange(places[0], places[-1] + 2))] if places[-1] - places[0] < _SPAN else None
                      for places, before in zip(self.sorted, self.before)]

    def _prefix(self, d: int, bound: np.ndarray) -> np.ndarray:
        """Mask words of the entries whose coordinate is below ``bound``."""
        places, dense = self.sorted[d], self.dense[d]
        if dense is None:
            return self.before[d][places.searchsorted(bound)]
        return dense[np.clip(bound - places[0], 0, len(dense) - 1)]

    def within(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words of the entries whose every coordinate is at most ``radius`` away."""
        left = np.full((len(rows), self.before[0].shape[1]), ~np.uint64(0))
        for d in range(len(self.sorted)):
            left &= self._prefix(d, rows[:, d] + radius + 1) ^ self._prefix(d, rows[:, d] - radius)
        return left

    def _measured(self, rows: np.ndarray, exact: np.ndarray, radius: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Lowers ``best`` (and sets ``entry``) by the entries that the masks leave; ties go to the lower index."""
        chosen = np.ascontiguousarray(np.unpackbits(self.within(rows, radius).view(np.uint8), axis=1, bitorder="little").T)
        for number, content in enumerate(self.entries.astype(exact.dtype)):
            at = np.flatnonzero(chosen[number])
            if len(at):
                apart = exact.take(at, axis=0, mode="clip")
                apart -= content
                far = np.einsum("ij,ij->i", apart, apart)
                nearer = (far < best[at]) | ((far == best[at]) & (number < entry[at]))
                best[at[nearer]], entry[at[nearer]] = far[nearer], number

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every row."""
        reach = max(self.most, int(np.abs(rows).max(initial=0)))
        largest = 4 * reach * reach * rows.shape[1]
        exact = rows.astype(np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64)  # without rounding
        best, entry = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.entries))
        for number in self.pivots:
            apart = exact - self.entries[number].astype(exact.dtype)
            far = np.einsum("ij,ij->i", apart, apart).astype(np.int64)
            nearer = far < best
            best[nearer], entry[nearer] = far[nearer], number
        tried = (np.sqrt(best.astype(np.float64)) * SHARE).astype(np.int64)
        self._measured(rows, exact, tried, best, entry)
        open_ = np.flatnonzero(best > tried * tried)
        if len(open_):
            left, near = best[open_], entry[open_]
            radius = np.sqrt(left.astype(np.float64)).astype(np.int64) + 1
            self._measured(rows[open_], exact[open_], radius, left, near)
            best[open_], entry[open_] = left, near
        return entry, best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and ``v``, the components as whole numbers, of every vector that can be coded."""
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(values, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & (F.size("embedding") % parts == 0))
    kept = kept.select("vec_id", "label", whole.alias("v"))
    # one row: the length of the first vector
    first = kept.agg(F.min(F.struct(F.col("vec_id").isNull().alias("null"), "vec_id", F.col("v").alias("v"))).alias("f")).select(F.size("f.v").alias("length"))
    return kept.where(F.size("v") == first.scalar())


def first_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows
    width = len(rows[0].v) // parts if rows else 0
    books = np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, width)
    return books.transpose(1, 0, 2)


def _sums(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, ``at`` (place in the part), total and n of the parts next to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                rows = _matrix(batch.column("v").slice(begin, _ROWS)).astype(np.int64).reshape(-1, parts, width)
                for part in range(parts):
                    here = np.ascontiguousarray(rows[:, part])
                    entry, _ = slices[part].nearest(here)
                    order = np.argsort(entry, kind="stable")
                    first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                    total[part][entry[order][first]] += np.add.reduceat(here[order], first, axis=0)
                    n[part] += np.bincount(entry, minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), total[part, entry].ravel(), np.repeat(n[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "at", "total", "n"])

    return whole.select("v").mapInArrow(run, "part bigint, entry bigint, at bigint, total bigint, n bigint")


def codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, width) after ``rounds`` rounds; each entry is the floored mean of the parts next to it."""
    books = first_codebooks(whole, parts, entries)
    for _ in range(rounds if books.size else 0):
        sums = _sums(whole, books).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        found = sums.toPandas()  # at most the codebooks' size
        part, entry, at = (found[c].to_numpy(np.int64) for c in ("part", "entry", "at"))
        books = books.copy()
        books[part, entry, at] = found["total"].to_numpy(np.int64) // found["n"].to_numpy(np.int64)
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, ``code`` (two hex digits a part) and ``error``, the squared distances to the entries, summed."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits number 256 entries")
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                some = batch.slice(begin, _ROWS)
                rows = _matrix(some.column("v")).astype(np.int64).reshape(-1, parts, width)
                codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for part in range(parts):
                    entry, far = slices[part].nearest(np.ascontiguousarray(rows[:, part]))
                    codes[:, part] = entry
                    error += far
                digits = codes.tobytes().hex()
                code = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(error)], names)

    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return whole.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``v``, the whole numbers that the code stands for."""
    table = [[F.array(*(F.lit(int(x)) for x in entry)) for entry in book] for book in books]
    pieces = [F.element_at(F.array(*entries), F.conv(F.substring("code", 2 * at + 1, 2), 16, 10).cast("int") + 1) for at, entries in enumerate(table)]
    return codes.withColumn("v", F.concat(*pieces))


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The coded vectors, with ``label_error`` (their errors summed over equal labels, nulls together), and the codebooks."""
    whole = materialise(whole_vectors(vectors, parts), "whole-vectors")
    books = codebooks(whole, parts, entries, rounds)
    coded = materialise(encode(whole, books), "vector-codes") if books.size else whole.select(
        "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(F.col("__label"))).drop("__label"), books


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for the query's columns, in SQL over ``embeddings`` of one length."""
    near = """SELECT vec_id, part, x, arg_min(entry, far * 65536 + entry) AS entry, min(far) AS far FROM (
            SELECT vec_id, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
            FROM p JOIN book{} USING (part)) GROUP BY vec_id, part, x"""
    steps = []
    for turn in range(1, rounds + 1):
        steps.append(f"""near{turn} AS MATERIALIZED ({near.format(turn - 1)}),
        mean{turn} AS (SELECT part, entry, list(mean ORDER BY nth) AS c FROM (
            SELECT part, entry, nth, CAST(floor(sum(y) / count(*)) AS BIGINT) AS mean FROM (
                SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS nth FROM near{turn}) GROUP BY part, entry, nth) GROUP BY part, entry),
        book{turn} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{turn - 1} b LEFT JOIN mean{turn} m USING (part, entry))""")
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
            FROM kept, (SELECT unnest(range({parts})) AS part)),
        book0 AS MATERIALIZED (SELECT part, x AS c, entry FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}),
        {", ".join(steps)},
        last AS ({near.format(rounds)}),
        coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY vec_id),
        labelled AS (SELECT vec_id, code, error, label FROM coded JOIN kept USING (vec_id))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM labelled"""
