"""Ranked lexical search as a maximum inner product search over buckets of impact vectors ordered by length.

A document's impact vector has w * ((10^9 tf) div (1000 tf + 8 m)) under each of its terms, a query is one under each of
its own; their inner product is the score. Vectors are ordered by length and read in buckets. A query passes over a
bucket if its own length times the longest vector's is below the query's threshold (Cauchy-Schwarz), or if the sum of
the bucket's largest values under its terms is. Inside a bucket, its terms are split so that those of the rest can't
reach the threshold by themselves: only vectors with one of the focus terms are looked at, and each is bounded by its
values under them plus the smaller of the rest's largest values and Cauchy-Schwarz over what is left of its length.
Survivors are scored again in 64-bit integers. A pass over the longest vectors of all gives the first thresholds.

Queries are worked in blocks of about ``TERMS`` terms, each against all documents, so that what goes to every task is
bounded; a task holds k results for each query of the block.

Defined results: null and wordless texts are no documents and wordless items have no results; rows with a null doc_id
come last among equal scores; repeated rows are documents of their own, and so are repeated items; an empty corpus gives
no rows; other columns are not read.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplattice.llm.common import slices, utf8
from shoplattice.session import materialise

TOP = 10
#: Distinct terms of a block's queries, summed over them.
TERMS = 200_000
BUCKET = 1024
#: The share of longest vectors that gives the first thresholds.
HEAD = 0.02
_LAST = (1 << 63) - 1
_SLACK = 1 - 1e-9
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


class Queries:
    """A block's queries: their numbers and, one after the other, the numbers of their distinct terms."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]) -> None:
        self.numbers = np.array([number for number, _ in rows], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        sets = [np.array(sorted({self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found}), np.int64) for _, found in rows]
        self.sets, self.sizes = sets, np.array(list(map(len, sets)), np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """did, n (terms with repeats) and, packed, the numbers and frequencies of the document's terms that queries have."""
    names = ["did", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths, numbers, counts = [], [], []
            for text in utf8(batch.column("text")):
                found = terms(text)
                known = np.array([at for at in map(vocabulary.get, found) if at is not None], np.int32)
                which, tf = np.unique(known, return_counts=True)
                lengths.append(len(found))
                numbers.append(which.astype("<i4").tobytes())
                counts.append(tf.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(counts, pa.binary())], names)

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "did bigint, n bigint, terms binary, tfs binary").where("n > 0")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """The number of documents with each of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "n"])

    total = np.zeros(size, np.int64)
    summed = counted.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most the block's terms
        total[row.term] = row.n
    return total


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """did, terms, ``impacts`` (packed 64-bit) and the vector's ``length``."""
    names = ["did", "terms", "impacts", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            impacts, lengths = [], []
            for n, which, tf in zip(batch.column("n").to_pylist(), batch.column("terms").to_pylist(), batch.column("tfs").to_pylist()):
                tf = np.frombuffer(tf, "<i4").astype(np.int64)
                m = 100 - 90 + 90 * n * n_docs // n_terms
                values = weights[np.frombuffer(which, "<i4")] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                impacts.append(values.astype("<i8").tobytes())
                lengths.append(float(np.sqrt(np.square(values.astype(np.float64)).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("terms"), pa.array(impacts, pa.binary()), pa.array(lengths, pa.float64())], names)

    return counted.where("octet_length(terms) > 0").mapInArrow(run, "did bigint, terms binary, impacts binary, length double").where("length > 0")


class Bucket:
    """Vectors of similar length, by row and by term."""

    def __init__(self, dids: np.ndarray, rows: list[bytes], impacts: list[bytes], lengths: np.ndarray, size: int) -> None:
        self.dids, self.squares, self.longest = dids, lengths * lengths, float(lengths.max())
        self.terms = np.frombuffer(b"".join(rows), "<i4").astype(np.int64)
        self.values = np.frombuffer(b"".join(impacts), "<i8")
        counts = np.array([len(r) // 4 for r in rows], np.int64)
        self.row_at = np.concatenate(([0], np.cumsum(counts)))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.by_row = self.values[order].astype(np.float64), np.repeat(np.arange(len(rows)), counts)[order]
        self.term_at = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=size))))
        self.largest = np.zeros(size)
        held = np.flatnonzero(np.diff(self.term_at))
        self.largest[held] = np.maximum.reduceat(self.by_term, self.term_at[held])

    def candidates(self, wanted: np.ndarray, threshold: float) -> np.ndarray:
        """Rows that may reach ``threshold`` under the terms ``wanted``."""
        wanted = wanted[np.argsort(self.largest[wanted])]
        wanted = wanted[self.largest[wanted] > 0]
        below = np.cumsum(self.largest[wanted])
        rest = int((below < threshold * _SLACK).sum())  # the terms up to here can't reach it by themselves
        if rest == len(wanted):
            return np.zeros(0, np.int64)
        focus = [slice(self.term_at[t], self.term_at[t + 1]) for t in wanted[rest:].tolist()]
        rows, values = np.concatenate([self.by_row[s] for s in focus]), np.concatenate([self.by_term[s] for s in focus])
        part, square = np.bincount(rows, values, len(self.dids)), np.bincount(rows, values * values, len(self.dids))
        if rest:
            left = np.sqrt(rest * np.maximum(self.squares - square, 0) * (2 - _SLACK))
            reach = part + np.minimum(below[rest - 1], left)
        else:
            reach = part
        return np.flatnonzero((part > 0) & (reach >= threshold * _SLACK))

    def scores(self, rows: np.ndarray, member: np.ndarray) -> np.ndarray:
        """The rows' scores in integers; ``member`` marks the query's terms."""
        begin, count = self.row_at[rows], self.row_at[rows + 1] - self.row_at[rows]
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        values = np.where(member[self.terms[at]], self.values[at], 0)
        return np.add.reduceat(values, np.concatenate(([0], np.cumsum(count)[:-1]))) if len(rows) else np.zeros(0, np.int64)


def _best(dids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((dids, -scores))[:top]
    return dids[order], scores[order]


def _search(impacts: DataFrame, queries: Queries, thresholds: np.ndarray, top: int) -> DataFrame:
    """``number``, did and score of each task's best vectors of each query, none below the query's threshold."""
    size, names = len(queries.vocabulary), ["number", "did", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = thresholds.astype(np.int64).copy()
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        member = np.zeros(size, bool)
        for batch in slices(batches, BUCKET):
            bucket = Bucket(batch.column("did").to_numpy(), batch.column("terms").to_pylist(), batch.column("impacts").to_pylist(),
                            batch.column("length").to_numpy(), size)
            reach = np.minimum(np.sqrt(queries.sizes) * bucket.longest, np.add.reduceat(bucket.largest[queries.flat], queries.starts))
            for query in np.flatnonzero((reach >= bar * _SLACK) & (reach > 0)).tolist():
                wanted = queries.sets[query]
                rows = bucket.candidates(wanted, float(bar[query]))
                member[wanted] = True
                scores = bucket.scores(rows, member)
                member[wanted] = False
                kept = (scores >= bar[query]) & (scores > 0)
                if kept.any():
                    dids, scores = bucket.dids[rows[kept]], scores[kept]
                    if query in found:
                        dids, scores = np.concatenate((found[query][0], dids)), np.concatenate((found[query][1], scores))
                    found[query] = dids, scores = _best(dids, scores, top)
                    if len(scores) == top:
                        bar[query] = max(bar[query], scores[-1])
        if found:
            numbers = np.concatenate([np.full(len(dids), queries.numbers[query]) for query, (dids, _) in found.items()])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *(pa.array(np.concatenate([pair[side] for pair in found.values()])) for side in (0, 1))], names)

    ordered = impacts.sortWithinPartitions(F.desc("length"))
    return ordered.mapInArrow(run, "number bigint, did bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "did"))
    return found.withColumn("rank", nth).where(F.col("rank") <= top)


def _block(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    counted = materialise(_counted(docs, queries.vocabulary), "search-terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(n_docs, int(df)) for df in _frequencies(counted, len(queries.vocabulary))], np.int64)
    impacts = materialise(_impacts(counted, weights, n_docs, n_terms), "impact-vectors")
    head = impacts.agg(F.percentile_approx("length", 1 - HEAD, 1000)).first()[0]
    none = np.zeros(len(queries.numbers), np.int64)
    if head is None:
        return _search(impacts, queries, none, top)
    longest = materialise(_ranked(_search(impacts.where(F.col("length") >= head), queries, none, top), top).select("number", "did", "score"), "longest-vectors")
    least = {row.number: row.score for row in longest.groupBy("number").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= top).collect()}  # one row a query
    bars = np.array([least.get(number, 0) for number in queries.numbers.tolist()], np.int64)
    return longest.union(_search(impacts.where(F.col("length") < head), queries, bars, top))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` documents with a score above 0 of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(set(terms(text))) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["number", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    source = items.select(F.monotonically_increasing_id().alias("number"), "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = materialise(source.mapInArrow(run, f"number bigint, item_id {kind}, terms array<binary>").where(F.size("terms") > 0), "search-items")
    blocks = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / TERMS)
    results = []
    for block in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "terms").collect()  # about TERMS terms
        if here:
            results.append(_block(docs, Queries([(row.number, [bytes(t) for t in row.terms]) for row in here]), top))
    if not results:
        return asked.select("item_id", F.lit(1).alias("rank"), F.col("number").alias("doc_id"), F.col("number").alias("score")).where("false")
    best = _ranked(reduce(DataFrame.union, results), top)
    return best.join(asked.select("number", "item_id"), "number").select(
        "item_id", "rank", F.when(F.col("did") != _LAST, F.col("did")).alias("doc_id"), "score")


def sql(top: int = TOP) -> str:
    """The same in SQL over ``documents`` and ``benchmark``."""
    words = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')")
    return f"""
        WITH d AS (SELECT doc_id, {words} AS t FROM documents), held AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
        totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM held),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
        impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))) AS v FROM tf JOIN w USING (term), totals),
        q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(v) > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {top}"""
