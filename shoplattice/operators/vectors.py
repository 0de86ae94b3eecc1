"""Vector retrieval at scale: an inverted-file index over k-means cells, and text vectors from a randomised SVD.

Index: cells are fitted on a bounded, hash-picked sample, every vector is stored under its nearest cell, and a query looks
into its nearest cells only. How many is measured, not guessed: for sampled queries the exact neighbours are looked up
and the number of cells is chosen that would have held the wanted share of them. Lists that come out short (few rows in
the cells, or a filter) are refilled from the next cells, twice as many each time, until they are full or no cell is left.

Text vectors: rows stay sparse and distributed. Only features x (dim + spare) matrices exist beside them, with the number
of features bounded by ``MAX_FEATURES`` for each kind; nothing is features x features or documents x features.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoplattice.constants import STOPWORDS
from shoplattice.functions.grouped import block_topk, top_k
from shoplattice.operators.sentiment import CharNumbers, _spread, gram_counts, tokenised, word_grams
from shoplattice.session import materialise

#: Vectors that the cells are fitted on, queries that the number of probes is measured on.
FIT_ROWS, TUNE_QUERIES = 50_000, 256
MAX_LISTS = 4096
#: Vectors, and queries, of one cell that meet in one task.
BLOCK = 2048
#: Vectors that a task holds against all centroids, or repeats for their cells, at once.
SLICE = 128
#: Features of each kind that are kept, most frequent first, and directions beyond the wanted ones.
MAX_FEATURES, SPARE = 60_000, 10


# ---- inverted-file index ---------------------------------------------------
@dataclass(frozen=True)
class VectorIndex:
    """``cells``: (cell, id, vector of length 1 or 0); ``centroids``: one row a cell; ``probes``: cells a query looks into first."""

    cells: DataFrame
    centroids: np.ndarray
    probes: int


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.withColumn("_n", length).select("id", F.when(F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n"))).otherwise(F.col("vector")).alias("vector"))


def _some(rows: DataFrame, count: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``count`` rows, picked by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(max(1, count // wanted))) == 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts of ``SLICE`` rows, so that scores and repeated vectors of a whole batch never stand in memory."""
    for pdf in batches:
        for begin in range(0, len(pdf), SLICE):
            yield pdf.iloc[begin:begin + SLICE]


def build_index(vectors: DataFrame, lists: int | None = None, recall: float = 0.97, k: int = 10, seed: int = 7) -> VectorIndex:
    """Index of (id, vector); ``lists`` cells (default: the root of the row count, at most ``MAX_LISTS``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    unit = materialise(_unit(vectors, "id"), "unit-vectors")
    count = unit.count()
    wanted = min(lists or max(1, math.isqrt(count)), MAX_LISTS, max(1, count))
    if wanted > 1:
        sample = _some(unit, count, FIT_ROWS).select(array_to_vector("vector").alias("features"))
        centroids = np.array(KMeans(k=wanted, seed=seed, maxIter=10, initSteps=2).fit(sample).clusterCenters())
    else:
        centroids = np.zeros((1, len(unit.select("vector").first()[0]))) if count else np.zeros((0, 0))
    lengths = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = centroids / np.where(lengths > 0, lengths, 1.0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            yield pdf.assign(cell=(_matrix(pdf["vector"]) @ centroids.T).argmax(axis=1).astype(np.int32))

    cells = materialise(unit.mapInPandas(assign, "id long, vector array<double>, cell int"), "vector-cells")
    return VectorIndex(cells, centroids, _probes(cells, centroids, count, recall, k))


def _probes(cells: DataFrame, centroids: np.ndarray, count: int, recall: float, k: int) -> int:
    """The least number of cells that holds ``recall`` of the exact ``k`` neighbours of sampled vectors."""
    if not count:
        return 1
    asked = _some(cells, count, TUNE_QUERIES).select("id", "vector")
    near = block_topk(asked, cells.select("id", "vector"), k).select(F.col("query_id"), "id")
    pairs = near.join(cells.select("id", "cell"), "id").join(asked.select(F.col("id").alias("query_id"), "vector"), "query_id")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            scores = _matrix(pdf["vector"]) @ centroids.T
            mine = scores[np.arange(len(pdf)), pdf["cell"].to_numpy()]
            yield pd.DataFrame({"place": (scores > mine[:, None]).sum(axis=1)})

    counts = pairs.select("cell", "vector").mapInPandas(place, "place long").groupBy("place").agg(F.count("*").alias("n")).toPandas()  # a row a cell
    counts = counts.sort_values("place")
    held = counts["n"].cumsum() / counts["n"].sum()
    return int(counts["place"][held >= recall].min()) + 1


def _scored(asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each block for (query_id, query, cell): large cells are dealt into blocks of vectors and queries."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows"))
    loads = asked.groupBy("cell").agg(F.count("*").alias("asks"))
    shape = sizes.join(loads, "cell").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("turns"))
    spread = lambda column, count: F.pmod(F.xxhash64(column), F.col(count).cast("long")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    held = cells.join(shape, "cell").select("cell", spread("id", "parts").alias("part"), every("turns").alias("turn"), "id", "vector")
    asks = asked.join(shape, "cell").select("cell", every("parts").alias("part"), spread("query_id", "turns").alias("turn"), "query_id", "query")

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        scores = _matrix(queries["query"]) @ _matrix(rows["vector"]).T
        ids = rows["id"].to_numpy()
        chosen = [np.lexsort((ids, -line))[:k] for line in np.round(scores, 6)]
        return pd.DataFrame({
            "query_id": np.repeat(queries["query_id"].to_numpy(), [len(c) for c in chosen]), "id": ids[np.concatenate(chosen)],
            "score": np.concatenate([line[c] for line, c in zip(scores, chosen)])})

    keys = ["cell", "part", "turn"]
    return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, "query_id long, id long, score double")


def search_index(index: VectorIndex, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine for (query_id, vector). Every query gets ``k`` rows if there are so many to
    find; ``allowed`` (query_id, id) limits a query to its own ids. A zero vector finds nothing."""
    lists = len(index.centroids)
    if not lists:
        return queries.select(F.col("query_id").cast("long"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    asked = materialise(_unit(queries, "query_id").select(F.col("id").alias("query_id"), F.col("vector").alias("query")).where(
        F.exists("query", lambda x: x != 0)), "vector-queries")
    low, high, found, centroids = 0, min(probes or index.probes, lists), None, index.centroids
    left = asked
    while True:
        def nearest(batches: Iterator[pd.DataFrame], low: int = low, high: int = high) -> Iterator[pd.DataFrame]:
            for pdf in _parts(batches):
                order = np.argsort(-(_matrix(pdf["query"]) @ centroids.T), axis=1, kind="stable")[:, low:high]
                yield pd.DataFrame({"query_id": pdf["query_id"].repeat(order.shape[1]), "query": pdf["query"].repeat(order.shape[1]), "cell": order.ravel().astype(np.int32)})

        probed = left.mapInPandas(nearest, "query_id long, query array<double>, cell int")
        if allowed is None:
            now = _scored(probed, index.cells, k)
        else:
            now = _allowed_scores(probed, index.cells, allowed)
        found = now if found is None else found.union(now)
        found = materialise(top_k(found, ["query_id"], [F.round("score", 6).desc(), F.col("id")], k), "vector-hits")
        if high >= lists:
            return found
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        left = materialise(left.join(full, "query_id", "left_anti"), "short-lists")
        if left.isEmpty():
            return found
        low, high, found = high, min(lists, 2 * high), found.drop("rank")


def _allowed_scores(probed: DataFrame, cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scores of each query's own ids in its probed cells; the ids come first, so a cell's other rows are never met."""
    own = allowed.select("query_id", "id").join(cells, "id")
    pairs = own.join(probed, ["query_id", "cell"])
    return pairs.select("query_id", "id", F.aggregate(F.zip_with("query", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))


# ---- text vectors ----------------------------------------------------------
@dataclass(frozen=True)
class TextEmbedder:
    """Numbers and weights of the kept features, the directions (features x dim) and their singular values."""

    features: dict[str, int]
    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    def __call__(self, texts: DataFrame) -> DataFrame:
        """(id, vector) of (id, text): the weighted features along the directions, cut to length 1."""
        rows, directions = sparse_rows(texts, self.features, self.idf), self.directions

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, _ROWS):
                    some = batch.slice(begin, _ROWS)
                    y = _times(*_read(some), directions, some.num_rows)
                    n = np.linalg.norm(y, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(list(y / np.where(n > 0, n, 1.0)), pa.list_(pa.float64()))], ["id", "vector"])

        return rows.mapInArrow(project, "id long, vector array<double>")


_ROWS = 64


def sparse_rows(texts: DataFrame, features: dict[str, int], idf: np.ndarray) -> DataFrame:
    """(id, at, weight): packed feature numbers and sublinear tf-idf weights, each kind cut to length 1. Features are one- and
    two-word grams without stop words, and '#' with the three to five characters of each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, stop = CharNumbers(lambda gram: features.get(f"#{gram}")), frozenset(STOPWORDS)
        for batch in batches:
            at, weight = [], []
            for words in tokenised(batch.column("text").to_pylist()):
                met = word_grams([w for w in words if w not in stop])
                found = np.unique(np.array([n for n in map(features.get, met) if n is not None], np.int32), return_counts=True)
                parts = []
                for number, tf in (found, numbers.counts(Counter(words))):
                    value = (1 + np.log(tf)) * idf[number]
                    parts.append((number, value / (np.linalg.norm(value) or 1.0)))
                number, value = map(np.concatenate, zip(*parts))
                order = np.argsort(number)
                at.append(number[order].astype("<i4").tobytes())
                weight.append(value[order].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], ["id", "at", "weight"])

    return _spread(texts.select("id", F.lower("text").alias("text"))).mapInArrow(run, "id long, at binary, weight binary")


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of every entry."""
    at = batch.column("at").to_pylist()
    counts = np.array([len(a) // 4 for a in at], np.int64)
    return np.repeat(np.arange(len(at)), counts), np.frombuffer(b"".join(at), "<i4"), np.frombuffer(b"".join(batch.column("weight").to_pylist()), "<f8")


def _times(row: np.ndarray, at: np.ndarray, weight: np.ndarray, right: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows times ``right``."""
    out = np.zeros((rows, right.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(weight[:, None] * right[at], first, axis=0)
    return out


def _pulled_back(rows: DataFrame, right: np.ndarray, blocks: int = 256, chunk: int = 64) -> np.ndarray:
    """AᵀA times ``right`` over the sparse rows A: each block of rows sends its sums in chunks of features, at most
    ``blocks`` times the size of ``right`` in all."""
    size, width = right.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((size, width)), np.zeros(size, bool)
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                some = batch.slice(begin, _ROWS)
                row, at, weight = _read(some)
                y = _times(row, at, weight, right, some.num_rows)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(first):
                    held = at[order][first]
                    total[held] += np.add.reduceat(weight[order][:, None] * y[row[order]], first, axis=0)
                    touched[held] = True
        for begin in range(0, size, chunk):
            if touched[begin:begin + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([begin]), pa.array([total[begin:begin + chunk].tobytes()], pa.binary())], ["begin", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(part, np.float64) for part in pdf["sums"])
        return pd.DataFrame({"begin": pdf["begin"].iloc[:1], "sums": [total.tobytes()]})

    parts = rows.coalesce(blocks).mapInArrow(run, "begin long, sums binary").groupBy("begin").applyInPandas(added, "begin long, sums binary")
    out = np.zeros((size, width))
    for part in parts.toLocalIterator():  # features x width in all
        values = np.frombuffer(part.sums, np.float64).reshape(-1, width)
        out[part.begin:part.begin + len(values)] = values
    return out


def _gram_of(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """(A right)ᵀ(A right): a width x width sum over blocks."""
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                some = batch.slice(begin, _ROWS)
                y = _times(*_read(some), right, some.num_rows)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "value"])

    found = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(width * width)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out.reshape(width, width)


def fit_text_embedder(texts: DataFrame, dim: int = 128, max_features: int = MAX_FEATURES, min_df: int = 1, rounds: int = 4, seed: int = 7) -> TextEmbedder:
    """Word 1-2 and character 3-5 gram sublinear TF-IDF reduced by a randomised SVD.

    A random features x (dim + SPARE) start is multiplied by AᵀA ``rounds`` times, made orthonormal by a QR each time; the
    small Gram matrix of the rows along it then gives the directions and singular values.
    """
    written = materialise(texts.select("id", "text"), "embed-texts")
    count = written.count()
    is_char = F.col("kind") == "char"
    counted = gram_counts(_spread(written), STOPWORDS).where(F.col("df") >= F.when(is_char, max(min_df, 2)).otherwise(min_df)).select(
        "kind", F.when(is_char, F.concat(F.lit("#"), "gram")).otherwise(F.col("gram")).alias("gram"), "df", "tf")
    kept = top_k(counted, ["kind"], [F.col("tf").desc(), F.col("gram")], max_features).select("gram", "df").toPandas()  # 2 x max_features rows
    kept = kept.sort_values("gram", ignore_index=True)
    features = {gram: number for number, gram in enumerate(kept["gram"])}
    idf = np.log((1 + count) / (1 + kept["df"].to_numpy(np.float64))) + 1
    width = min(dim + SPARE, len(features), max(1, count))
    wanted = max(1, min(dim, max(2, min(count, len(features)) - 1), width))
    rows = materialise(sparse_rows(written, features, idf), "sparse-rows")
    right = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(features), width)))[0]
    for _ in range(rounds):
        right = np.linalg.qr(_pulled_back(rows, right))[0]
    values, turns = np.linalg.eigh(_gram_of(rows, right))
    best = np.argsort(-values)[:wanted]
    directions = right @ turns[:, best]
    return TextEmbedder(features, idf, directions, np.sqrt(np.maximum(values[best], 0.0)))

