"""The vector index against exact search, the text vectors against a plain decomposition."""
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from shoplattice.operators import search as S, vectors as V


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id))
    return {q: [i for _, i in sorted(rows)] for q, rows in out.items()}


def test_index_recall(table):
    queries = table.select(F.col("id").alias("query_id"), "vector")
    index = V.build_index(table)
    got, want = found(V.search_index(index, queries, 10)), found(S.cosine_topk(queries, table, 10))
    assert 1 < len(index.centroids) and index.probes < len(index.centroids)
    assert len(got) == table.count() and all(len(ids) == 10 for ids in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_index_is_exact_over_all_cells_and_blocks(table, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    some = table.where("id < 120")
    queries = some.where("id % 3 = 0").select(F.col("id").alias("query_id"), "vector")
    index = V.build_index(some, lists=6)
    assert found(V.search_index(index, queries, 5, probes=6)) == found(S.cosine_topk(queries, some, 5))


def test_short_lists_are_refilled(spark, table):
    some = table.where("id < 100")
    queries = some.where("id < 9").select(F.col("id").alias("query_id"), "vector")
    index = V.build_index(some, lists=20)
    assert {len(ids) for ids in found(V.search_index(index, queries, 60, probes=1)).values()} == {60}
    allowed = queries.select("query_id").join(some.where("id % 7 = 0").select("id"))
    got = found(V.search_index(index, queries, 4, allowed, probes=1))
    assert set(got) == set(range(9)) and all(len(ids) == 4 and all(i % 7 == 0 for i in ids) for ids in got.values())
    zero = spark.createDataFrame([(1, [0.0] * 64)], "query_id long, vector array<double>")
    assert V.search_index(index, zero, 3).count() == 0


def test_index_edges(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert V.search_index(V.build_index(empty), queries, 3).count() == 0
    one = spark.createDataFrame([(5, [0.0, 2.0]), (6, [0.0, 0.0])], "id long, vector array<float>")
    assert {(r.id, round(r.score, 6)) for r in V.search_index(V.build_index(one), queries, 3).collect()} == {(5, 0.0), (6, 0.0)}


def test_text_vectors_span_the_leading_subspace(tables):
    texts = S.product_text(tables.products)
    fitted = V.fit_text_embedder(texts, dim=16)
    rows = V.sparse_rows(texts, fitted.features, fitted.idf).orderBy("id").collect()
    plain = np.zeros((len(rows), len(fitted.features)))
    for line, r in zip(plain, rows):
        line[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["weight"], "<f8")
    _, singular, right = np.linalg.svd(plain, full_matrices=False)
    assert np.allclose(fitted.singular, singular[:16], rtol=0.01)
    assert np.linalg.norm(plain @ fitted.directions) >= 0.999 * np.linalg.norm(plain @ right[:16].T)
    want = plain @ fitted.directions
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.id: r.vector for r in fitted(texts).collect()}
    assert np.allclose([got[r.id] for r in rows], want)
    assert V.fit_text_embedder(texts).directions.shape[1] == min(128, len(rows) - 1)


def test_vectors_meet_centroids_in_small_parts():
    whole = pd.DataFrame({"id": np.arange(10_000)})
    parts = list(V._parts(iter([whole, whole.iloc[:0]])))
    assert max(map(len, parts)) <= V.SLICE and pd.concat(parts).equals(whole)


def test_rows_of_one_small_file_are_spread_over_all_cores(spark):
    """Products pack into one file and would be read, and all their grams made, in one task."""
    texts = spark.range(300).select("id", F.concat(F.lit("The fine pen of "), F.col("id") % 7).alias("text")).coalesce(1)
    rows = V.sparse_rows(texts, {"fine": 0, "fine pen": 1, "#the": 2, "# pen ": 3, "the": 4}, np.ones(5))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = rows.first()
    assert np.frombuffer(got["at"], "<i4").tolist() == [0, 1, 2, 3] and np.allclose(np.frombuffer(got["weight"], "<f8"), 0.5 ** 0.5)
