"""A stored inverted index that is refreshed by deltas.

Postings are kept by term bucket, so that a search reads the buckets of its terms only. A refresh writes the postings of the
changed documents as a new generation and one tombstone for each changed or removed document; nothing stored before is
read or rewritten. Readers drop postings of a generation older than the document's newest tombstone. ``compact`` folds
all generations into one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoplattice.constants import BM25_B, BM25_K1, CANDIDATE_POOL
from shoplattice.functions.grouped import salted_join, top_k
from shoplattice.functions.scalars import tokens
from shoplattice.operators.search import postings

BUCKETS = 64
POSTINGS = "id long, term string, tf long, doc_len int, generation long, bucket int"
LENGTHS = "id long, doc_len int, generation long"
GONE = "id long, generation long"


def _write(spark: SparkSession, path: str, generation: int, changed: DataFrame, gone: DataFrame) -> None:
    """One generation; written again after a failure it replaces itself."""
    rows = postings(changed).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    columns = rows.select("id", "term", "tf", "doc_len", "bucket").repartition("bucket")
    columns.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")
    lengths = changed.select("id", F.size(tokens("text")).alias("doc_len"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths/generation={generation}")
    gone.select("id").distinct().write.mode("overwrite").parquet(f"{path}/gone/generation={generation}")


def build(corpus: DataFrame, path: str) -> None:
    """The first generation of (id, text)."""
    _write(corpus.sparkSession, path, 0, corpus, corpus.select("id").where("false"))


def refresh(path: str, generation: int, changed: DataFrame, removed: DataFrame) -> None:
    """Generation ``generation`` (1, 2, ...): the new texts of changed or added documents (id, text) and the ids of removed ones."""
    _write(changed.sparkSession, path, generation, changed, changed.select("id").union(removed.select("id")))


def _live(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{path}/{table}")
    newest = spark.read.schema(GONE).parquet(f"{path}/gone").groupBy("id").agg(F.max("generation").alias("_gone"))
    return rows.join(newest, "id", "left").where(F.col("_gone").isNull() | (F.col("generation") >= F.col("_gone"))).drop("_gone")


def live_postings(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """(id, term, tf, doc_len) of every document's newest text; with ``buckets`` only of those."""
    live = _live(spark, path, "postings", POSTINGS)
    return (live if buckets is None else live.where(F.col("bucket").isin(buckets))).select("id", "term", "tf", "doc_len")


def live_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, doc_len) of every document."""
    return _live(spark, path, "lengths", LENGTHS).select("id", "doc_len")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = CANDIDATE_POOL, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, id, score, rank) by BM25 over the stored index; only the buckets of the queries' terms are read."""
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q_tf"))
    buckets = [r.b for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS
    facts = live_lengths(spark, path).agg(F.struct(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))).scalar()
    post = live_postings(spark, path, buckets).join(asked.select("term").distinct(), "term", "left_semi")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    terms = asked.join(df, "term").withColumns({"_n": facts["n"], "avg_len": facts["avg_len"]})
    terms = terms.withColumn("idf", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = k1 * (1 - b + b * F.col("doc_len") / F.coalesce(F.nullif("avg_len", F.lit(0.0)), F.lit(1.0)))
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + norm) * (1.0 + 0.15 * (F.col("q_tf") - 1))
    scored = salted_join(post, terms, ["term"], "id").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return top_k(scored, ["query_id"], [F.round("score", 6).desc(), F.col("id")], k)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """All generations as the first generation of an index in ``target``."""
    live_postings(spark, path).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.partitionBy(
        "bucket").parquet(f"{target}/postings/generation=0")
    live_lengths(spark, path).write.parquet(f"{target}/lengths/generation=0")
    spark.createDataFrame([], "id long").write.parquet(f"{target}/gone/generation=0")
