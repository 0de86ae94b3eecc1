"""The training-corpus pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents. Stages are written as Parquet and read again, so a lost
executor costs at most the stage that runs.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplattice.llm import bpe, decontam, nearcopies, queries, simhash, suffix, toxicity
from shoplattice.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words from which a repeated passage is cut, however few bytes it has.
PASSAGE = 51
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on this stage's labelled documents, doesn't reject."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.TOXIC_CHAIN)
    return toxicity.score(docs.select(COLUMNS), chain).where(F.col("toxicity.toxic") < queries.TOXIC_FROM).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near copies: candidates are texts whose SimHash
    fingerprints link at 3 or fewer differing bits, or that share a MinHash band; all are verified (five-word shingles 0.8 alike)."""
    docs = docs.select(COLUMNS)
    return nearcopies.one_of_each(docs, simhash.groups(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of strings and the passages of over 50 words that repeat; a character cut in two
    goes with them."""
    cut = suffix.remove_repeats(docs.select(COLUMNS), as_text=True, words=PASSAGE)
    return cut.select("doc_id", F.col("cut.kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text's token ids (packed 32-bit integers), their number, and the text decoded from them."""
    path = public_tokenizers.path(queries.RANKS)
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
