"""Writers: idempotent version replacement, feature upsert, write-back, exports, logs."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from shoplattice.functions.scalars import normalise_query, ntz

SAMPLE_RATE_PCT = 15


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_version(df: DataFrame, path: str, version_column: str = "model_version") -> None:
    """Overwrite only the version partitions present in ``df``; a rerun gives the same table."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(version_column).parquet(path))


def upsert_features(stored: DataFrame, fresh: DataFrame, entity: str, version: str = "feature_version") -> DataFrame:
    """Drop every stored feature of the (entity, version) pairs in ``fresh``, then add ``fresh``."""
    keys = fresh.select(entity, version).distinct()
    return stored.join(keys, [entity, version], "left_anti").unionByName(fresh)


def write_back(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``base`` with ``columns`` replaced wherever ``updates`` has a value."""
    renamed = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.select(*[
        F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def impression_rows(served: DataFrame, surface: str, version: str, served_at: datetime) -> DataFrame:
    """Log rows for a served list (user_id, product_id, rank, score, strategy)."""
    return served.select(
        "user_id", "product_id", F.lit(surface).alias("surface"), "strategy", F.lit(version).alias("model_version"),
        F.col("score").cast("double").alias("score"), "rank",
        F.lit(False).alias("clicked"), F.lit(False).alias("converted"), ntz(served_at).alias("served_at"))


def search_log_rows(searches: DataFrame) -> DataFrame:
    """Log rows for (user_id, query, result_count, latency_ms, occurred_at); texts are kept to 255 characters."""
    return searches.select(
        "user_id", F.left("query", F.lit(255)).alias("query"),
        F.left(normalise_query("query"), F.lit(255)).alias("normalized_query"),
        "result_count", "latency_ms", "occurred_at")


def sampled_predictions(predictions: DataFrame, rate_pct: int = SAMPLE_RATE_PCT) -> DataFrame:
    """Every failed call and a fixed hash sample of the rest (a rerun keeps the same rows)."""
    keep = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return predictions.where(~F.col("succeeded") | (keep < rate_pct))
