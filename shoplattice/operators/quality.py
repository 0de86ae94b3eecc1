"""Data-quality rules as DataFrames of violations."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import EVENT_TYPES, ORDER_STATUSES
from shoplattice.functions.grouped import top_k

MINIMUM_ROWS = {
    "products": 10, "users": 5, "events": 50, "order_items": 20, "reviews": 20, "daily_demand": 20,
}


def minimum_rows(frames: Mapping[str, DataFrame], minimum: Mapping[str, int] = MINIMUM_ROWS) -> DataFrame:
    """(dataset, rows, minimum, ok) for every frame."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(minimum.get(name, 0)).alias("minimum"))
        for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("rows") >= F.col("minimum"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def value_problems(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Duplicate product ids, negative prices, ratings outside 1-5."""
    dup = products.groupBy("id").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long").alias("violations"))
    neg = products.agg(F.count_if(F.col("price") < 0).alias("violations"))
    bad = reviews.agg(F.count_if(~F.col("rating").between(1, 5)).alias("violations"))
    return (dup.select(F.lit("products: duplicate ids").alias("problem"), "violations")
            .unionByName(neg.select(F.lit("products: negative prices").alias("problem"), "violations"))
            .unionByName(bad.select(F.lit("reviews: ratings outside 1-5").alias("problem"), "violations")))


def table_rules() -> dict[str, dict[str, Column]]:
    """Row rules every table must satisfy; a rule is a predicate that holds for good rows."""
    c = F.col
    return {
        "brands": {"reputation_in_unit_range": c("reputation_score").between(0, 1)},
        "products": {
            "price_not_negative": c("price") >= 0,
            "discount_below_100": (c("discount_pct") >= 0) & (c("discount_pct") < 100),
            "inventory_not_negative": c("inventory") >= 0,
            "rating_in_range": c("rating_avg").between(0, 5),
        },
        "users": {
            "price_sensitivity_in_unit_range": c("price_sensitivity").between(0, 1),
            "role_known": c("role").isin("customer", "admin", "analyst"),
        },
        "orders": {"total_not_negative": c("total_amount") >= 0, "status_known": c("status").isin(*ORDER_STATUSES)},
        "order_lines": {"quantity_positive": c("quantity") > 0, "unit_price_not_negative": c("unit_price") >= 0},
        "reviews": {
            "rating_in_range": c("rating").between(1, 5),
            "label_known": c("sentiment_label").isNull()
            | c("sentiment_label").isin("positive", "neutral", "negative"),
        },
        "raw_events": {"event_type_known": c("event_type").isin(*EVENT_TYPES), "quantity_positive": c("quantity") >= 1},
    }


UNIQUE_RULES = {
    "categories": ("slug",), "products": ("id",), "orders": ("id",), "reviews": ("product_id", "user_id"),
}


def check_rules(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """(table, rule, rows, violations): all rules of a table in one pass."""
    agg = df.agg(F.count("*").alias("rows"), *[
        F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]))
    return agg.select("rows", pairs.alias("p")).select(
        F.lit(table).alias("table"), F.col("p.rule").alias("rule"), "rows", F.col("p.violations").alias("violations"))


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("violations")).select(
        F.lit(table).alias("table"), F.lit("unique_" + "_".join(keys)).alias("rule"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("violations", F.lit(0)).alias("violations"))


def missing_references(df: DataFrame, key: str, target: DataFrame, target_key: str = "id") -> DataFrame:
    """Rows whose non-null ``key`` has no match in ``target``."""
    refs = target.select(F.col(target_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(refs, key, "left_anti")


def validate_events(events: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Events with ``reason``: null for accepted rows, otherwise the first rule broken."""
    p = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_has_p"))
    u = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_has_u"))
    joined = events.join(p, "product_id", "left").join(u, "user_id", "left")
    reason = (
        F.when(~F.col("event_type").isin(*EVENT_TYPES),
               F.concat(F.lit("Unknown event_type '"), F.col("event_type"), F.lit("'.")))
        .when(F.col("product_id").isNotNull() & F.col("_has_p").isNull(),
              F.concat(F.lit("Product "), F.col("product_id"), F.lit(" was not found.")))
        .when(F.col("user_id").isNotNull() & F.col("_has_u").isNull(),
              F.concat(F.lit("User "), F.col("user_id"), F.lit(" was not found.")))
        .when(F.col("quantity") < 1, "quantity must be at least 1."))
    return joined.withColumn("reason", reason).drop("_has_p", "_has_u")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    return (validated.where(F.col("reason").isNull()).drop("reason"),
            validated.where(F.col("reason").isNotNull()))


def first_review_per_pair(reviews: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One review per (product, user): the earliest new one, and none where a review exists already."""
    fresh = reviews if existing is None else reviews.join(
        existing.select("product_id", "user_id").distinct(), ["product_id", "user_id"], "left_anti")
    return top_k(fresh, ["product_id", "user_id"], [F.col("created_at"), F.col("id")], 1, rank="_n").drop("_n")


class DataQualityError(ValueError):
    pass


def training_gate(report: DataFrame) -> None:
    """Raise when a ``minimum_rows`` or rule report holds a problem (the report has one row per rule)."""
    bad = "NOT ok" if "ok" in report.columns else "violations > 0"
    problems = report.where(bad).collect()
    if problems:
        raise DataQualityError("; ".join(str(r.asDict()) for r in problems))
