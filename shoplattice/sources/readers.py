"""Scans: explicit column lists, lenient JSON and timestamp decoding, pushed-down time filters."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import REVENUE_STATUSES
from shoplattice.functions.scalars import ntz


def lenient_json(text: Column | str, schema: str) -> Column:
    """Decoded value, or null where the text is not valid JSON."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def json_number(text: Column | str, key: str, default: float) -> Column:
    """Numeric JSON member with a default for bad JSON, a missing member or a non-number."""
    return F.coalesce(F.get_json_object(text, f"$.{key}").try_cast("double"), F.lit(float(default)))


def lenient_timestamp(text: Column | str) -> Column:
    return F.try_to_timestamp(text)


def scan_products(products: DataFrame, categories: DataFrame, brands: DataFrame) -> DataFrame:
    """Products with category and brand attributes attached from their dimensions.

    Category and brand lists are far smaller than the catalogue; no hint is
    given, the size-checked automatic broadcast picks the join.
    """
    c = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug"),
                          F.col("name").alias("category_name"))
    b = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name"),
                      F.col("reputation_score").alias("brand_reputation"))
    base = products.select(
        "id", "sku", "title", "description", "category_id", "brand_id", "price", "base_cost", "discount_pct",
        "rating_avg", "rating_count", "inventory", "is_active", "tags", "specifications_json", "launched_at")
    return base.join(c, "category_id").join(b, "brand_id")


def scan_users(users: DataFrame) -> DataFrame:
    return (
        users.withColumn("preferred_categories", lenient_json("preferred_categories_json", "array<bigint>"))
        .withColumn("preferred_brands", lenient_json("preferred_brands_json", "array<bigint>"))
        .drop("preferred_categories_json", "preferred_brands_json"))


def scan_events(events: DataFrame, since: datetime | None = None) -> DataFrame:
    out = events.where(F.col("occurred_at").isNotNull())
    return out if since is None else out.where(F.col("occurred_at") >= ntz(since))


def scan_order_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select(F.col("id").alias("product_id"), "category_id", "brand_id")
    return order_items.join(p, "product_id")


def daily_demand(order_items: DataFrame) -> DataFrame:
    """Units, net revenue and mean unit price per product and day of revenue orders."""
    return (
        order_items.where(F.col("status").isin(*REVENUE_STATUSES))
        .groupBy("product_id", F.to_date("placed_at").alias("day"))
        .agg(F.sum("quantity").alias("units"),
             F.sum(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct") / 100.0)).alias("revenue"),
             F.avg("unit_price").alias("avg_price")))
