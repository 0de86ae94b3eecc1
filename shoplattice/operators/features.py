"""Feature store: user and product features in long form, versioned; point reads in wide form."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import REVENUE_STATUSES, VIEW_TYPES
from shoplattice.functions.scalars import ntz, ratio, whole_days

USER_FEATURES = (
    "user_purchase_frequency", "user_average_order_value", "user_total_spend", "user_recency_days",
    "user_session_count", "user_distinct_products", "user_discount_affinity", "user_review_count",
)
PRODUCT_FEATURES = (
    "product_popularity", "product_conversion_rate", "product_rating", "product_demand_30d",
    "product_price_trend", "product_view_count", "product_cart_rate", "product_return_rate",
)


def _long(wide: DataFrame, entity: str, names: tuple[str, ...], version: str, as_of: datetime) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names]))
    return wide.select(entity, pairs.alias("p")).select(
        entity, F.col("p.n").alias("feature_name"), F.col("p.v").alias("feature_value"),
        F.lit(version).alias("feature_version"), ntz(as_of).alias("computed_at"))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def user_features(
    orders: DataFrame, order_items: DataFrame, session_events: DataFrame, reviews: DataFrame, as_of: datetime, version: str,
) -> DataFrame:
    """Eight features per buyer. Every source is aggregated to one row per user before it is joined."""
    paid = orders.where(F.col("status").isin(*REVENUE_STATUSES)).groupBy("user_id").agg(
        F.count("*").alias("user_purchase_frequency"), F.avg("total_amount").alias("user_average_order_value"),
        F.sum("total_amount").alias("user_total_spend"), F.max("placed_at").alias("_last"),
        F.sum("discount_amount").alias("_discount"))
    sessions = session_events.groupBy("user_id").agg(F.count_distinct("session_id").alias("user_session_count"))
    distinct = order_items.groupBy("user_id").agg(F.count_distinct("product_id").alias("user_distinct_products"))
    n_reviews = reviews.groupBy("user_id").agg(F.count("*").alias("user_review_count"))
    wide = paid.join(sessions, "user_id", "left").join(distinct, "user_id", "left").join(n_reviews, "user_id", "left").withColumns({
        "user_recency_days": whole_days(as_of, "_last").cast("double"),
        "user_session_count": _or_zero("user_session_count"),
        "user_distinct_products": _or_zero("user_distinct_products"),
        "user_review_count": _or_zero("user_review_count"),
        "user_discount_affinity": ratio("_discount", "user_total_spend")})
    return _long(wide, "user_id", USER_FEATURES, version, as_of)


def product_features(
    events: DataFrame, order_items: DataFrame, products: DataFrame, as_of: datetime, version: str,
) -> DataFrame:
    """Eight features per product from one conditional pass over events and one over order lines."""
    kind = F.col("event_type")
    seen = events.groupBy(F.col("product_id").alias("id")).agg(
        F.count_if(kind.isin(*VIEW_TYPES)).alias("_views"), F.count_if(kind == "purchase").alias("_buys"),
        F.count_if(kind == "add_to_cart").alias("_carts"))
    recent = (F.col("placed_at") >= ntz(as_of - timedelta(days=30))) & F.col("status").isin(*REVENUE_STATUSES)
    sold = order_items.groupBy(F.col("product_id").alias("id")).agg(
        F.sum(F.when(recent, F.col("quantity"))).alias("_d30"),
        F.count_if(F.col("status") == "returned").alias("_returned"), F.count("*").alias("_lines"))
    wide = products.join(seen, "id", "left").join(sold, "id", "left")
    views = _or_zero("_views")
    rate = lambda n: F.when(views >= 3, _or_zero(n) / views).otherwise(0.0)
    wide = wide.select(
        F.col("id").alias("product_id"), F.log1p("rating_count").alias("product_popularity"),
        rate("_buys").alias("product_conversion_rate"), F.col("rating_avg").alias("product_rating"),
        _or_zero("_d30").alias("product_demand_30d"), F.col("discount_pct").alias("product_price_trend"),
        views.alias("product_view_count"), rate("_carts").alias("product_cart_rate"),
        ratio("_returned", "_lines").alias("product_return_rate"))
    return _long(wide, "product_id", PRODUCT_FEATURES, version, as_of)


def read_vectors(features: DataFrame, entity: str, names: tuple[str, ...], version: str) -> DataFrame:
    """One wide row per entity of a version; the known name list keeps the pivot a single aggregate."""
    return features.where(F.col("feature_version") == version).groupBy(entity).pivot(
        "feature_name", list(names)).agg(F.first("feature_value"))
