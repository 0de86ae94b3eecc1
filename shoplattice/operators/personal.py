"""Customer profiles: time-decayed affinities, price bands, recent lists, preference vectors."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import EVENT_WEIGHTS, PROFILE_HALF_LIFE_DAYS, REVENUE_STATUSES, VIEW_TYPES
from shoplattice.functions.grouped import grouped_percentiles, top_k
from shoplattice.functions.scalars import age_days, event_weight, half_life

WEIGHTED = tuple(k for k, v in EVENT_WEIGHTS.items() if v != 0)


def last_events(events: DataFrame, products: DataFrame, key: str = "user_id", n: int = 600) -> DataFrame:
    """The newest ``n`` catalogue events per key with product attributes.

    The rank limit is applied map-side before the shuffle, so a hot key sends
    at most ``n`` rows per task.
    """
    p = products.select(F.col("id").alias("product_id"), "category_id", "brand_id", "price")
    cols = [key, "id", "event_type", "product_id", "occurred_at"]
    recent = top_k(events.where(F.col("product_id").isNotNull()).select(*cols), [key],
                   [F.col("occurred_at").desc(), F.col("id").desc()], n, rank="recency")
    return recent.join(p, "product_id")


def affinity(recent: DataFrame, dimension: str, as_of: datetime, key: str = "user_id") -> DataFrame:
    """Decayed weight per (key, dimension) divided by the key's maximum; keys without a positive maximum vanish."""
    scored = recent.where(F.col("event_type").isin(*WEIGHTED)).groupBy(key, dimension).agg(
        F.sum(event_weight() * half_life(age_days(as_of, "occurred_at"), PROFILE_HALF_LIFE_DAYS)).alias("_s"))
    peak = scored.groupBy(key).agg(F.max("_s").alias("_max")).where(F.col("_max") > 0)
    return scored.join(peak, key).select(key, dimension, F.round(F.col("_s") / F.col("_max"), 6).alias("affinity"))


def price_band(recent: DataFrame, key: str = "user_id") -> DataFrame:
    """10th and 90th percentile price of positively weighted events."""
    return grouped_percentiles(recent.where(event_weight() > 0), [key], "price", {"price_p10": 0.1, "price_p90": 0.9})


def recent_list(events: DataFrame, types: tuple[str, ...], key: str = "user_id", n: int = 30) -> DataFrame:
    """First-occurrence order of the newest events: each product once, newest first."""
    per = events.where(F.col("event_type").isin(*types)).groupBy(key, "product_id").agg(
        F.max(F.struct("occurred_at", "id")).alias("_at"))
    return top_k(per, [key], [F.col("_at").desc()], n, rank="position").drop("_at")


def recently_viewed(events: DataFrame, key: str = "user_id", n: int = 30) -> DataFrame:
    return recent_list(events, VIEW_TYPES, key, n)


def wishlist(events: DataFrame, key: str = "user_id", n: int = 30) -> DataFrame:
    return recent_list(events, ("wishlist",), key, n)


def cart_state(events: DataFrame, key: str = "user_id", n: int = 30) -> DataFrame:
    """Products whose latest add/remove event is an add, newest first."""
    last = events.where(F.col("event_type").isin("add_to_cart", "remove_from_cart")).groupBy(key, "product_id").agg(
        F.max(F.struct("occurred_at", "id", "event_type")).alias("_at"))
    live = last.where(F.col("_at.event_type") == "add_to_cart")
    return top_k(live, [key], [F.col("_at").desc()], n, rank="position").drop("_at")


def purchased_lists(order_items: DataFrame, n: int = 50) -> DataFrame:
    return top_k(order_items.select("user_id", "product_id", "placed_at", "order_id"), ["user_id"],
                 [F.col("placed_at").desc(), F.col("order_id").desc(), F.col("product_id")], n, rank="position")


def profiles(
    users: DataFrame, recent: DataFrame, orders: DataFrame, session_events: DataFrame, reviews: DataFrame,
    searches: DataFrame, segments: DataFrame,
) -> DataFrame:
    """One row per user; every source is reduced to a row per user before it is joined."""
    from shoplattice.operators.segments import latest_segment
    paid = orders.where(F.col("status").isin(*REVENUE_STATUSES)).groupBy("user_id").agg(
        F.count("*").alias("order_count"), F.sum("total_amount").alias("total_spend"), F.avg("total_amount").alias("avg_order_value"))
    interactions = recent.where(F.col("event_type").isin(*WEIGHTED)).groupBy("user_id").agg(F.count("*").alias("interaction_count"))
    sessions = session_events.groupBy("user_id").agg(
        F.count_distinct("session_id").alias("session_count"), F.max("occurred_at").alias("last_active_at"))
    n_reviews = reviews.groupBy("user_id").agg(F.count("*").alias("review_count"))
    terms = top_k(searches.where(F.col("normalized_query") != ""), ["user_id"], [F.col("occurred_at").desc(), F.col("id").desc()], 20)
    terms = terms.groupBy("user_id").agg(F.count("*").alias("search_count"), F.min_by("normalized_query", "rank").alias("last_search"))
    segment = latest_segment(segments).select("user_id", F.col("segment_label").alias("segment"))
    out = users.select(F.col("id").alias("user_id"), "price_sensitivity")
    for part in (interactions, paid, sessions, n_reviews, terms, segment):
        out = out.join(part, "user_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("interaction_count", "order_count", "session_count", "review_count", "search_count")}
    money = {c: F.round(F.coalesce(F.col(c), F.lit(0.0)), places) for c, places in (("total_spend", 2), ("avg_order_value", 6))}
    return out.withColumns({**zero, **money}).withColumn("is_cold_start", F.col("interaction_count") < 3)


def preference_vector(category: DataFrame, brand: DataFrame, dim: int = 16, key: str = "user_id") -> DataFrame:
    """Affinities folded into ``dim`` slots and L2-normalised."""
    c = category.select(key, F.pmod(F.col("category_id"), F.lit(dim)).cast("int").alias("slot"), F.col("affinity").alias("w"))
    b = brand.select(key, F.pmod(F.col("brand_id") * 7, F.lit(dim)).cast("int").alias("slot"), (F.col("affinity") * 0.5).alias("w"))
    wide = c.unionByName(b).groupBy(key).agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("w"))), F.lit(0.0)) for i in range(dim)]).alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return wide.withColumn("_n", norm).withColumn("preference", F.transform(
        "v", lambda x: F.when(F.col("_n") > 0, F.round(x / F.col("_n"), 5)).otherwise(0.0))).drop("v", "_n")


def _listed(rows: DataFrame, key: str, name: str, item: Column | str, order: str, n: int) -> DataFrame:
    """The first ``n`` items of a short ranked list per key, as an array."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), (F.col(item) if isinstance(item, str) else item).alias("item"))))
    return rows.where(F.col(order) <= n).groupBy(key).agg(F.transform(pairs, lambda p: p["item"]).alias(name))


def behaviour(recent: DataFrame, as_of: datetime, key: str = "user_id") -> DataFrame:
    """One row per key of ``last_events``: interactions, strongest affinities, price range, lists and preference vector.

    Works for users as for anonymous sessions. Every part is reduced to a row per key, with bounded lists, before parts meet.
    Affinities are lists of (id, affinity), strongest first, at most ten.
    """
    category, brand = affinity(recent, "category_id", as_of, key), affinity(recent, "brand_id", as_of, key)
    out = recent.where(F.col("event_type").isin(*WEIGHTED)).groupBy(key).agg(F.count("*").alias("interaction_count"))

    def strongest(rows: DataFrame, dimension: str, name: str) -> DataFrame:
        best = top_k(rows, [key], [F.col("affinity").desc(), F.col(dimension)], 10)
        return _listed(best, key, name, F.struct(F.col(dimension).alias("id"), "affinity"), "rank", 10)

    parts = [strongest(category, "category_id", "category_affinity"), strongest(brand, "brand_id", "brand_affinity"), price_band(recent, key),
             _listed(recently_viewed(recent, key), key, "recently_viewed", "product_id", "position", 20),
             _listed(cart_state(recent, key), key, "cart", "product_id", "position", 30),
             _listed(wishlist(recent, key), key, "wishlist", "product_id", "position", 30), preference_vector(category, brand, key=key)]
    for part in parts:
        out = out.join(part, key, "left")
    lists = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("category_affinity", "brand_affinity", "recently_viewed", "cart", "wishlist", "preference")}
    return out.withColumns(lists)


def whole_profiles(facts: DataFrame, behaviours: DataFrame, order_items: DataFrame, searches: DataFrame) -> DataFrame:
    """``profiles`` with the behaviour columns, the latest 20 purchases and the search terms among the latest 20 searches of every user."""
    bought = _listed(purchased_lists(order_items), "user_id", "purchased", "product_id", "position", 20)
    asked = top_k(searches.select("user_id", "normalized_query", "occurred_at", "id"), ["user_id"], [F.col("occurred_at").desc(), F.col("id").desc()], 20)
    terms = asked.where(F.col("normalized_query") != "").groupBy("user_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "normalized_query"))), lambda p: p["normalized_query"]), 1, 10).alias("search_terms"))
    out = facts.join(behaviours.drop("interaction_count"), "user_id", "left").join(bought, "user_id", "left").join(terms, "user_id", "left")
    lists = [c for c in (*behaviours.columns, "purchased", "search_terms") if c in out.columns and out.schema[c].dataType.typeName() == "array"]
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in lists})
