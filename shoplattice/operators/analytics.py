"""Dashboard aggregates. Every window is bounded by an explicit ``as_of``."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoplattice.constants import REVENUE_STATUSES, TRENDING_TYPES, VIEW_TYPES
from shoplattice.functions.grouped import top_k
from shoplattice.functions.scalars import day, ntz, pct_change, ratio, title_label
from shoplattice.operators.sessions import sessionise


def is_revenue(c: str = "status") -> Column:
    return F.col(c).isin(*REVENUE_STATUSES)


def within(ts: str, as_of: datetime, days: float) -> Column:
    """``[as_of - days, as_of)``, written so that it reaches the Parquet scan."""
    return (F.col(ts) >= ntz(as_of - timedelta(days=days))) & (F.col(ts) < ntz(as_of))


def trailing_windows(df: DataFrame, ts: str, as_of: datetime, days: int) -> DataFrame:
    """Rows of the current and the preceding window of equal length, tagged."""
    cut = ntz(as_of - timedelta(days=days))
    return df.where(within(ts, as_of, 2 * days)).withColumn(
        "window", F.when(F.col(ts) >= cut, "current").otherwise("previous"))


# ---- business --------------------------------------------------------------
def business_metrics(
    orders: DataFrame, events: DataFrame, users: DataFrame, products: DataFrame,
    orders_as_of: datetime, events_as_of: datetime, days: int = 30,
) -> DataFrame:
    """One row of KPIs for the window ending at ``as_of`` against the window before.

    Sessions of the window are counted, so only its events are read: a session
    that began earlier still is one session of the window, its first event in
    the window opens it.

    Orders are scanned once: a per-buyer pre-aggregate carries both windows and
    the fact of an earlier purchase, so repeat buyers need no second scan.
    """
    since = ntz(orders_as_of - timedelta(days=days))
    prior = ntz(orders_as_of - timedelta(days=2 * days))
    cur = F.col("placed_at") >= since
    prev = (F.col("placed_at") >= prior) & ~cur
    per_buyer = (
        orders.where(is_revenue() & (F.col("placed_at") < ntz(orders_as_of))).groupBy("user_id").agg(
            F.count_if(cur).alias("n"), F.sum(F.when(cur, F.col("total_amount"))).alias("amount"),
            F.count_if(prev).alias("pn"), F.sum(F.when(prev, F.col("total_amount"))).alias("pamount"),
            F.count_if(~cur).alias("earlier")))
    buyers = per_buyer.agg(
        F.sum("n").alias("orders"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("revenue"),
        F.sum("pn").alias("p_orders"), F.coalesce(F.sum("pamount"), F.lit(0.0)).alias("p_revenue"),
        F.count_if(F.col("n") > 0).alias("unique_buyers"),
        F.count_if((F.col("n") > 0) & (F.col("earlier") > 0)).alias("repeat_buyers"))
    live = sessionise(events.where(within("occurred_at", events_as_of, days)))
    per_session = live.groupBy("user_id", "session_id").agg(
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    traffic = per_session.agg(F.struct(
        F.count("*").alias("sessions"), F.coalesce(F.sum("bought"), F.lit(0)).alias("purchase_sessions"),
        F.count_distinct("user_id").alias("active_users"))).scalar()
    n_users = users.agg(F.count("*")).scalar()
    n_products = products.agg(F.count_if("is_active")).scalar()
    aov, p_aov = ratio("revenue", "orders"), ratio("p_revenue", "p_orders")
    return buyers.withColumns({"aov": aov, "p_aov": p_aov, "_t": traffic}).select(
        F.lit(days).alias("window_days"),
        F.round("revenue", 2).alias("revenue"), pct_change("revenue", "p_revenue").alias("revenue_change_pct"),
        "orders", pct_change("orders", "p_orders").alias("orders_change_pct"),
        F.round("aov", 2).alias("average_order_value"), pct_change("aov", "p_aov").alias("aov_change_pct"),
        "unique_buyers", F.col("_t.active_users").alias("active_users"), F.col("_t.sessions").alias("sessions"),
        ratio("_t.purchase_sessions", "_t.sessions", 4).alias("conversion_rate"), "repeat_buyers",
        ratio("repeat_buyers", "unique_buyers", 4).alias("retention_rate"),
        n_users.alias("total_customers"), n_products.alias("total_products"))


def revenue_timeseries(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return (orders.where(is_revenue() & within("placed_at", as_of, days)).groupBy(day("placed_at").alias("date"))
            .agg(F.round(F.sum("total_amount"), 2).alias("revenue"), F.count("*").alias("orders")))


# ---- recommendation and search effectiveness -------------------------------
def _rec_rates() -> list[Column]:
    n = F.count("*")
    return [n.alias("impressions"), F.count_if("clicked").alias("clicks"), F.count_if("converted").alias("conversions"),
            ratio(F.count_if("clicked"), n, 5).alias("ctr"), ratio(F.count_if("converted"), n, 5).alias("conversion_rate")]


def recommendation_metrics(impressions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return impressions.where(F.col("served_at") >= ntz(as_of - timedelta(days=days))).agg(*_rec_rates())


def ctr_by_strategy(impressions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    live = impressions.where(F.col("served_at") >= ntz(as_of - timedelta(days=days)))
    return live.groupBy("strategy").agg(*_rec_rates()).drop("conversions", "conversion_rate")


def search_metrics(searches: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    n, clicks = F.count("*"), F.count("clicked_product_id")
    return searches.where(F.col("occurred_at") >= ntz(as_of - timedelta(days=days))).agg(
        n.alias("searches"), clicks.alias("clicks"), F.count_if("converted").alias("conversions"),
        ratio(clicks, n, 5).alias("ctr"), ratio(F.count_if("converted"), n, 5).alias("conversion_rate"),
        ratio(n - clicks, n, 5).alias("abandonment_rate"),
        ratio(F.count_if(F.col("result_count") == 0), n, 5).alias("zero_result_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"))


def popular_queries(searches: DataFrame, as_of: datetime, days: int = 30, k: int = 10) -> DataFrame:
    live = searches.where((F.col("occurred_at") >= ntz(as_of - timedelta(days=days))) & (F.col("normalized_query") != ""))
    per = live.groupBy(F.col("normalized_query").alias("query")).agg(
        F.count("*").alias("searches"), F.count_if(F.col("clicked_product_id") > 0).alias("clicks"))
    return per.orderBy(F.col("searches").desc(), "query").limit(k).withColumn("ctr", ratio("clicks", "searches", 4))


# ---- customers -------------------------------------------------------------
def customer_counts(users: DataFrame, orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """New sign-ups and distinct buyers of the window."""
    since = ntz(as_of - timedelta(days=days))
    buyers = orders.where((F.col("placed_at") >= since) & is_revenue()).agg(F.count_distinct("user_id")).scalar()
    return users.agg(F.count_if(F.col("created_at") >= since).alias("new_users")).withColumn("window_buyers", buyers)


def latest_version(rows: DataFrame, version: str = "model_version", ts: str = "created_at") -> Column:
    return rows.agg(F.max_by(version, F.struct(ts, version))).scalar()


def segment_mix(segments: DataFrame) -> DataFrame:
    """Label counts and mean spend of the newest segmentation."""
    live = segments.where(F.col("model_version") == latest_version(segments))
    return live.groupBy(F.col("segment_label").alias("label")).agg(
        F.count("*").alias("count"), F.round(F.avg("monetary"), 4).alias("avg_monetary")
    ).withColumn("name", title_label("label")).withColumn(
        "is_high_value", F.col("label") == "high_value").withColumn("is_at_risk", F.col("label") == "at_risk")


def top_customers(users: DataFrame, orders: DataFrame, k: int = 10) -> DataFrame:
    """Spend is summed and cut to k before user attributes are joined."""
    spend = orders.where(is_revenue()).groupBy("user_id").agg(
        F.round(F.sum("total_amount"), 2).alias("total_spend"), F.count("*").alias("orders"))
    best = spend.orderBy(F.col("total_spend").desc(), "user_id").limit(k)
    return best.join(users.select(F.col("id").alias("user_id"), F.col("full_name").alias("name"), "email"), "user_id")


# ---- products --------------------------------------------------------------
def best_sellers(order_items: DataFrame, products: DataFrame, as_of: datetime, days: int = 90, k: int = 10) -> DataFrame:
    live = order_items.where((F.col("placed_at") >= ntz(as_of - timedelta(days=days))) & is_revenue())
    per = live.groupBy(F.col("product_id").alias("id")).agg(
        F.sum("quantity").alias("units_sold"), F.round(F.sum("line_total"), 2).alias("revenue"))
    best = per.orderBy(F.col("units_sold").desc(), "id").limit(k)
    return best.join(products.select("id", "sku", "title", "price", "inventory"), "id")


def product_conversion(events: DataFrame) -> DataFrame:
    """Views and purchases per product in one conditional pass."""
    kinds = (*VIEW_TYPES, "purchase")
    return events.where(F.col("event_type").isin(*kinds)).groupBy("product_id").agg(
        F.count_if(F.col("event_type").isin(*VIEW_TYPES)).alias("views"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"))


def conversion_stats(events: DataFrame, products: DataFrame, best: bool = True, k: int = 10, min_views: int = 10) -> DataFrame:
    rate = ratio("purchases", "views", 5)
    per = product_conversion(events).where(F.col("views") >= min_views).withColumn("conversion_rate", rate)
    per = per.withColumnRenamed("product_id", "id").join(products.select("id", "title"), "id")
    key = F.col("conversion_rate").desc() if best else F.col("conversion_rate").asc()
    return per.orderBy(key, "id").limit(k)


def category_breakdown(products: DataFrame, order_lines: DataFrame, k: int = 12, revenue_only: bool = False) -> DataFrame:
    """Products and line revenue per category; lines are summed per product before the join."""
    lines = order_lines.where(is_revenue()) if revenue_only else order_lines
    per_product = lines.groupBy(F.col("product_id").alias("id")).agg(F.sum("line_total").alias("amount"))
    per = products.select("id", "category_name", "category_slug").join(per_product, "id", "left").groupBy(
        F.col("category_name").alias("category"), F.col("category_slug").alias("slug")).agg(
        F.count_distinct("id").alias("products"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("revenue"))
    return per.orderBy(F.col("revenue").desc(), "slug").limit(k)


def event_counts(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return events.where(F.col("occurred_at") >= ntz(as_of - timedelta(days=days))).groupBy("event_type").agg(
        F.count("*").alias("count"))


def event_funnel(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    live = events.where(F.col("occurred_at") >= ntz(as_of - timedelta(days=days)))
    kind = F.col("event_type")
    return live.agg(
        F.count_if(kind == "product_view").alias("views"), F.count_if(kind == "add_to_cart").alias("carts"),
        F.count_if(kind == "purchase").alias("purchases"),
    ).select("*", ratio("carts", "views", 5).alias("view_to_cart"),
             ratio("purchases", "carts", 5).alias("cart_to_purchase"),
             ratio("purchases", "views", 5).alias("view_to_purchase"))


def popular_categories(products: DataFrame, k: int = 8) -> DataFrame:
    per = products.where("is_active").groupBy(
        F.col("category_id").alias("id"), F.col("category_slug").alias("slug"), F.col("category_name").alias("name")).agg(
        F.count("*").alias("product_count"), F.round(F.coalesce(F.avg("rating_avg"), F.lit(0.0)), 2).alias("avg_rating"))
    return per.orderBy(F.col("product_count").desc(), "id").limit(k)


def refresh_ratings(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with their rating columns recomputed from reviews (zero where there are none)."""
    agg = reviews.groupBy(F.col("product_id").alias("id")).agg(
        F.round(F.avg("rating"), 2).alias("_avg"), F.count("*").alias("_n"))
    return products.join(agg, "id", "left").withColumns({
        "rating_avg": F.coalesce("_avg", F.lit(0.0)), "rating_count": F.coalesce("_n", F.lit(0))}).drop("_avg", "_n")


def demand_history(order_items: DataFrame, as_of: datetime, days: int = 120) -> DataFrame:
    live = order_items.where((F.col("placed_at") >= ntz(as_of - timedelta(days=days))) & is_revenue())
    return live.groupBy("product_id", day("placed_at").alias("date")).agg(F.sum("quantity").alias("units"))


def trending(
    events: DataFrame, products: DataFrame, as_of: datetime, days: int = 14, k: int = 10, per_category: bool = False,
) -> DataFrame:
    """Interaction counts of active products over the window, scaled by the list maximum."""
    live = events.where((F.col("occurred_at") >= ntz(as_of - timedelta(days=days))) & F.col("event_type").isin(*TRENDING_TYPES))
    counts = live.groupBy("product_id").agg(F.count("*").alias("n"))
    active = products.where("is_active").select(F.col("id").alias("product_id"), "category_id")
    joined = counts.join(active, "product_id")
    order = [F.col("n").desc(), F.col("product_id")]
    group = ["category_id"] if per_category else ["_all"]
    rows = joined if per_category else joined.orderBy(*order).limit(k).withColumn("_all", F.lit(1))
    ranked = top_k(rows, group, order, k)
    peak = F.max("n").over(W.partitionBy(*group))
    return ranked.withColumn("score", F.round(F.col("n") / peak, 5)).drop("_all")


def co_purchase_counts(order_lines: DataFrame, k: int = 4) -> DataFrame:
    """Per product, how many lines of other products share an order with it; top k, scaled by the best.

    Lines are collapsed to (order, product, copies) first and pairs come from
    the block-wise pair generator, so a giant order is spread over tasks.
    """
    from shoplattice.functions.grouped import both_directions, item_pairs
    lines = order_lines.groupBy("order_id", "product_id").agg(F.count("*").alias("copies"))
    pairs = item_pairs(lines, "order_id", "product_id", ["copies"])
    sums = pairs.groupBy("a", "b").agg(F.sum("copies_a").alias("n_a"), F.sum("copies_b").alias("n_b"))
    edges = both_directions(sums, "a", "n_a", "n_b").withColumn(
        "n", F.when(F.col("dst") == F.col("a"), F.col("n_a")).otherwise(F.col("n_b")))
    ranked = top_k(edges.select(F.col("src").alias("product_id"), F.col("dst").alias("other_id"), "n"),
                   ["product_id"], [F.col("n").desc(), F.col("other_id")], k)
    return ranked.withColumn("score", F.col("n") / F.max("n").over(W.partitionBy("product_id")))


# ---- segments, sentiment, models, features ---------------------------------
def segment_overview(segments: DataFrame) -> DataFrame:
    live = segments.where(F.col("model_version") == latest_version(segments))
    total = live.agg(F.count("*")).scalar()
    means = {"monetary": ("avg_monetary", 4), "frequency": ("avg_frequency", 4), "recency_days": ("avg_recency_days", 2),
             "avg_order_value": ("avg_order_value", 4), "rfm_score": ("avg_rfm_score", 4), "confidence": ("avg_confidence", 4)}
    return live.groupBy(F.col("segment_label").alias("label")).agg(
        F.count("*").alias("customer_count"),
        *[F.round(F.avg(c), p).alias(a) for c, (a, p) in means.items()],
    ).withColumn("share", ratio("customer_count", total, 4)).withColumn("name", title_label("label"))


def sentiment_distribution(reviews: DataFrame) -> DataFrame:
    total = reviews.agg(F.count("sentiment_label")).scalar()
    everything = reviews.agg(F.count("*")).scalar()
    return reviews.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label").agg(
        F.count("*").alias("count")).select(
        "*", ratio("count", total, 4).alias("share"), total.alias("total_labelled"), everything.alias("total_reviews"))


def model_health(predictions: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return predictions.where(F.col("predicted_at") >= ntz(as_of - timedelta(days=days))).groupBy(
        "model_name", "model_version").agg(
        F.count("*").alias("logged_predictions"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.round(F.max("latency_ms"), 4).alias("max_latency_ms"), F.count_if(~F.col("succeeded")).alias("failures"))


def serving_stats(predictions: DataFrame, last: int = 500) -> DataFrame:
    """Lifetime calls, failures and mean latency; p95 over the newest ``last`` calls of each model.

    p95 is the element at position int(.95 n) of the sorted tail, read off by rank.
    """
    life = predictions.groupBy("model_name").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("succeeded")).alias("failures"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
    ).withColumn("error_rate", ratio("failures", "calls", 5))
    tail = top_k(predictions.select("model_name", "latency_ms", "predicted_at", "id"), ["model_name"],
                 [F.col("predicted_at").desc(), F.col("id").desc()], last, rank="_r")
    w = W.partitionBy("model_name")
    pos = F.least(F.floor(F.count("*").over(w) * 0.95), F.count("*").over(w) - 1)
    p95 = (tail.withColumn("_i", F.row_number().over(w.orderBy("latency_ms", "id")) - 1).withColumn("_pos", pos)
           .where("_i = _pos").select("model_name", F.round("latency_ms", 4).alias("p95_latency_ms")))
    return life.join(p95, "model_name", "left")


def feature_coverage(features: DataFrame, entity: str) -> DataFrame:
    return features.groupBy("feature_version").agg(F.count_distinct(entity).alias("entities"))


def user_order_stats(orders: DataFrame) -> DataFrame:
    return orders.where(is_revenue()).groupBy("user_id").agg(
        F.count("*").alias("order_count"), F.round(F.sum("total_amount"), 2).alias("total_spend"),
        F.round(F.avg("total_amount"), 6).alias("avg_order_value"))


def dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
