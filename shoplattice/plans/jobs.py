"""Composite jobs: dashboard, product analytics, feature store, homepage."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplattice.operators import analytics as A, attribution, catalog as C, features as FE, index_store as IX, personal as P, recommend as R, sentiment as SE
from shoplattice.plans import analytics_queries, catalog_queries  # noqa: F401  their SQL is that of the sections
from shoplattice.plans.recommender_queries import HOME, item_cf_lists
from shoplattice.plans.registry import SQL, query, sql_tokens
from shoplattice.session import work_dir
from shoplattice.sources import sinks as S


def dashboard(t, days: int = 30) -> dict[str, DataFrame]:
    """Every dashboard section as a lazy DataFrame."""
    shown = attribution.attribute(t.impressions, t.events)
    return {
        "business": A.business_metrics(t.orders, t.events, t.users, t.products, t.orders_as_of, t.events_as_of, days),
        "recommendation": A.recommendation_metrics(shown, t.events_as_of, days),
        "by_strategy": A.ctr_by_strategy(shown, t.events_as_of, days),
        "search": A.search_metrics(t.search_events, t.events_as_of, days),
        "customers": A.customer_counts(t.users_with_signup, t.orders, t.orders_as_of, days),
        "top_customers": A.top_customers(t.users, t.orders),
        **product_analytics(t),
        "sentiment": A.sentiment_distribution(t.reviews.unionByName(t.pending_reviews)),
        "revenue_timeseries": A.revenue_timeseries(t.orders, t.orders_as_of, days),
        "event_funnel": A.event_funnel(t.events, t.events_as_of, days),
    }


def product_analytics(t, k: int = 10) -> dict[str, DataFrame]:
    return {
        "best_sellers": A.best_sellers(t.order_items, t.products, t.orders_as_of, k=k),
        "low_inventory": C.low_inventory(t.products, 10, k),
        "high_conversion": A.conversion_stats(t.events, t.products, True, k),
        "poor_performers": A.conversion_stats(t.events, t.products, False, k),
        "category_breakdown": A.category_breakdown(t.products, t.order_lines),
    }


def compute_feature_store(t, path: str, version: str) -> None:
    """Recompute both feature tables and replace the version partition; safe to rerun."""
    users = FE.user_features(t.orders, t.order_items, t.session_events, t.reviews, t.orders_as_of, version)
    products = FE.product_features(t.events, t.order_items, t.products, t.orders_as_of, version)
    S.replace_version(users, f"{path}/user_features", "feature_version")
    S.replace_version(products, f"{path}/product_features", "feature_version")


def score_pending(t, path: str, version: str) -> None:
    """Scores of the reviews that have none, replacing those of an earlier run of the version."""
    from shoplattice.plans.review_queries import classifier
    _, model = classifier(t)
    scored = SE.score_reviews(model, t.pending_reviews, version).withColumn("model_version", F.lit(version))
    S.replace_version(scored.drop("sentiment_model_version"), f"{path}/review_scores")


def refresh_trending(t, path: str, version: str) -> None:
    """The trending list of all and of each category, replacing that of an earlier run of the version."""
    every = A.trending(t.events, t.products, t.events_as_of).withColumn("scope", F.lit("all"))
    each = A.trending(t.events, t.products, t.events_as_of, per_category=True).withColumn("scope", F.lit("category"))
    lists = every.unionByName(each, allowMissingColumns=True).select("scope", "category_id", "product_id", "rank", "score", F.lit(version).alias("model_version"))
    S.replace_version(lists, f"{path}/trending")


def homepage(t, per_rail: int = 8) -> DataFrame:
    """(user, rail, rank, product) for every user; shared rails are short lists repeated per user."""
    from shoplattice.plans.recommender_queries import cart_minus_bought, routed
    from shoplattice.functions.grouped import top_k
    users = routed(t)
    warm = users.where("strategy = 'hybrid'").select("user_id")
    cols = ["rail", "user_id", "product_id", "rank"]
    recent = P.recently_viewed(t.events, n=per_rail).join(warm, "user_id", "left_semi").select(
        F.lit("recent").alias("rail"), "user_id", "product_id", F.col("position").alias("rank"))
    carry = cart_minus_bought(t).where(F.col("rank") <= per_rail).join(warm, "user_id", "left_semi").select(
        F.lit("continue").alias("rail"), "user_id", "product_id", "rank")

    def shared(rail: str, short: DataFrame) -> DataFrame:
        head = short.agg(F.sort_array(F.collect_list(F.struct("rank", "product_id")))).scalar()
        return users.select(F.lit(rail).alias("rail"), "user_id", F.explode(head).alias("h")).select(
            "rail", "user_id", F.col("h.product_id").alias("product_id"), F.col("h.rank").alias("rank"))

    deal_order = [F.col("discount_pct").desc(), F.col("rating_avg").desc(), F.col("id")]
    deals = top_k(C.deals(t.products, per_rail).withColumn("_g", F.lit(1)), ["_g"], deal_order, per_rail).select(
        F.col("id").alias("product_id"), "rank")
    trend = A.trending(t.events, t.products, t.events_as_of, k=per_rail).select("product_id", "rank")
    favourite = P.affinity(P.last_events(t.events, t.products), "category_id", t.events_as_of)
    best = favourite.groupBy("user_id").agg(F.min_by("category_id", F.struct(-F.col("affinity"), "category_id")).alias("category_id"))
    per_cat = A.trending(t.events, t.products, t.events_as_of, k=per_rail, per_category=True).select("category_id", "product_id", "rank")
    category = best.join(per_cat, "category_id").select(F.lit("category_affinity").alias("rail"), "user_id", "product_id", "rank")
    parts = [recent, carry, shared("deals", deals), shared("trending", trend), category]
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out


RAIL_STRATEGY = {"continue": "continue_shopping", "recent": "recently_viewed", "deals": "deals", "trending": "trending_events", "category_affinity": "trending_events"}


def whole_homepage(t, own: DataFrame | None = None, per_rail: int = 8) -> DataFrame:
    """(user, rail, rank, product, strategy): every rail of every user. ``own`` are the users' lists, else the hybrid ones."""
    from shoplattice.plans import recommender_queries as RQ
    if own is None:
        own = R.hybrid_topk(*RQ.hybrid_inputs(t), 10).select("user_id", "product_id", "rank")
    cols = ["rail", "user_id", "product_id", "rank"]
    warm = RQ.routed(t).where("strategy = 'hybrid'").select("user_id")
    carry = RQ.continued(t, per_rail).join(warm, "user_id", "left_semi").withColumn("rail", F.lit("continue"))
    others = homepage(t, per_rail).where("rail <> 'continue'").select(cols).unionByName(carry.select(cols))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in RAIL_STRATEGY.items() for x in pair]), F.col("rail"))
    mine = RQ.serving(t, own).where(F.col("rank") <= per_rail).withColumn("rail", F.lit("for_you"))
    return others.withColumn("strategy", label).unionByName(mine.select(*cols, "strategy"))


#: Section: (query with its SQL, key column or None where the section is one row, measures).
PRODUCT_SECTIONS = {
    "best_sellers": ("agg_11_best_sellers", "id", ("price", "inventory", "units_sold", "revenue")),
    "low_inventory": ("topk_03_low_inventory", "id", ("inventory",)),
    "high_conversion": ("agg_12_conversion_best", "id", ("views", "purchases", "conversion_rate")),
    "poor_performers": ("agg_12_conversion_worst", "id", ("views", "purchases", "conversion_rate")),
    "category_breakdown": ("agg_09_category_breakdown", "slug", ("products", "revenue")),
}
SECTIONS = {
    "business": ("agg_01_business_metrics", None, (
        "revenue", "revenue_change_pct", "orders", "orders_change_pct", "average_order_value", "aov_change_pct", "unique_buyers", "active_users", "sessions",
        "conversion_rate", "repeat_buyers", "retention_rate", "total_customers", "total_products")),
    "recommendation": ("agg_03_recommendation_metrics", None, ("impressions", "clicks", "conversions", "ctr", "conversion_rate")),
    "by_strategy": ("agg_04_ctr_by_strategy", "strategy", ("impressions", "clicks", "ctr")),
    "search": ("agg_05_search_metrics", None, ("searches", "clicks", "conversions", "ctr", "conversion_rate", "abandonment_rate", "zero_result_rate", "avg_latency_ms")),
    "customers": ("agg_06_customer_counts", None, ("new_users", "window_buyers")),
    "top_customers": ("agg_08_top_customers", "user_id", ("total_spend", "orders")),
    **PRODUCT_SECTIONS,
    "sentiment": ("agg_18_sentiment_distribution", "sentiment_label", ("count", "share", "total_labelled", "total_reviews")),
    "revenue_timeseries": ("agg_02_revenue_timeseries", "date", ("revenue", "orders")),
    "event_funnel": ("agg_10_event_funnel", None, ("views", "carts", "purchases", "view_to_cart", "cart_to_purchase", "view_to_purchase")),
}


def section_values(sections: dict[str, DataFrame], layout: dict[str, tuple]) -> DataFrame:
    """(section, key, measure, value) of all that the sections hold; measures without a value are left out."""
    out = None
    for name, (_, key, measures) in layout.items():
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")
        label = (F.lit("") if key is None else F.col(key).cast("string")).alias("key")
        part = sections[name].select(F.lit(name).alias("section"), label, each).select("section", "key", "m.measure", F.round("m.value", 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where("value IS NOT NULL")


def section_sql(layout: dict[str, tuple]) -> str:
    parts = []
    for name, (of, key, measures) in layout.items():
        names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f'CAST("{m}" AS DOUBLE)' for m in measures)
        label = "''" if key is None else f"CAST({key} AS VARCHAR)"
        limited = f"SELECT * FROM ({SQL[of]}) LIMIT 10" if of == "topk_03_low_inventory" else SQL[of]
        parts.append(f"SELECT '{name}' AS section, {label} AS key, unnest([{names}]) AS measure, round(unnest([{values}]), 4) AS value FROM ({limited})")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


@query("job_01_dashboard", section_sql(SECTIONS))
def _(t):
    return section_values(dashboard(t), SECTIONS)


@query("job_02_product_analytics", section_sql(PRODUCT_SECTIONS))
def _(t):
    return section_values(product_analytics(t), PRODUCT_SECTIONS)


@query("job_03_feature_store", """
SELECT 'products' AS kind, 'v1' AS feature_version, count(*) * 8 AS rows FROM lt_products UNION ALL
SELECT 'users', 'v1', count(DISTINCT user_id) * 8 FROM lt_orders WHERE status IN ('paid','shipped','delivered')""")
def _(t):
    path = work_dir(t.spark, "features")
    compute_feature_store(t, path, "v1")
    compute_feature_store(t, path, "v1")
    read = lambda kind, name: t.spark.read.parquet(f"{path}/{name}").groupBy("feature_version").agg(
        F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "feature_version", "rows")
    return read("products", "product_features").unionByName(read("users", "user_features"))


@query("set_04_rail_union", """
SELECT rail, count(*) AS n FROM (SELECT 'deals' AS rail FROM lt_users, range(8)) GROUP BY 1""")
def _(t):
    return homepage(t).where("rail = 'deals'").groupBy("rail").agg(F.count("*").alias("n"))


@query("job_03_index_refresh", f"""WITH ch AS (SELECT id, title || ' ' || title || ' ' || category_name AS text FROM lt_products WHERE id % 100 <> 7 UNION ALL SELECT id, title || ' refreshed' FROM lt_products WHERE id % 100 = 7),
tk AS (SELECT id, unnest({sql_tokens('text')}) AS term FROM ch WHERE id % 100 <> 8) SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2""")
def _(t):
    corpus = t.products.select("id", F.concat_ws(" ", "title", "title", "category_name").alias("text"))
    path = work_dir(t.spark, "stored-index")
    IX.build(corpus, path)
    changed = t.products.where("id % 100 = 7").select("id", F.concat("title", F.lit(" refreshed")).alias("text"))
    IX.refresh(path, 1, changed, corpus.where("id % 100 = 8").select("id"))
    return IX.live_postings(t.spark, path).select("id", "term", "tf")


@query("job_03_trending_lists", """WITH n AS (SELECT product_id, category_id, count(*) AS n FROM lt_events e JOIN lt_products p ON p.id = product_id, lt_asof
  WHERE p.is_active AND event_type IN ('product_view','add_to_cart','purchase') AND occurred_at >= e_now - INTERVAL 14 DAY GROUP BY 1, 2)
SELECT 'all' AS scope, product_id, CAST(row_number() OVER (ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 10
UNION ALL SELECT 'category', product_id, CAST(row_number() OVER (PARTITION BY category_id ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 10""")
def _(t):
    path = work_dir(t.spark, "lists")
    refresh_trending(t, path, "v1")
    refresh_trending(t, path, "v1")
    return t.spark.read.parquet(f"{path}/trending").select("scope", "product_id", "rank")


@query("job_03_pending_scores", "SELECT count(*) AS scored, count(*) AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    path = work_dir(t.spark, "scores")
    score_pending(t, path, "v1")
    rows = t.spark.read.parquet(f"{path}/review_scores")
    return rows.agg(F.count("sentiment_label").alias("scored"), F.count_distinct("id").alias("ids"))


@query("set_04_whole_rails", HOME + " SELECT rail, strategy, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(rank) AS BIGINT) AS ranks FROM page GROUP BY 1, 2")
def _(t):
    return whole_homepage(t, item_cf_lists(t)).groupBy("rail", "strategy").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("rank").alias("ranks"))
