"""Dashboard aggregates and short lists."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shoplattice.functions.grouped import top_k
from shoplattice.functions.scalars import micros, ntz
from shoplattice.operators import analytics as A, attribution, features, segments as SG
from shoplattice.plans.registry import query

PAID = "status IN ('paid','shipped','delivered')"

BUSINESS_SQL = f"""
WITH o AS (SELECT * FROM lt_orders WHERE {PAID}),
cur AS (SELECT count(*) AS n, coalesce(sum(total_amount), 0) AS rev, count(DISTINCT user_id) AS buyers FROM o, lt_asof
  WHERE placed_at >= o_now - INTERVAL 30 DAY AND placed_at < o_now),
prv AS (SELECT count(*) AS n, coalesce(sum(total_amount), 0) AS rev FROM o, lt_asof
  WHERE placed_at >= o_now - INTERVAL 60 DAY AND placed_at < o_now - INTERVAL 30 DAY),
rep AS (SELECT count(DISTINCT user_id) AS n FROM o, lt_asof WHERE placed_at >= o_now - INTERVAL 30 DAY AND placed_at < o_now
  AND user_id IN (SELECT user_id FROM o, lt_asof WHERE placed_at < o_now - INTERVAL 30 DAY)),
ev AS (SELECT s.* FROM lt_sessions s, lt_asof WHERE occurred_at >= e_now - INTERVAL 30 DAY AND occurred_at < e_now),
se AS (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS active,
  count(DISTINCT session_id) FILTER (WHERE event_type = 'purchase') AS bought FROM ev)
SELECT 30 AS window_days, round(cur.rev, 2) AS revenue, CASE WHEN prv.rev > 0 THEN round((cur.rev - prv.rev) / prv.rev * 100, 2) END AS revenue_change_pct,
  cur.n AS orders, CASE WHEN prv.n > 0 THEN round((cur.n - prv.n) / prv.n * 100, 2) END AS orders_change_pct,
  round(cur.rev / cur.n, 2) AS average_order_value,
  CASE WHEN prv.n > 0 THEN round((cur.rev / cur.n - prv.rev / prv.n) / (prv.rev / prv.n) * 100, 2) END AS aov_change_pct,
  cur.buyers AS unique_buyers, active AS active_users, sessions, round(bought / sessions, 4) AS conversion_rate,
  rep.n AS repeat_buyers, round(rep.n / cur.buyers, 4) AS retention_rate,
  (SELECT count(*) FROM lt_users) AS total_customers, (SELECT count(*) FROM lt_products WHERE is_active) AS total_products
FROM cur, prv, rep, se"""


@query("agg_01_business_metrics", BUSINESS_SQL)
def _(t):
    return A.business_metrics(t.orders, t.events, t.users, t.products, t.orders_as_of, t.events_as_of)


@query("agg_02_revenue_timeseries", f"""
SELECT strftime(placed_at, '%Y-%m-%d') AS date, round(sum(total_amount), 2) AS revenue, count(*) AS orders
FROM lt_orders, lt_asof WHERE {PAID} AND placed_at >= o_now - INTERVAL 30 DAY AND placed_at < o_now GROUP BY 1""")
def _(t):
    return A.revenue_timeseries(t.orders, t.orders_as_of)


ATTRIBUTED = """att AS (
  SELECT i.*, count(*) FILTER (WHERE c.kind IS NOT NULL) > 0 AS clicked, count(*) FILTER (WHERE c.kind = 'purchase') > 0 AS converted
  FROM lt_impressions i LEFT JOIN (
    SELECT e.event_type AS kind, arg_max(i.impression_id, (i.served_at, i.impression_id)) AS impression_id
    FROM lt_events e JOIN lt_impressions i ON i.user_id = e.user_id AND i.product_id = e.product_id AND i.served_at <= e.occurred_at
      AND i.served_at >= e.occurred_at - CASE e.event_type WHEN 'click' THEN INTERVAL 6 HOUR ELSE INTERVAL 48 HOUR END
    WHERE e.event_type IN ('click', 'purchase') GROUP BY e.id, e.event_type) c ON c.impression_id = i.impression_id
  GROUP BY ALL)"""


def _attributed(t):
    return attribution.attribute(t.impressions, t.events)


@query("agg_03_recommendation_metrics", f"""
WITH {ATTRIBUTED} SELECT count(*) AS impressions, count(*) FILTER (WHERE clicked) AS clicks, count(*) FILTER (WHERE converted) AS conversions,
  round(count(*) FILTER (WHERE clicked) / count(*), 5) AS ctr, round(count(*) FILTER (WHERE converted) / count(*), 5) AS conversion_rate
FROM att, lt_asof WHERE served_at >= e_now - INTERVAL 30 DAY""")
def _(t):
    return A.recommendation_metrics(_attributed(t), t.events_as_of)


@query("agg_04_ctr_by_strategy", f"""
WITH {ATTRIBUTED} SELECT strategy, count(*) AS impressions, count(*) FILTER (WHERE clicked) AS clicks,
  round(count(*) FILTER (WHERE clicked) / count(*), 5) AS ctr FROM att, lt_asof WHERE served_at >= e_now - INTERVAL 30 DAY GROUP BY strategy""")
def _(t):
    return A.ctr_by_strategy(_attributed(t), t.events_as_of)


@query("jn_08_impression_attribution", f"WITH {ATTRIBUTED} SELECT impression_id, clicked, converted FROM att")
def _(t):
    return _attributed(t).select("impression_id", "clicked", "converted")


@query("agg_05_search_metrics", """
SELECT count(*) AS searches, count(clicked_product_id) AS clicks, count(*) FILTER (WHERE converted) AS conversions,
  round(count(clicked_product_id) / count(*), 5) AS ctr, round(count(*) FILTER (WHERE converted) / count(*), 5) AS conversion_rate,
  round((count(*) - count(clicked_product_id)) / count(*), 5) AS abandonment_rate,
  round(count(*) FILTER (WHERE result_count = 0) / count(*), 5) AS zero_result_rate, round(avg(latency_ms), 2) AS avg_latency_ms
FROM lt_search, lt_asof WHERE occurred_at >= e_now - INTERVAL 30 DAY""")
def _(t):
    return A.search_metrics(t.search_events, t.events_as_of)


@query("agg_06_customer_counts", f"""
SELECT (SELECT count(*) FROM (SELECT user_id, min(placed_at) AS m FROM lt_orders WHERE user_id IN (SELECT id FROM lt_users) GROUP BY 1), lt_asof
    WHERE m >= o_now - INTERVAL 30 DAY) AS new_users,
  (SELECT count(DISTINCT user_id) FROM lt_orders, lt_asof WHERE {PAID} AND placed_at >= o_now - INTERVAL 30 DAY) AS window_buyers""")
def _(t):
    return A.customer_counts(t.users_with_signup, t.orders, t.orders_as_of)


@query("agg_07_segment_mix", SG.SEGMENT_SQL + """
SELECT segment_label AS label, count(*) AS "count", round(avg(monetary), 4) AS avg_monetary,
  CASE segment_label WHEN 'at_risk' THEN 'At Risk' WHEN 'high_value' THEN 'High Value' ELSE 'Occasional Buyer' END AS name,
  segment_label = 'high_value' AS is_high_value, segment_label = 'at_risk' AS is_at_risk FROM seg WHERE model_version = 'v2' GROUP BY ALL""")
def _(t):
    return A.segment_mix(SG.rule_segments(t))


@query("agg_08_top_customers", f"""
SELECT user_id, u.full_name AS name, email, total_spend, orders FROM (SELECT user_id, round(sum(total_amount), 2) AS total_spend, count(*) AS orders
  FROM lt_orders WHERE {PAID} GROUP BY 1 ORDER BY total_spend DESC, user_id LIMIT 10) JOIN lt_users u ON u.id = user_id""")
def _(t):
    return A.top_customers(t.users, t.orders)


@query("agg_09_category_breakdown", """
SELECT category_name AS category, category_slug AS slug, count(DISTINCT p.id) AS products, round(coalesce(sum(line_total), 0), 2) AS revenue
FROM lt_products p LEFT JOIN lt_lines l ON l.product_id = p.id GROUP BY 1, 2 ORDER BY revenue DESC LIMIT 12""")
def _(t):
    return A.category_breakdown(t.products, t.order_lines)


@query("agg_10_event_funnel", """
SELECT count(*) FILTER (WHERE event_type = 'product_view') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  round(count(*) FILTER (WHERE event_type = 'add_to_cart') / count(*) FILTER (WHERE event_type = 'product_view'), 5) AS view_to_cart,
  round(count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'add_to_cart'), 5) AS cart_to_purchase,
  round(count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type = 'product_view'), 5) AS view_to_purchase
FROM lt_events, lt_asof WHERE occurred_at >= e_now - INTERVAL 30 DAY""")
def _(t):
    return A.event_funnel(t.events, t.events_as_of)


@query("agg_10_event_counts", """
SELECT event_type, count(*) AS "count" FROM lt_events, lt_asof WHERE occurred_at >= e_now - INTERVAL 30 DAY GROUP BY event_type""")
def _(t):
    return A.event_counts(t.events, t.events_as_of)


@query("agg_11_best_sellers", f"""
SELECT b.id, sku, title, price, inventory, units_sold, revenue FROM (SELECT product_id AS id, sum(quantity) AS units_sold, round(sum(line_total), 2) AS revenue
  FROM lt_items, lt_asof WHERE {PAID} AND placed_at >= o_now - INTERVAL 90 DAY GROUP BY 1 ORDER BY units_sold DESC, id LIMIT 10) b JOIN lt_products p ON p.id = b.id""")
def _(t):
    return A.best_sellers(t.order_items, t.products, t.orders_as_of)


CONV_SQL = """
SELECT c.id, title, views, purchases, round(purchases / views, 5) AS conversion_rate FROM (SELECT product_id AS id,
  count(*) FILTER (WHERE event_type IN ('product_view','click')) AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
  FROM lt_events GROUP BY 1) c JOIN lt_products p ON p.id = c.id WHERE views >= 10 ORDER BY conversion_rate {}, c.id LIMIT 10"""


@query("agg_12_conversion_best", CONV_SQL.format("DESC"))
def _(t):
    return A.conversion_stats(t.events, t.products)


@query("agg_12_conversion_worst", CONV_SQL.format("ASC"))
def _(t):
    return A.conversion_stats(t.events, t.products, best=False)


@query("agg_13_popular_categories", """
SELECT category_id AS id, category_slug AS slug, category_name AS name, count(*) AS product_count, round(avg(rating_avg), 2) AS avg_rating
FROM lt_products WHERE is_active GROUP BY ALL ORDER BY product_count DESC, id LIMIT 8""")
def _(t):
    return A.popular_categories(t.products)


@query("agg_14_rating_refresh", """
SELECT p.id, coalesce(a, 0.0::DOUBLE) AS rating_avg, coalesce(n, 0) AS rating_count FROM lt_products p
LEFT JOIN (SELECT product_id, round(avg(rating), 2) AS a, count(*) AS n FROM lt_reviews GROUP BY 1) r ON r.product_id = p.id""")
def _(t):
    return A.refresh_ratings(t.products, t.reviews).select("id", "rating_avg", "rating_count")


@query("agg_15_popular_queries", """
SELECT normalized_query AS query, count(*) AS searches, count(*) FILTER (WHERE clicked_product_id > 0) AS clicks,
  round(count(*) FILTER (WHERE clicked_product_id > 0) / count(*), 4) AS ctr
FROM lt_search, lt_asof WHERE occurred_at >= e_now - INTERVAL 30 DAY AND normalized_query <> '' GROUP BY 1 ORDER BY searches DESC, query LIMIT 10""")
def _(t):
    return A.popular_queries(t.search_events, t.events_as_of)


@query("agg_16_demand_history", f"""
SELECT product_id, strftime(placed_at, '%Y-%m-%d') AS date, sum(quantity) AS units FROM lt_items, lt_asof
WHERE {PAID} AND placed_at >= o_now - INTERVAL 120 DAY GROUP BY 1, 2""")
def _(t):
    return A.demand_history(t.order_items, t.orders_as_of)


@query("agg_17_segment_overview", SG.SEGMENT_SQL + """
SELECT segment_label AS label, count(*) AS customer_count, round(avg(monetary), 4) AS avg_monetary, round(avg(frequency), 4) AS avg_frequency,
  round(avg(recency_days), 2) AS avg_recency_days, round(avg(avg_order_value), 4) AS avg_order_value, round(avg(rfm_score), 4) AS avg_rfm_score,
  round(avg(confidence), 4) AS avg_confidence, round(count(*) / sum(count(*)) OVER (), 4) AS share,
  CASE segment_label WHEN 'at_risk' THEN 'At Risk' WHEN 'high_value' THEN 'High Value' ELSE 'Occasional Buyer' END AS name
FROM seg WHERE model_version = 'v2' GROUP BY segment_label""")
def _(t):
    return A.segment_overview(SG.rule_segments(t))


@query("agg_18_sentiment_distribution", """
SELECT sentiment_label, count(*) AS "count", round(count(*) / (SELECT count(*) FROM lt_reviews), 4) AS share,
  (SELECT count(*) FROM lt_reviews) AS total_labelled, (SELECT count(*) FROM documents) AS total_reviews FROM lt_reviews GROUP BY 1""")
def _(t):
    return A.sentiment_distribution(t.reviews.unionByName(t.pending_reviews))


@query("agg_22_co_purchase_counts", """
SELECT product_id, other_id, n, rank, round(n / max(n) OVER (PARTITION BY product_id), 6) AS score FROM (
  SELECT a.product_id, b.product_id AS other_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY a.product_id ORDER BY count(*) DESC, b.product_id) AS INTEGER) AS rank
  FROM (SELECT DISTINCT order_id, product_id FROM lt_lines) a JOIN lt_lines b ON a.order_id = b.order_id AND a.product_id <> b.product_id
  GROUP BY 1, 2) WHERE rank <= 4""")
def _(t):
    return A.co_purchase_counts(t.order_lines).withColumn("score", F.round("score", 6))


TREND_SQL = """
WITH c AS (SELECT product_id, category_id, count(*) AS n FROM lt_asof, lt_events e JOIN lt_products p ON p.id = e.product_id AND p.is_active
  WHERE occurred_at >= e_now - INTERVAL 14 DAY AND event_type IN ('product_view','add_to_cart','purchase') GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER ({part} ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM c)
SELECT product_id, category_id, n, rank, round(n / max(n) OVER ({part}), 5) AS score FROM r WHERE rank <= {k}"""


@query("agg_23_trending", TREND_SQL.format(part="", k=10))
def _(t):
    return A.trending(t.events, t.products, t.events_as_of)


@query("agg_23_trending_by_category", TREND_SQL.format(part="PARTITION BY category_id", k=5))
def _(t):
    return A.trending(t.events, t.products, t.events_as_of, k=5, per_category=True)


@query("agg_24_model_health", """
SELECT model_name, model_version, count(*) AS logged_predictions, round(avg(latency_ms), 4) AS avg_latency_ms,
  round(max(latency_ms), 4) AS max_latency_ms, count(*) FILTER (WHERE NOT succeeded) AS failures
FROM lt_preds, lt_asof WHERE predicted_at >= e_now - INTERVAL 7 DAY GROUP BY 1, 2""")
def _(t):
    return A.model_health(t.predictions, t.events_as_of)


SERVING_SQL = """
SELECT l.model_name, calls, failures, round(avg_l, 4) AS avg_latency_ms, round(failures / calls, 5) AS error_rate, round(p95, 4) AS p95_latency_ms
FROM (SELECT model_name, count(*) AS calls, count(*) FILTER (WHERE NOT succeeded) AS failures, avg(latency_ms) AS avg_l FROM lt_preds GROUP BY 1) l
JOIN (SELECT model_name, list_sort(list(latency_ms))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p95 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY predicted_at DESC, id DESC) AS r FROM lt_preds) WHERE r <= 500 GROUP BY 1) q ON q.model_name = l.model_name"""


@query("agg_25_serving_stats", SERVING_SQL)
def _(t):
    return A.serving_stats(t.predictions)


@query("agg_26_feature_coverage", """
SELECT 'v1' AS feature_version, count(*) AS entities FROM lt_products UNION ALL SELECT 'v0', count(*) FROM lt_products WHERE id % 2 = 0""")
def _(t):
    f = features.product_features(t.events, t.order_items, t.products, t.orders_as_of, "v1")
    old = f.where(F.col("product_id") % 2 == 0).withColumn("feature_version", F.lit("v0"))
    return A.feature_coverage(f.unionByName(old), "product_id")


@query("agg_27_feature_versions", "SELECT DISTINCT model_version FROM lt_preds")
def _(t):
    return t.predictions.select("model_version").distinct()


@query("agg_28_user_order_stats", f"""
SELECT user_id, count(*) AS order_count, round(sum(total_amount), 2) AS total_spend, round(avg(total_amount), 6) AS avg_order_value
FROM lt_orders WHERE {PAID} GROUP BY 1""")
def _(t):
    return A.user_order_stats(t.orders)


@query("agg_29_dataset_summary", """
SELECT 'products' AS dataset, count(*) AS rows FROM lt_products UNION ALL SELECT 'users', count(*) FROM lt_users
UNION ALL SELECT 'orders', count(*) FROM lt_orders UNION ALL SELECT 'order_lines', count(*) FROM lt_lines
UNION ALL SELECT 'events', count(*) FROM lt_events UNION ALL SELECT 'reviews', count(*) FROM lt_reviews""")
def _(t):
    return A.dataset_summary({n: getattr(t, n) for n in ("products", "users", "orders", "order_lines", "events", "reviews")})


@query("topk_05_recent_per_user", """
SELECT user_id, id, event_type, epoch_us(occurred_at) AS occurred_us, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS INTEGER) AS rank
  FROM lt_events) WHERE rank <= 5""")
def _(t):
    e = t.events.select("user_id", "id", "event_type", "occurred_at")
    return top_k(e, ["user_id"], [F.col("occurred_at").desc(), F.col("id").desc()], 5).withColumn(
        "occurred_us", micros("occurred_at")).drop("occurred_at")


# ---- joins the dashboard relies on ----------------------------------------
@query("jn_01_star_join", "SELECT id, category_name, brand_name, brand_reputation FROM lt_products")
def _(t):
    from shoplattice.sources.readers import scan_products
    return scan_products(t.products, t.categories, t.brands).select("id", "category_name", "brand_name", "brand_reputation")


@query("jn_02_fact_join", f"SELECT user_id, count(*) AS lines, sum(quantity) AS units FROM lt_items WHERE {PAID} GROUP BY 1")
def _(t):
    return t.order_items.where(A.is_revenue()).groupBy("user_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("units"))


@query("jn_03_left_outer_coalesce", """
SELECT p.id, coalesce(sum(quantity), 0.0::DOUBLE) AS units FROM lt_products p LEFT JOIN lt_items i ON i.product_id = p.id AND i.status = 'pending'
  AND i.placed_at >= TIMESTAMP '2001-06-01' GROUP BY 1""")
def _(t):
    from datetime import datetime
    live = t.order_items.where((F.col("status") == "pending") & (F.col("placed_at") >= ntz(datetime(2001, 6, 1))))
    units = live.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").alias("units"))
    return t.products.select("id").join(units, "id", "left").select("id", F.coalesce("units", F.lit(0.0)).alias("units"))


@query("jn_05_repeat_buyers", f"""
SELECT DISTINCT user_id FROM lt_orders, lt_asof WHERE {PAID} AND placed_at >= o_now - INTERVAL 30 DAY
  AND user_id IN (SELECT user_id FROM lt_orders, lt_asof WHERE {PAID} AND placed_at < o_now - INTERVAL 30 DAY)""")
def _(t):
    since = ntz(t.orders_as_of - timedelta(days=30))
    paid = t.orders.where(A.is_revenue())
    earlier = paid.where(F.col("placed_at") < since).select("user_id")
    return paid.where(F.col("placed_at") >= since).select("user_id").distinct().join(earlier, "user_id", "left_semi")


@query("jn_10_map_lookup", "SELECT user_id, count(*) AS n, round(avg(price), 4) AS avg_price FROM lt_events e JOIN lt_products p ON p.id = e.product_id GROUP BY 1")
def _(t):
    price = t.products.select(F.col("id").alias("product_id"), "price")
    return t.events.join(price, "product_id").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("avg_price"))
