"""Scans, sinks, projections, filters, sorts and quality rules."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shoplattice.functions.scalars import day, micros
from shoplattice.operators import catalog as C, quality as Q
from shoplattice.plans.registry import query
from shoplattice.session import work_dir
from shoplattice.sources import readers as R, sinks as S

NOW = datetime(2024, 2, 1)


# ---- scans -----------------------------------------------------------------
@query("src_01_product_scan", """
SELECT id, sku, title, description, category_id, brand_id, round(price, 2) AS price, round(base_cost, 4) AS base_cost,
  discount_pct, rating_avg, rating_count, inventory, is_active, array_to_string(tags, ',') AS tags,
  strftime(launched_at, '%Y-%m-%d') AS launched_on, category_slug, category_name, brand_name, brand_reputation
FROM lt_products""")
def _(t):
    df = R.scan_products(t.products, t.categories, t.brands)
    return df.select(
        "id", "sku", "title", "description", "category_id", "brand_id", F.round("price", 2).alias("price"),
        F.round("base_cost", 4).alias("base_cost"), "discount_pct", "rating_avg", "rating_count", "inventory",
        "is_active", F.array_join("tags", ",").alias("tags"), day("launched_at").alias("launched_on"),
        "category_slug", "category_name", "brand_name", "brand_reputation")


@query("src_02_user_scan", """
SELECT id, email, full_name, role, is_active, country, signup_source, price_sensitivity,
  CAST(id % 6 + 1 AS BIGINT) AS first_category, CAST(2 AS INTEGER) AS n_categories, CAST(id % 25 + 1 AS BIGINT) AS first_brand FROM lt_users""")
def _(t):
    u = R.scan_users(t.users)
    return u.select("id", "email", "full_name", "role", "is_active", "country", "signup_source", "price_sensitivity",
                    F.col("preferred_categories")[0].alias("first_category"),
                    F.size("preferred_categories").alias("n_categories"),
                    F.col("preferred_brands")[0].alias("first_brand"))


@query("src_03_event_scan", """
SELECT id, user_id, event_type, product_id, quantity, value, source, epoch_us(occurred_at) AS occurred_us
FROM lt_events WHERE occurred_at >= TIMESTAMP '2024-01-15'""")
def _(t):
    e = R.scan_events(t.events, since=datetime(2024, 1, 15))
    return e.select("id", "user_id", "event_type", "product_id", "quantity", "value", "source",
                    micros("occurred_at").alias("occurred_us"))


@query("src_04_order_scan", """
SELECT id, user_id, status, total_amount, round(discount_amount, 4) AS discount_amount, channel,
  strftime(placed_at, '%Y-%m-%d') AS placed_on FROM lt_orders""")
def _(t):
    return t.orders.select("id", "user_id", "status", "total_amount", F.round("discount_amount", 4).alias("discount_amount"),
                           "channel", day("placed_at").alias("placed_on"))


@query("src_05_order_item_scan", """
SELECT i.order_id, i.product_id, i.quantity, round(i.unit_price, 8) AS unit_price, round(i.discount_pct, 4) AS discount_pct,
  round(i.line_total, 6) AS line_total, i.user_id, i.status, strftime(i.placed_at, '%Y-%m-%d') AS placed_on,
  p.category_id, p.brand_id FROM lt_items i JOIN lt_products p ON p.id = i.product_id""")
def _(t):
    df = R.scan_order_items(t.order_items, t.products)
    return df.select("order_id", "product_id", "quantity", F.round("unit_price", 8).alias("unit_price"),
                     F.round("discount_pct", 4).alias("discount_pct"), F.round("line_total", 6).alias("line_total"),
                     "user_id", "status", day("placed_at").alias("placed_on"), "category_id", "brand_id")


@query("src_06_review_scan", """
SELECT id, product_id, user_id, rating, title, length(body) AS body_chars, verified_purchase, helpful_votes, sentiment_label,
  round(sentiment_score, 4) AS sentiment_score, strftime(created_at, '%Y-%m-%d %H') AS created_hour FROM lt_reviews""")
def _(t):
    return t.reviews.select("id", "product_id", "user_id", "rating", "title",
                            F.length("body").cast("long").alias("body_chars"), "verified_purchase", "helpful_votes",
                            "sentiment_label", F.round("sentiment_score", 4).alias("sentiment_score"),
                            F.date_format("created_at", "yyyy-MM-dd HH").alias("created_hour"))


@query("src_07_search_event_scan", """
SELECT id, user_id, query, normalized_query, result_count, CAST(coalesce(clicked_product_id, -1) AS BIGINT) AS clicked_product_id,
  converted, latency_ms, strftime(occurred_at, '%Y-%m-%d %H:%M') AS occurred_minute FROM lt_search""")
def _(t):
    return t.search_events.select("id", "user_id", "query", "normalized_query", "result_count",
                                  F.coalesce("clicked_product_id", F.lit(-1)).alias("clicked_product_id"), "converted",
                                  "latency_ms", F.date_format("occurred_at", "yyyy-MM-dd HH:mm").alias("occurred_minute"))


@query("src_08_daily_demand", """
SELECT product_id, strftime(day, '%Y-%m-%d') AS day, units, round(revenue, 6) AS revenue, round(avg_price, 8) AS avg_price FROM lt_demand""")
def _(t):
    return R.daily_demand(t.order_items).select(
        "product_id", day("day").alias("day"), "units", F.round("revenue", 6).alias("revenue"),
        F.round("avg_price", 8).alias("avg_price"))


@query("src_09_lenient_json", """
SELECT id, CASE WHEN bad_json THEN 0.0::DOUBLE ELSE size_ * 10.0 END AS weight_g,
  CAST(CASE WHEN NOT bad_json AND size_ % 3 = 0 THEN size_ % 24 ELSE 12 END AS DOUBLE) AS warranty_months,
  NOT bad_json AS decoded FROM lt_products""")
def _(t):
    good = R.lenient_json("specifications_json", "struct<size:int>")["size"].isNotNull()
    return t.products.select("id", R.json_number("specifications_json", "weight_g", 0).alias("weight_g"),
                             R.json_number("specifications_json", "warranty_months", 12).alias("warranty_months"),
                             good.alias("decoded"))


@query("src_10_lenient_timestamp", """
SELECT id, CASE WHEN id % 7 = 0 THEN -1 ELSE epoch_us(placed_at) END AS placed_us FROM lt_orders""")
def _(t):
    text = F.when(F.col("id") % 7 == 0, "not a date").otherwise(F.date_format("placed_at", "yyyy-MM-dd HH:mm:ss"))
    parsed = R.lenient_timestamp(text)
    return t.orders.select("id", F.coalesce(F.unix_micros(parsed), F.lit(-1)).alias("placed_us"))


@query("src_11_load_all", """
SELECT 'products' AS view_name, count(*) AS n FROM lt_products UNION ALL SELECT 'orders', count(*) FROM lt_orders
UNION ALL SELECT 'order_items', count(*) FROM lt_items UNION ALL SELECT 'events', count(*) FROM lt_events
UNION ALL SELECT 'reviews', count(*) FROM lt_reviews""")
def _(t):
    t.register_views()
    names = ("products", "orders", "order_items", "events", "reviews")
    return t.spark.sql(" UNION ALL ".join(
        f"SELECT '{n}' AS view_name, count(*) AS n FROM shop_{n}" for n in names))


# ---- sinks -----------------------------------------------------------------
@query("snk_01_bulk_write", "SELECT status, count(*) AS n, round(sum(total_amount), 2) AS amount FROM lt_orders GROUP BY status")
def _(t):
    path = work_dir(t.spark, "bulk")
    S.write_table(t.orders, path, partition_by=("status",))
    return t.spark.read.parquet(path).groupBy("status").agg(
        F.count("*").alias("n"), F.round(F.sum("total_amount"), 2).alias("amount"))


@query("snk_02_replace_version", """
SELECT 'v1' AS model_version, count(*) AS n, CAST(sum(user_id) % 100000 AS BIGINT) AS key_sum FROM lt_orders WHERE status = 'paid'
UNION ALL SELECT 'v2', count(*), CAST(sum(user_id) % 100000 AS BIGINT) FROM lt_orders""")
def _(t):
    path = work_dir(t.spark, "versions")
    rows = t.orders.select("id", "user_id", "status")
    S.replace_version(rows.withColumn("model_version", F.lit("v1")), path)
    S.replace_version(rows.withColumn("model_version", F.lit("v2")), path)
    S.replace_version(rows.where("status = 'paid'").withColumn("model_version", F.lit("v1")), path)
    return t.spark.read.parquet(path).groupBy("model_version").agg(
        F.count("*").alias("n"), (F.sum("user_id") % 100000).alias("key_sum"))


@query("snk_03_feature_upsert", """
SELECT product_id, 'price' AS feature_name, price AS feature_value, 'v1' AS feature_version
FROM (SELECT id AS product_id, price FROM lt_products) WHERE product_id % 2 = 1
UNION ALL SELECT id, 'inventory', CAST(inventory AS DOUBLE), 'v1' FROM lt_products WHERE id % 2 = 0
UNION ALL SELECT id, 'price', price, 'v0' FROM lt_products""")
def _(t):
    def rows(name, value, version):
        return t.products.select(F.col("id").alias("product_id"), F.lit(name).alias("feature_name"),
                                 F.col(value).cast("double").alias("feature_value"), F.lit(version).alias("feature_version"))
    stored = rows("price", "price", "v1").unionByName(rows("price", "price", "v0"))
    fresh = rows("inventory", "inventory", "v1").where(F.col("product_id") % 2 == 0)
    return S.upsert_features(stored, fresh, "product_id")


@query("snk_04_score_write_back", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'neutral' ELSE sentiment_label END AS sentiment_label,
  round(CASE WHEN id % 3 = 0 THEN 0.25::DOUBLE ELSE sentiment_score END, 4) AS sentiment_score FROM lt_reviews""")
def _(t):
    base = t.reviews.select("id", "sentiment_label", "sentiment_score")
    upd = base.where("id % 3 = 0").select("id", F.lit("neutral").alias("sentiment_label"), F.lit(0.25).alias("sentiment_score"))
    out = S.write_back(base, upd, "id", ["sentiment_label", "sentiment_score"])
    return out.withColumn("sentiment_score", F.round("sentiment_score", 4))


@query("snk_05_exports", """
SELECT 'csv' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM lt_products UNION ALL SELECT 'json', count(*), CAST(sum(id) AS BIGINT) FROM lt_products""")
def _(t):
    rows = t.products.select("id", "title", "price")
    csv, js = work_dir(t.spark, "csv"), work_dir(t.spark, "json")
    S.export_csv(rows, csv)
    S.export_json(rows, js)
    schema = "id long, title string, price double"
    a = t.spark.read.schema(schema).option("header", True).csv(csv).select(F.lit("csv").alias("kind"), "id")
    b = t.spark.read.schema(schema).json(js).select(F.lit("json").alias("kind"), "id")
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("snk_06_impression_sink", """
SELECT surface, strategy, model_version, count(*) AS n, CAST(0 AS BIGINT) AS clicked FROM lt_impressions GROUP BY ALL""")
def _(t):
    served = t.impressions.select("user_id", "product_id", "strategy", F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    path = work_dir(t.spark, "impressions")
    S.write_table(S.impression_rows(served, "homepage", "v1", NOW), path)
    return t.spark.read.parquet(path).groupBy("surface", "strategy", "model_version").agg(
        F.count("*").alias("n"), F.count_if("clicked").alias("clicked"))


@query("snk_07_search_log_sink", r"""
SELECT user_id, left(query, 255) AS query, left(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), 255) AS normalized_query, result_count, latency_ms FROM lt_search""")
def _(t):
    path = work_dir(t.spark, "searches")
    S.write_table(S.search_log_rows(t.search_events), path)
    return t.spark.read.parquet(path).drop("occurred_at")


@query("snk_08_prediction_sample", """
SELECT id, model_name, succeeded FROM lt_preds
WHERE NOT succeeded OR CAST('0x' || md5(CAST(id AS VARCHAR))[1:8] AS BIGINT) % 100 < 15""")
def _(t):
    return S.sampled_predictions(t.predictions).select("id", "model_name", "succeeded")


# ---- projections -----------------------------------------------------------
@query("prj_01_effective_price", "SELECT id, effective_price FROM lt_products")
def _(t):
    return t.products.select("id", "effective_price")


@query("prj_02_in_stock", "SELECT id, inventory > 0 AS in_stock FROM lt_products")
def _(t):
    return t.products.select("id", (F.col("inventory") > 0).alias("in_stock"))


@query("prj_03_searchable_text", """
SELECT id, trim(title || ' ' || description || ' ' || array_to_string(tags, ' ') || CASE WHEN bad_json THEN ''
  ELSE ' size ' || size_ || ' weight_g ' || size_ * 10 || CASE WHEN size_ % 3 = 0 THEN ' warranty_months ' || size_ % 24 ELSE '' END END) AS searchable_text
FROM lt_products""")
def _(t):
    return t.products.select("id", C.searchable_text().alias("searchable_text"))


@query("prj_04_flags", """
SELECT 'order' AS kind, id, CASE WHEN status IN ('paid','shipped','delivered') THEN 1.0::DOUBLE ELSE 0 END AS flag FROM lt_orders
UNION ALL SELECT 'search', id, CASE WHEN clicked_product_id IS NULL THEN 1.0::DOUBLE ELSE 0 END FROM lt_search
UNION ALL SELECT 'event', id, CASE event_type WHEN 'product_view' THEN 1 WHEN 'click' THEN 1.5 WHEN 'wishlist' THEN 3
  WHEN 'add_to_cart' THEN 4 WHEN 'remove_from_cart' THEN -1 WHEN 'purchase' THEN 6 ELSE 0 END FROM lt_events""")
def _(t):
    o = C.flag_orders(t.orders).select(F.lit("order").alias("kind"), "id", F.col("is_revenue").cast("double").alias("flag"))
    s = C.flag_searches(t.search_events).select(F.lit("search").alias("kind"), "id", F.col("abandoned").cast("double").alias("flag"))
    e = C.flag_events(t.events).select(F.lit("event").alias("kind"), "id", F.col("weight").alias("flag"))
    return o.unionByName(s).unionByName(e)


@query("prj_05_stock_label", """
SELECT id, CASE WHEN inventory <= 0 THEN 'Out of stock' WHEN inventory < 10 THEN 'Only ' || inventory || ' left' ELSE 'In stock' END AS label FROM lt_products""")
def _(t):
    return t.products.select("id", C.stock_label().alias("label"))


@query("prj_06_cart_summary", """
WITH c AS (SELECT l.order_id AS cart_id, sum(p.effective_price * l.quantity) AS subtotal,
    sum(greatest(p.price - p.effective_price, 0) * l.quantity) AS savings, sum(l.quantity) AS item_count
  FROM lt_lines l JOIN lt_products p ON p.id = l.product_id GROUP BY ALL),
d AS (SELECT *, CASE WHEN subtotal > 50 OR subtotal = 0 THEN 0.0::DOUBLE ELSE 6.99::DOUBLE END AS shipping FROM c)
SELECT cart_id, round(subtotal, 6) AS subtotal, round(savings, 6) AS savings, item_count, shipping,
  round(subtotal * 0.08::DOUBLE, 6) AS tax, round(subtotal + shipping + subtotal * 0.08::DOUBLE, 6) AS total FROM d""")
def _(t):
    lines = t.order_lines.select(F.col("order_id").alias("cart_id"), F.col("product_id").alias("id"), "quantity").join(
        t.products.select("id", "price", "effective_price"), "id")
    c = C.cart_summary(lines)
    return c.select("cart_id", *[F.round(x, 6).alias(x) for x in ("subtotal", "savings")], "item_count", "shipping",
                    *[F.round(x, 6).alias(x) for x in ("tax", "total")])


@query("prj_07_margin", """
SELECT id, round(least(greatest((price * (1 - discount_pct / 100.0) - base_cost) / greatest(price * (1 - discount_pct / 100.0), 0.001), 0), 1), 6) AS margin FROM lt_products""")
def _(t):
    return t.products.select("id", F.round(C.margin(), 6).alias("margin"))


@query("prj_08_dominant_signal", """
SELECT id, CASE WHEN r >= a AND r >= d THEN 'rating' WHEN a >= d THEN 'availability' ELSE 'discount' END AS dominant_signal
FROM (SELECT id, rating_avg / 5.0 AS r, inventory / 120.0 AS a, discount_pct / 30.0 AS d FROM lt_products)""")
def _(t):
    s = t.products.select("id", (F.col("rating_avg") / 5.0).alias("rating"), (F.col("inventory") / 120.0).alias("availability"),
                          (F.col("discount_pct") / 30.0).alias("discount"))
    return s.select("id", C.dominant_signal(["rating", "availability", "discount"]).alias("dominant_signal"))


# ---- filters ---------------------------------------------------------------
@query("flt_01_catalogue_filter", """
SELECT id, title, price, rating_avg FROM lt_products WHERE is_active AND category_slug IN ('promo','large') AND price >= 905
  AND price <= 1080 AND rating_avg >= 2.5 AND inventory > 0 AND discount_pct > 0""")
def _(t):
    f = C.CatalogFilter(category_slugs=("promo", "large"), min_price=905, max_price=1080, min_rating=2.5,
                        in_stock_only=True, on_sale_only=True)
    return C.list_products(t.products, f).select("id", "title", "price", "rating_avg")


@query("flt_02_search_filter", """
SELECT id, effective_price FROM lt_products WHERE is_active AND category_id IN (1, 3, 5) AND brand_id IN (2, 4, 6, 8)
  AND effective_price >= 650 AND effective_price <= 900""")
def _(t):
    f = C.CatalogFilter(category_ids=(1, 3, 5), brand_ids=(2, 4, 6, 8), min_price=650, max_price=900)
    return C.search_filter(t.products, f).select("id", "effective_price")


@query("flt_03_time_windows", """
SELECT id, CASE WHEN placed_at >= o_now - INTERVAL 30 DAY THEN 'current' ELSE 'previous' END AS win
FROM lt_orders, lt_asof WHERE placed_at >= o_now - INTERVAL 60 DAY AND placed_at < o_now""")
def _(t):
    from shoplattice.operators.analytics import trailing_windows
    return trailing_windows(t.orders, "placed_at", t.orders_as_of, 30).select("id", F.col("window").alias("win"))


@query("flt_04_reviews_for_product", """
SELECT id, product_id, helpful_votes, position FROM (SELECT *, row_number() OVER (PARTITION BY product_id
  ORDER BY helpful_votes DESC, created_at DESC, id) AS position FROM lt_reviews WHERE sentiment_label = 'neutral') WHERE position <= 10""")
def _(t):
    return C.reviews_for(t.reviews, "neutral", 10).select("id", "product_id", "helpful_votes", "position")


@query("flt_05_key_lookup", """
SELECT id, title, category_name, brand_name FROM lt_products WHERE id IN (SELECT product_id FROM lt_events WHERE event_type = 'purchase')""")
def _(t):
    keys = t.events.where("event_type = 'purchase'").select(F.col("product_id").alias("id"))
    return C.by_keys(t.products, keys).select("id", "title", "category_name", "brand_name")


# ---- quality ---------------------------------------------------------------
def _frames(t):
    return {"products": t.products, "users": t.users, "events": t.events, "order_items": t.order_items,
            "reviews": t.reviews, "daily_demand": R.daily_demand(t.order_items)}


@query("dq_01_minimum_rows", """
WITH c AS (SELECT 'products' AS dataset, count(*) AS rows, 10 AS minimum FROM lt_products
UNION ALL SELECT 'users', count(*), 5 FROM lt_users UNION ALL SELECT 'events', count(*), 50 FROM lt_events
UNION ALL SELECT 'order_items', count(*), 20 FROM lt_items UNION ALL SELECT 'reviews', count(*), 20 FROM lt_reviews
UNION ALL SELECT 'daily_demand', count(*), 20 FROM lt_demand)
SELECT *, rows >= minimum AS ok FROM c""")
def _(t):
    return Q.minimum_rows(_frames(t))


@query("dq_02_value_problems", """
SELECT 'products: duplicate ids' AS problem, count(*) - count(DISTINCT id) AS violations FROM lt_products
UNION ALL SELECT 'products: negative prices', count(*) FILTER (WHERE price < 0) FROM lt_products
UNION ALL SELECT 'reviews: ratings outside 1-5', count(*) FILTER (WHERE rating NOT BETWEEN 1 AND 5) FROM lt_reviews""")
def _(t):
    return Q.value_problems(t.products, t.reviews)


@query("dq_03_table_rules", """
SELECT 'brands' AS "table", 'reputation_in_unit_range' AS rule, count(*) AS rows, count(*) FILTER (WHERE reputation_score NOT BETWEEN 0 AND 1) AS violations FROM lt_brands
UNION ALL SELECT 'products', 'price_not_negative', count(*), count(*) FILTER (WHERE price < 0) FROM lt_products
UNION ALL SELECT 'products', 'discount_below_100', count(*), count(*) FILTER (WHERE discount_pct < 0 OR discount_pct >= 100) FROM lt_products
UNION ALL SELECT 'products', 'inventory_not_negative', count(*), count(*) FILTER (WHERE inventory < 0) FROM lt_products
UNION ALL SELECT 'products', 'rating_in_range', count(*), count(*) FILTER (WHERE rating_avg NOT BETWEEN 0 AND 5) FROM lt_products
UNION ALL SELECT 'users', 'price_sensitivity_in_unit_range', count(*), count(*) FILTER (WHERE price_sensitivity NOT BETWEEN 0 AND 1) FROM lt_users
UNION ALL SELECT 'users', 'role_known', count(*), count(*) FILTER (WHERE role NOT IN ('customer','admin','analyst')) FROM lt_users
UNION ALL SELECT 'orders', 'total_not_negative', count(*), count(*) FILTER (WHERE total_amount < 0) FROM lt_orders
UNION ALL SELECT 'orders', 'status_known', count(*), count(*) FILTER (WHERE status NOT IN ('pending','paid','shipped','delivered','cancelled','returned')) FROM lt_orders
UNION ALL SELECT 'order_lines', 'quantity_positive', count(*), count(*) FILTER (WHERE quantity <= 0) FROM lt_lines
UNION ALL SELECT 'order_lines', 'unit_price_not_negative', count(*), count(*) FILTER (WHERE unit_price < 0) FROM lt_lines
UNION ALL SELECT 'reviews', 'rating_in_range', count(*), count(*) FILTER (WHERE rating NOT BETWEEN 1 AND 5) FROM lt_reviews
UNION ALL SELECT 'reviews', 'label_known', count(*), count(*) FILTER (WHERE sentiment_label NOT IN ('positive','neutral','negative')) FROM lt_reviews
UNION ALL SELECT 'raw_events', 'event_type_known', count(*), count(*) FILTER (WHERE event_type NOT IN ('product_view','search','click','add_to_cart','remove_from_cart','wishlist','purchase','review')) FROM lt_raw_events
UNION ALL SELECT 'raw_events', 'quantity_positive', count(*), count(*) FILTER (WHERE quantity < 1) FROM lt_raw_events
UNION ALL SELECT 'categories', 'unique_slug', count(*), count(*) - count(DISTINCT slug) FROM lt_categories
UNION ALL SELECT 'products', 'unique_id', count(*), count(*) - count(DISTINCT id) FROM lt_products
UNION ALL SELECT 'orders', 'unique_id', count(*), count(*) - count(DISTINCT id) FROM lt_orders
UNION ALL SELECT 'reviews', 'unique_product_id_user_id', count(*), count(*) - count(DISTINCT (product_id, user_id)) FROM lt_reviews""")
def _(t):
    parts = [Q.check_rules(getattr(t, name), name, rules) for name, rules in Q.table_rules().items()]
    parts += [Q.check_unique(getattr(t, name), name, keys) for name, keys in Q.UNIQUE_RULES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_04_missing_references", """
SELECT 'event_product' AS ref, count(*) AS n FROM lt_raw_events WHERE product_id NOT IN (SELECT id FROM lt_products)
UNION ALL SELECT 'event_user', count(*) FROM lt_raw_events WHERE user_id NOT IN (SELECT id FROM lt_users)
UNION ALL SELECT 'line_order', count(*) FROM lt_lines WHERE order_id NOT IN (SELECT id FROM lt_orders)""")
def _(t):
    checks = {"event_product": (t.raw_events, "product_id", t.products), "event_user": (t.raw_events, "user_id", t.users),
              "line_order": (t.order_lines, "order_id", t.orders)}
    parts = [Q.missing_references(df, key, target).agg(F.count("*").alias("n")).select(F.lit(name).alias("ref"), "n")
             for name, (df, key, target) in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


VALIDATE_SQL = """
SELECT e.id, CASE WHEN e.event_type NOT IN ('product_view','search','click','add_to_cart','remove_from_cart','wishlist','purchase','review')
    THEN 'Unknown event_type ''' || e.event_type || '''.'
  WHEN e.product_id IS NOT NULL AND p.id IS NULL THEN 'Product ' || e.product_id || ' was not found.'
  WHEN e.user_id IS NOT NULL AND u.id IS NULL THEN 'User ' || e.user_id || ' was not found.'
  WHEN e.quantity < 1 THEN 'quantity must be at least 1.' ELSE 'accepted' END AS reason
FROM lt_raw_events e LEFT JOIN lt_products p ON p.id = e.product_id LEFT JOIN lt_users u ON u.id = e.user_id"""


@query("dq_05_event_validation", VALIDATE_SQL)
def _(t):
    v = Q.validate_events(t.raw_events, t.products, t.users)
    return v.select("id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query("dq_06_one_review_per_pair", """
SELECT id, product_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, user_id ORDER BY created_at, id) AS n
  FROM (SELECT id, id % 40 AS product_id, user_id % 7 AS user_id, created_at FROM lt_reviews)) WHERE n = 1""")
def _(t):
    folded = t.reviews.select("id", (F.col("id") % 40).alias("product_id"), (F.col("user_id") % 7).alias("user_id"), "created_at")
    return Q.first_review_per_pair(folded).select("id", "product_id", "user_id")


@query("dq_07_training_gate", """
SELECT 'products' AS dataset, count(*) AS rows, 10 AS minimum, TRUE AS ok FROM lt_products UNION ALL SELECT 'users', count(*), 5, TRUE FROM lt_users""")
def _(t):
    report = Q.minimum_rows({"products": t.products, "users": t.users})
    Q.training_gate(report)
    return report


# ---- sort, page, top-k -----------------------------------------------------
@query("srt_01_catalogue_sorts", """
SELECT 'relevance' AS sort, id, row_number() OVER (ORDER BY rating_count DESC, rating_avg DESC, id) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'price_asc', id, row_number() OVER (ORDER BY price, id) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'price_desc', id, row_number() OVER (ORDER BY price DESC, id) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'rating', id, row_number() OVER (ORDER BY rating_avg DESC, rating_count DESC, id) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'newest', id, row_number() OVER (ORDER BY launched_at DESC NULLS LAST, id DESC) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'discount', id, row_number() OVER (ORDER BY discount_pct DESC, id) AS position FROM lt_products QUALIFY position <= 50
UNION ALL SELECT 'popularity', id, row_number() OVER (ORDER BY rating_count DESC, id) AS position FROM lt_products QUALIFY position <= 50""")
def _(t):
    from pyspark.sql import Window as W
    out = None
    for sort in ("relevance", "price_asc", "price_desc", "rating", "newest", "discount", "popularity"):
        order = C.catalogue_order(sort)
        page = t.products.orderBy(*order).limit(50)
        ranked = page.select(F.lit(sort).alias("sort"), "id", F.row_number().over(W.partitionBy(F.lit(sort)).orderBy(*order)).alias("position"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


@query("lim_01_pagination", """
SELECT id, title, (SELECT count(*) FROM lt_products WHERE is_active) AS total,
  CAST(ceil((SELECT count(*) FROM lt_products WHERE is_active) / 24.0) AS BIGINT) AS total_pages,
  3 < ceil((SELECT count(*) FROM lt_products WHERE is_active) / 24.0) AS has_next, TRUE AS has_previous
FROM lt_products WHERE is_active ORDER BY price, id LIMIT 24 OFFSET 48""")
def _(t):
    return C.paginate(t.products.where("is_active").select("id", "title", "price"), C.catalogue_order("price_asc"), 3, 24).drop("price")


@query("topk_03_low_inventory", "SELECT id, inventory FROM lt_products WHERE is_active AND inventory <= 10 ORDER BY inventory, id LIMIT 20")
def _(t):
    return C.low_inventory(t.products).select("id", "inventory")


@query("topk_04_deals", """
SELECT id, discount_pct, rating_avg, discount_pct / 100.0 AS score, CAST(discount_pct AS INTEGER) || '% off right now' AS explanation
FROM lt_products WHERE is_active AND discount_pct > 0 AND inventory > 0 ORDER BY discount_pct DESC, rating_avg DESC, id LIMIT 10""")
def _(t):
    return C.deals(t.products).select("id", "discount_pct", "rating_avg", "score", "explanation")


@query("topk_06_fallbacks", """
SELECT 'popularity' AS kind, CAST(-1 AS BIGINT) AS seed, id, CAST(row_number() OVER (ORDER BY rating_count DESC, rating_avg DESC, id) AS INTEGER) AS rank
FROM lt_products WHERE is_active AND inventory > 0 QUALIFY rank <= 10
UNION ALL SELECT 'same_category', a.id, b.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.rating_avg DESC, b.id) AS INTEGER) AS rank
FROM lt_products a JOIN lt_products b ON a.category_id = b.category_id AND a.id <> b.id AND b.is_active QUALIFY rank <= 5""")
def _(t):
    from pyspark.sql import Window as W
    order = [F.col("rating_count").desc(), F.col("rating_avg").desc(), F.col("id")]
    pop = C.popularity_fallback(t.products, 10).select(
        F.lit("popularity").alias("kind"), F.lit(-1).cast("long").alias("seed"), "id",
        F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"))
    same = C.same_category_fallback(t.products, 5).select(
        F.lit("same_category").alias("kind"), F.col("id").alias("seed"), F.col("other_id").alias("id"), "rank")
    return pop.unionByName(same)


@query("topk_07_dimension_lists", """
(SELECT 'category' AS kind, CAST(id AS BIGINT) AS id, name FROM lt_categories ORDER BY name) UNION ALL
(SELECT 'brand', id, name FROM lt_brands ORDER BY name)""")
def _(t):
    c = t.categories.orderBy("name").select(F.lit("category").alias("kind"), F.col("id").cast("long").alias("id"), "name")
    return c.unionByName(t.brands.orderBy("name").select(F.lit("brand").alias("kind"), "id", "name"))
