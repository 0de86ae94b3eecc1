"""Registered queries: a Spark plan and, where SQL can say it, the same result in ANSI SQL."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoplattice.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Tables(spark, sf_dir))
    return run


_FITTED: dict[tuple[str, int, str], object] = {}


def fitted_once(t: Tables, name: str, build: Callable[[Tables], object]) -> object:
    """Train a model once per session and state of the dataset's files and let every query score with it."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(t.path).select("path", "modificationTime", "length")
    state = files.agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()[0]
    key = (t.spark.sparkContext.applicationId, state, name)
    if key not in _FITTED:
        _FITTED[key] = build(t)
    return _FITTED[key]


def with_logical_tables(sql: str) -> str:
    """Prefix the logical-table CTEs a query refers to, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in LOGICAL_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(LOGICAL_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({LOGICAL_SQL[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


STOP = ("'a','an','and','are','as','at','be','by','for','from','has','have','in','is','it','its','of','on','or',"
        "'that','the','to','with','your','you','this','these','those'")


def sql_tokens(expr: str, drop: bool = True) -> str:
    found = f"regexp_extract_all(lower({expr}), '[a-z0-9]+')"
    return f"list_filter({found}, lambda x: x NOT IN ({STOP}))" if drop else found


LOGICAL_SQL: dict[str, str] = {
    "lt_products": r"""
        SELECT *, CAST(round(CAST(CAST(price * (1 - discount_pct / 100.0) AS VARCHAR) AS DECIMAL(38, 14)), 2) AS DOUBLE) AS effective_price FROM (
        SELECT p_partkey AS id, 'SKU-' || p_partkey AS sku, p_name AS title,
          p_name || ' ' || lower(p_type) || ' size ' || p_size AS description,
          CAST(coalesce(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type), 0) AS INTEGER) AS category_id,
          lower(p_type) AS category_slug, p_type[1] || lower(p_type[2:]) AS category_name,
          CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS brand_id, p_brand AS brand_name,
          CAST(regexp_extract(p_brand, '(\d+)', 1) AS DOUBLE) / 25.0 AS brand_reputation,
          p_retailprice AS price, CAST(0.55 AS DOUBLE) * p_retailprice AS base_cost,
          CAST((p_partkey % 7) * 5 AS DOUBLE) AS discount_pct,
          round(1.0 + CAST(p_partkey * 7 % 41 AS DOUBLE) / 10.0, 1) AS rating_avg,
          (p_partkey * 13) % 200 AS rating_count, (p_partkey * 37) % 120 AS inventory,
          p_partkey % 50 <> 0 AS is_active, [lower(p_type), split_part(p_name, ' ', 1)] AS tags,
          p_size AS size_, p_partkey % 25 = 3 AS bad_json,
          TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 AS INTEGER)) AS launched_at
        FROM part)""",
    "lt_categories": """SELECT DISTINCT category_id AS id, category_slug AS slug, category_name AS name FROM lt_products""",
    "lt_brands": """SELECT DISTINCT brand_id AS id, brand_name AS name, brand_reputation AS reputation_score FROM lt_products""",
    "lt_users": """
        SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, c_name AS full_name,
          CASE WHEN c_custkey % 97 = 0 THEN 'admin' ELSE 'customer' END AS role,
          c_custkey % 20 <> 0 AS is_active, n_name AS country, lower(c_mktsegment) AS signup_source,
          CAST(c_custkey % 11 AS DOUBLE) / 10.0 AS price_sensitivity
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "lt_orders": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
          CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'paid' ELSE 'pending' END AS status,
          o_totalprice AS total_amount, o_totalprice * (o_orderkey % 10) / 100.0 AS discount_amount,
          lower(substr(o_orderpriority, 3, 20)) AS channel, o_orderdate AS placed_at FROM orders""",
    "lt_lines": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
          l_extendedprice / l_quantity AS unit_price, l_discount * 100.0 AS discount_pct,
          l_extendedprice * (1 - l_discount) AS line_total FROM lineitem""",
    "lt_items": """
        SELECT l.*, o.user_id, o.status, o.placed_at FROM lt_lines l JOIN lt_orders o ON o.id = l.order_id""",
    "lt_asof": "SELECT (SELECT max(o_orderdate) FROM orders) AS o_now, (SELECT max(ts) FROM events) AS e_now",
    "lt_events": """
        SELECT event_id AS id, user_id,
          CASE WHEN event_type = 'view' THEN 'product_view'
               WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'wishlist'
               WHEN event_type = 'signup' THEN 'add_to_cart'
               WHEN event_type = 'error' THEN 'remove_from_cart' ELSE event_type END AS event_type,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, 1 AS quantity, value,
          CASE WHEN event_id % 3 = 0 THEN 'mobile' ELSE 'web' END AS source, ts AS occurred_at FROM events""",
    "lt_raw_events": """
        SELECT event_id AS id, user_id, CASE WHEN event_type = 'view' THEN 'product_view' ELSE event_type END AS event_type,
          CAST(json_extract_string(props, '$.k') AS BIGINT) + CASE WHEN event_id % 250 = 1 THEN 10000000 ELSE 0 END AS product_id,
          CASE WHEN event_id % 100 = 2 THEN 0 ELSE 1 END AS quantity, value, ts AS occurred_at FROM events""",
    "lt_sessions": """
        SELECT *, user_id || '-' || CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY occurred_at, id
                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
        FROM (SELECT *, CASE WHEN prev IS NULL OR epoch_us(occurred_at) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END AS starts
              FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS prev FROM lt_events))""",
    "lt_impressions": """
        SELECT id AS impression_id, user_id, product_id, 'homepage' AS surface,
          CASE id % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'cold_start' ELSE 'trending_events' END AS strategy,
          'v1' AS model_version, occurred_at AS served_at FROM lt_events WHERE event_type = 'product_view'""",
    "lt_preds": """
        SELECT event_id AS id,
          CASE user_id % 5 WHEN 0 THEN 'forecasting' WHEN 1 THEN 'price_prediction' WHEN 2 THEN 'recommendation'
               WHEN 3 THEN 'segmentation' ELSE 'sentiment' END AS model_name,
          CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version, user_id AS entity_id, value AS prediction,
          value * 0.1::DOUBLE + (event_id % 7) AS latency_ms, event_type <> 'error' AS succeeded, ts AS predicted_at FROM events""",
    "lt_reviews": """
        SELECT *, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
          CASE WHEN rating >= 4 THEN 0.5::DOUBLE WHEN rating = 3 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END + (id % 10) / 100.0 AS sentiment_score
        FROM (SELECT d.doc_id AS id, d.doc_id % (SELECT count(*) FROM part) AS product_id,
          d.doc_id % (SELECT count(*) FROM customer) AS user_id,
          CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 5 ELSE 3 END AS rating, source AS title, text AS body,
          d.doc_id % 2 = 0 AS verified_purchase, d.doc_id % 17 AS helpful_votes,
          TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 700 AS INTEGER)) AS created_at
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""",
    "lt_search": r"""
        SELECT k AS id, conv_id % (SELECT count(*) FROM customer) AS user_id, text AS query,
          trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normalized_query,
          CASE WHEN k % 6 = 0 THEN 0 ELSE k % 40 END AS result_count,
          CASE WHEN k % 3 = 0 THEN k % 100 END AS clicked_product_id, k % 12 = 0 AS converted,
          CAST(k % 50 AS DOUBLE) / 10.0 AS latency_ms, TIMESTAMP '2024-01-01' + to_minutes(CAST(k % 40000 AS INTEGER)) AS occurred_at
        FROM (SELECT *, conv_id * 100 + turn AS k FROM conversations WHERE role = 'user')""",
    "lt_vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS category_id FROM embeddings",
    "lt_pqueries": """
        SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'best ' || title WHEN 1 THEN title || ' under $800'
          WHEN 2 THEN 'Cheap  ' || title WHEN 3 THEN title || ' in stock' ELSE title || ' promo' END AS query
        FROM (SELECT title, min(id) AS query_id FROM lt_products GROUP BY title)""",
    "lt_demand": """
        SELECT product_id, CAST(placed_at AS DATE) AS day, sum(quantity) AS units,
          sum(quantity * unit_price * (1 - discount_pct / 100.0)) AS revenue, avg(unit_price) AS avg_price
        FROM lt_items WHERE status IN ('paid','shipped','delivered') GROUP BY ALL""",
}
