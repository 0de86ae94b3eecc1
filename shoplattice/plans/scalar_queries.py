"""Scalar helpers exercised over whole tables, and the remaining set operation."""
from __future__ import annotations

from pyspark.sql import functions as F

from shoplattice.functions import scalars as X
from shoplattice.functions.grouped import grouped_percentiles
from shoplattice.operators import personal as P, sentiment as SE
from shoplattice.plans.customer_queries import AFF, RECENT, SLOTS_SQL
from shoplattice.plans.registry import query, sql_tokens


@query("scl_01_normalise_query", r"SELECT id, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS q FROM lt_search")
def _(t):
    return t.search_events.select("id", X.normalise_query("query").alias("q"))


@query("scl_02_tokenise", f"SELECT doc_id AS id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.corpus.select("id", F.size(X.tokens("text")).alias("n"), F.array_join(X.tokens("text"), " ").alias("tokens"))


@query("scl_03_string_helpers", """SELECT id, contains(lower(title), 'ring') AS has_ring, starts_with(title, 'blue') AS is_blue, title LIKE 'red%' AS is_red, title[1:5] AS head, length(title) AS n FROM lt_products""")
def _(t):
    return t.products.select("id", F.lower("title").contains("ring").alias("has_ring"), F.col("title").startswith("blue").alias("is_blue"),
                             F.col("title").like("red%").alias("is_red"), F.left("title", F.lit(5)).alias("head"), F.length("title").cast("long").alias("n"))


@query("scl_04_budget_extract", r"SELECT query_id, coalesce(CAST(nullif(regexp_extract(lower(query), 'under\s*\$?(\d+(\.\d+)?)', 1), '') AS DOUBLE), -1) AS budget FROM lt_pqueries")
def _(t):
    b = F.nullif(F.regexp_extract(F.lower("query"), r"under\s*\$?(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return t.product_queries.select("query_id", F.coalesce(b, F.lit(-1.0)).alias("budget"))


@query("scl_05_clause_split", r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(text), '[.!?;,]+|\bbut\b|\bhowever\b|\balthough\b|\bthough\b|\band yet\b'), lambda x: trim(x) <> '')) AS clauses FROM documents")
def _(t):
    return t.corpus.select("id", F.size(SE.clauses("text")).cast("long").alias("clauses"))


@query("scl_06_ngrams", f"""WITH w AS (SELECT id, {sql_tokens('description', False)} AS t FROM lt_products)
SELECT id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS bigrams,
  array_to_string(flatten(list_transform(t, lambda x: list_transform(range(1, length(x) + 1), lambda i: (' ' || x || ' ')[i : i + 2]))), '|') AS trigrams FROM w""")
def _(t):
    w = X.tokens("description", drop_stopwords=False)
    return t.products.select("id", F.array_join(X.word_ngrams(w, 2), "|").alias("bigrams"), F.array_join(X.char_wb_ngrams(w, 3, 3), "|").alias("trigrams"))


@query("scl_08_date_parts", """SELECT id, strftime(placed_at, '%Y-%m-%d') AS day, strftime(date_trunc('week', placed_at), '%Y-%m-%d') AS monday, CAST(week(placed_at) AS INTEGER) AS iso_week, CAST(month(placed_at) AS INTEGER) AS month,
  CAST(quarter(placed_at) AS INTEGER) AS quarter, round((epoch_us(o_now) - epoch_us(placed_at)) / 86400000000.0, 6) AS age FROM lt_orders, lt_asof""")
def _(t):
    return t.orders.select("id", X.day("placed_at").alias("day"), X.day(X.week_start("placed_at")).alias("monday"), F.weekofyear("placed_at").alias("iso_week"),
                           F.month("placed_at").alias("month"), F.quarter("placed_at").alias("quarter"), F.round(X.age_days(t.orders_as_of, "placed_at"), 6).alias("age"))


@query("scl_09_cyclic", "SELECT id, round(sin(2 * pi() * week(placed_at) / 52.0), 6) + 0.0::DOUBLE AS s, round(cos(2 * pi() * week(placed_at) / 52.0), 6) + 0.0::DOUBLE AS c FROM lt_orders")
def _(t):
    s, c = X.cyclic(F.weekofyear("placed_at"), 52)
    return t.orders.select("id", (F.round(s, 6) + 0.0).alias("s"), (F.round(c, 6) + 0.0).alias("c"))


@query("scl_10_math", "SELECT id, round(ln(1 + price), 6) AS l, round(sqrt(price), 6) AS r, round(power(0.5::DOUBLE, inventory / 45.0), 6) AS decay, least(greatest(rating_avg / 4.0, 0.4), 1.0) AS clipped FROM lt_products")
def _(t):
    return t.products.select("id", F.round(F.log1p("price"), 6).alias("l"), F.round(F.sqrt("price"), 6).alias("r"),
                             F.round(X.half_life(F.col("inventory"), 45.0), 6).alias("decay"), X.clip(F.col("rating_avg") / 4.0, 0.4, 1.0).alias("clipped"))


@query("scl_11_percentiles", "SELECT category_id, " + ", ".join(f"round(quantile_cont(price, 0.{p:02d}), 5) AS p{p:02d}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM lt_products GROUP BY 1")
def _(t):
    probs = {f"p{p:02d}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)}
    q = grouped_percentiles(t.products, ["category_id"], "price", probs)
    return q.select("category_id", *[F.round(n, 5).alias(n) for n in probs])


@query("scl_12_safe_divide", "SELECT id, round(CASE WHEN discount_pct = 0 THEN 0 ELSE price / discount_pct END, 5) AS ratio FROM lt_products")
def _(t):
    return t.products.select("id", X.ratio("price", "discount_pct", 5).alias("ratio"))


@query("scl_13_arrays", f"WITH w AS (SELECT id, {sql_tokens('description', False)} AS t FROM lt_products) SELECT id, CAST(len(t) AS INTEGER) AS n, array_to_string(t[-2:], ' ') AS last_two, list_contains(t, 'promo') AS promo, array_to_string(list_sort(list_distinct(t)), ' ') AS uniq FROM w")
def _(t):
    w = X.tokens("description", drop_stopwords=False)
    return t.products.select("id", F.size(w).alias("n"), F.array_join(F.slice(w, -2, 2), " ").alias("last_two"),
                             F.array_contains(w, "promo").alias("promo"), F.array_join(F.array_sort(F.array_distinct(w)), " ").alias("uniq"))


@query("scl_14_vectors", "SELECT id, round(sqrt(list_dot_product(vector, vector)), 5) AS norm, round(list_dot_product(vector, (SELECT vector FROM lt_vectors WHERE id = 0)), 5) AS dot0 FROM lt_vectors")
def _(t):
    first = t.vectors.where("id = 0").select("vector").scalar()
    with_first = t.vectors.withColumn("first", first)
    return with_first.select("id", F.round(X.l2_norm("vector"), 5).alias("norm"), F.round(X.dot("vector", "first"), 5).alias("dot0"))


@query("scl_15_top_map_entries", f"WITH {RECENT}{AFF.format(d='brand')} SELECT user_id, string_agg(CAST(brand_id AS VARCHAR), ',' ORDER BY affinity DESC, brand_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, brand_id) AS r FROM brand_aff) WHERE r <= 10 GROUP BY 1")
def _(t):
    from shoplattice.functions.grouped import top_k
    a = P.affinity(P.last_events(t.events, t.products), "brand_id", t.events_as_of)
    best = top_k(a, ["user_id"], [F.col("affinity").desc(), F.col("brand_id")], 10)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "brand_id"))), lambda s: s["brand_id"].cast("string"))
    return best.groupBy("user_id").agg(F.array_join(packed, ",").alias("top"))


@query("scl_16_json_members", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 7.0::DOUBLE AS absent FROM events")
def _(t):
    from shoplattice.sources.readers import json_number
    return t.raw("events").select(F.col("event_id").alias("id"), json_number("props", "k", -1).alias("k"), json_number("props", "absent", 7).alias("absent"))


@query("scl_17_conditionals", "SELECT id, CASE WHEN rating >= 4 THEN 'positive' WHEN rating = 3 THEN 'neutral' ELSE 'negative' END AS label, CAST(rating >= 4 AS INTEGER) AS flag FROM lt_reviews")
def _(t):
    return t.reviews.select("id", SE.rating_label().alias("label"), (F.col("rating") >= 4).cast("int").alias("flag"))


@query("scl_18_hash_slots", SLOTS_SQL)
def _(t):
    recent = P.last_events(t.events, t.products)
    v = P.preference_vector(P.affinity(recent, "category_id", t.events_as_of), P.affinity(recent, "brand_id", t.events_as_of))
    return v.select("user_id", F.posexplode("preference").alias("slot", "preference")).where("preference <> 0")


@query("scl_19_formats", "SELECT id, CAST(discount_pct AS INTEGER) || '% off' AS pct, 'At Risk' AS label FROM lt_products")
def _(t):
    return t.products.select("id", F.concat(F.format_string("%.0f", "discount_pct"), F.lit("% off")).alias("pct"), X.title_label(F.lit("at_risk")).alias("label"))


@query("set_05_distinct", "SELECT DISTINCT user_id, product_id FROM lt_events")
def _(t):
    return t.events.select("user_id", "product_id").dropDuplicates()
