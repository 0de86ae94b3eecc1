"""Profiles, feature store, sessions and segmentation."""
from __future__ import annotations

from pyspark.sql import functions as F

from shoplattice.constants import SEGMENT_FEATURES, SEGMENT_REST, SEGMENT_RULES
from shoplattice.functions.scalars import micros
from shoplattice.operators import features as FE, personal as P, segments as SG
from shoplattice.plans.registry import fitted_once, query
from shoplattice.session import materialise

W_SQL = "CASE event_type WHEN 'product_view' THEN 1 WHEN 'click' THEN 1.5 WHEN 'wishlist' THEN 3 WHEN 'add_to_cart' THEN 4 WHEN 'remove_from_cart' THEN -1 WHEN 'purchase' THEN 6 ELSE 0 END"
RECENT = """rec AS (SELECT r.*, category_id, brand_id, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS rn
  FROM lt_events) r JOIN lt_products p ON p.id = r.product_id WHERE rn <= 600)"""
AFF = """, {d}_s AS (SELECT user_id, {d}_id, sum(%s * power(0.5::DOUBLE, greatest((epoch_us(e_now) - epoch_us(occurred_at)) / 86400000000.0, 0) / 45.0)) AS s
  FROM rec, lt_asof GROUP BY 1, 2),
{d}_aff AS (SELECT user_id, {d}_id, round(s / m, 6) AS affinity FROM (SELECT *, max(s) OVER (PARTITION BY user_id) AS m FROM {d}_s) WHERE m > 0)""" % W_SQL


def _recent(t):
    return P.last_events(t.events, t.products)


@query("pf_01_affinity", f"WITH {RECENT}{AFF.format(d='category')}{AFF.format(d='brand')}" """
SELECT user_id, 'category' AS dimension, CAST(category_id AS BIGINT) AS id, affinity FROM category_aff UNION ALL SELECT user_id, 'brand', brand_id, affinity FROM brand_aff""")
def _(t):
    recent = _recent(t)
    out = None
    for d in ("category", "brand"):
        a = P.affinity(recent, f"{d}_id", t.events_as_of).select(
            "user_id", F.lit(d).alias("dimension"), F.col(f"{d}_id").cast("long").alias("id"), "affinity")
        out = a if out is None else out.unionByName(a)
    return out


@query("pf_02_price_band", f"WITH {RECENT} SELECT user_id, round(quantile_cont(price, 0.1), 4) AS price_p10, round(quantile_cont(price, 0.9), 4) AS price_p90 FROM rec WHERE {W_SQL} > 0 GROUP BY 1")
def _(t):
    b = P.price_band(_recent(t))
    return b.select("user_id", F.round("price_p10", 4).alias("price_p10"), F.round("price_p90", 4).alias("price_p90"))


LISTS_SQL = """
WITH v AS (SELECT user_id, product_id, max((occurred_at, id)) AS ats FROM lt_events WHERE event_type IN ('product_view','click') GROUP BY 1, 2),
w AS (SELECT user_id, product_id, max((occurred_at, id)) AS ats FROM lt_events WHERE event_type = 'wishlist' GROUP BY 1, 2),
c AS (SELECT user_id, product_id, max((occurred_at, id)) AS ats FROM lt_events WHERE event_type IN ('add_to_cart','remove_from_cart') GROUP BY 1, 2
  HAVING arg_max(event_type, (occurred_at, id)) = 'add_to_cart')
SELECT * FROM (SELECT 'viewed' AS list, user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ats DESC) AS INTEGER) AS position FROM v
UNION ALL SELECT 'wishlist', user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ats DESC) AS INTEGER) FROM w
UNION ALL SELECT 'cart', user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ats DESC) AS INTEGER) FROM c) WHERE position <= 30"""


@query("pf_03_recent_lists", LISTS_SQL)
def _(t):
    cols = ["list", "user_id", "product_id", "position"]
    v = P.recently_viewed(t.events).withColumn("list", F.lit("viewed")).select(cols)
    w = P.wishlist(t.events).withColumn("list", F.lit("wishlist")).select(cols)
    return v.unionByName(w).unionByName(P.cart_state(t.events).withColumn("list", F.lit("cart")).select(cols))


@query("win_10_first_occurrence_lists", LISTS_SQL.replace("WHERE position <= 30", "WHERE position <= 30 AND list = 'viewed'"))
def _(t):
    return P.recently_viewed(t.events).withColumn("list", F.lit("viewed"))


@query("pf_04_profiles", SG.SEGMENT_SQL + f""", {RECENT},
it AS (SELECT user_id, count(*) AS n FROM rec WHERE {W_SQL} <> 0 GROUP BY 1),
st AS (SELECT user_id, count(DISTINCT session_id) AS n, max(occurred_at) AS last_at FROM lt_sessions GROUP BY 1),
tr AS (SELECT user_id, count(*) AS n, arg_min(normalized_query, rn) AS q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS rn
  FROM lt_search WHERE normalized_query <> '') WHERE rn <= 20 GROUP BY 1),
sg AS (SELECT user_id, arg_max(segment_label, created_at) AS segment FROM seg GROUP BY 1)
SELECT u.id AS user_id, price_sensitivity, coalesce(it.n, 0) AS interaction_count, coalesce(po.n, 0) AS order_count, round(coalesce(amt, 0), 2) AS total_spend,
  round(coalesce(aov, 0), 6) AS avg_order_value, coalesce(st.n, 0) AS session_count, coalesce(epoch_us(st.last_at), -1) AS last_active_us,
  coalesce(rv.n, 0) AS review_count, coalesce(tr.n, 0) AS search_count, q AS last_search, segment, coalesce(it.n, 0) < 3 AS is_cold_start
FROM lt_users u LEFT JOIN it ON it.user_id = u.id LEFT JOIN po ON po.user_id = u.id LEFT JOIN st ON st.user_id = u.id LEFT JOIN rv ON rv.user_id = u.id
  LEFT JOIN tr ON tr.user_id = u.id LEFT JOIN sg ON sg.user_id = u.id""")
def _(t):
    p = P.profiles(t.users, _recent(t), t.orders, t.session_events, t.reviews, t.search_events, SG.rule_segments(t))
    return p.withColumn("last_active_us", F.coalesce(micros("last_active_at"), F.lit(-1))).drop("last_active_at")


@query("pf_05_anonymous_profiles", f"""
WITH rec AS (SELECT s.*, category_id, brand_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, id DESC) AS rn FROM lt_sessions) s
  JOIN lt_products p ON p.id = s.product_id WHERE rn <= 200),
sc AS (SELECT session_id, category_id, sum({W_SQL} * power(0.5::DOUBLE, greatest((epoch_us(e_now) - epoch_us(occurred_at)) / 86400000000.0, 0) / 45.0)) AS s FROM rec, lt_asof GROUP BY 1, 2)
SELECT session_id, category_id, round(s / m, 6) AS affinity FROM (SELECT *, max(s) OVER (PARTITION BY session_id) AS m FROM sc) WHERE m > 0""")
def _(t):
    return P.affinity(P.last_events(t.session_events, t.products, "session_id", 200), "category_id", t.events_as_of, "session_id")


def behaviour_sql(events: str, key: str, n: int) -> str:
    """The behaviour columns of a key as strings, affinities in millionths: the SQL side of ``flat``."""
    at = f"PARTITION BY {key} ORDER BY"
    listed = lambda name, types, keep, n: (
        f"{name}_l AS (SELECT {key}, string_agg(product_id, ',' ORDER BY ats DESC) AS {name} FROM (SELECT * FROM (SELECT {key}, product_id, max((occurred_at, id)) AS ats, arg_max(event_type, (occurred_at, id)) AS newest "
        f"FROM rec WHERE event_type IN ({types}) GROUP BY 1, 2) WHERE {keep} QUALIFY row_number() OVER ({at} ats DESC) <= {n}) GROUP BY 1)")
    aff = lambda d: (
        f"{d}_s AS (SELECT {key}, {d}_id, sum({W_SQL} * power(0.5::DOUBLE, greatest((epoch_us(e_now) - epoch_us(occurred_at)) / 86400000000.0, 0) / 45.0)) AS s FROM rec, lt_asof GROUP BY 1, 2), "
        f"{d}_aff AS (SELECT {key}, {d}_id, round(s / m, 6) AS affinity FROM (SELECT *, max(s) OVER (PARTITION BY {key}) AS m FROM {d}_s) WHERE m > 0), "
        f"{d}_l AS (SELECT {key}, string_agg({d}_id || '=' || CAST(round(affinity * 1000000) AS BIGINT), ',' ORDER BY affinity DESC, {d}_id) AS {d}_affinity "
        f"FROM (SELECT * FROM {d}_aff QUALIFY row_number() OVER ({at} affinity DESC, {d}_id) <= 10) GROUP BY 1)")
    return f"""rec AS (SELECT r.*, category_id, brand_id, price FROM (SELECT *, row_number() OVER ({at} occurred_at DESC, id DESC) AS rn FROM {events}) r JOIN lt_products p ON p.id = r.product_id WHERE rn <= {n}),
{aff('category')}, {aff('brand')}, {listed('recently_viewed', "'product_view','click'", 'true', 20)}, {listed('wishlist', "'wishlist'", 'true', 30)},
{listed('cart', "'add_to_cart','remove_from_cart'", "newest = 'add_to_cart'", 30)},
band AS (SELECT {key}, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.9) AS hi FROM rec WHERE {W_SQL} > 0 GROUP BY 1),
slots AS (SELECT {key}, slot, sum(w) AS w FROM (SELECT {key}, category_id % 16 AS slot, affinity AS w FROM category_aff UNION ALL SELECT {key}, (brand_id * 7) % 16, affinity * 0.5::DOUBLE FROM brand_aff) GROUP BY 1, 2),
vec AS (SELECT {key}, count(*) FILTER (WHERE round(w / l, 5) <> 0) AS n_slots FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS l FROM slots) GROUP BY 1),
bh AS (SELECT {key}, n AS interaction_count, coalesce(category_affinity, '') AS category_affinity, coalesce(brand_affinity, '') AS brand_affinity, round(lo, 4) AS price_p10, round(hi, 4) AS price_p90,
  coalesce(recently_viewed, '') AS recently_viewed, coalesce(cart, '') AS cart, coalesce(wishlist, '') AS wishlist, coalesce(n_slots, 0) AS n_slots
  FROM (SELECT {key}, count(*) AS n FROM rec WHERE {W_SQL} <> 0 GROUP BY 1) LEFT JOIN category_l USING ({key}) LEFT JOIN brand_l USING ({key}) LEFT JOIN band USING ({key})
  LEFT JOIN recently_viewed_l USING ({key}) LEFT JOIN cart_l USING ({key}) LEFT JOIN wishlist_l USING ({key}) LEFT JOIN vec USING ({key}))"""


def flat(rows):
    """Behaviour columns as strings and plain numbers."""
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["id"].cast("string"), F.lit("="), F.round(p["affinity"] * 1000000).cast("bigint").cast("string"))), ",")
    return rows.withColumns({
        **{c: pairs(F.col(c)) for c in ("category_affinity", "brand_affinity")}, **{c: F.array_join(c, ",") for c in ("recently_viewed", "cart", "wishlist")},
        **{c: F.round(c, 4) for c in ("price_p10", "price_p90")}, "n_slots": F.size(F.filter("preference", lambda x: x != 0)).cast("bigint")}).drop("preference")


@query("pf_04_whole_profiles", SG.SEGMENT_SQL + f""", {behaviour_sql('lt_events', 'user_id', 600)},
pu AS (SELECT user_id, string_agg(product_id, ',' ORDER BY placed_at DESC, order_id DESC, product_id) AS purchased FROM (SELECT * FROM lt_items QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, order_id DESC, product_id) <= 20) GROUP BY 1),
se AS (SELECT user_id, array_to_string(list(normalized_query ORDER BY rn)[1:10], '|') AS search_terms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS rn FROM lt_search) WHERE rn <= 20 AND normalized_query <> '' GROUP BY 1),
sg AS (SELECT user_id, arg_max(segment_label, created_at) AS segment FROM seg GROUP BY 1)
SELECT u.id AS user_id, coalesce(interaction_count, 0) AS interaction_count, coalesce(category_affinity, '') AS category_affinity, coalesce(brand_affinity, '') AS brand_affinity, price_p10, price_p90, coalesce(recently_viewed, '') AS recently_viewed,
  coalesce(cart, '') AS cart, coalesce(wishlist, '') AS wishlist, coalesce(n_slots, 0) AS n_slots, coalesce(purchased, '') AS purchased, coalesce(search_terms, '') AS search_terms, coalesce(po.n, 0) AS order_count, round(coalesce(amt, 0), 2) AS total_spend, segment
FROM lt_users u LEFT JOIN bh ON bh.user_id = u.id LEFT JOIN pu ON pu.user_id = u.id LEFT JOIN se ON se.user_id = u.id LEFT JOIN po ON po.user_id = u.id LEFT JOIN sg ON sg.user_id = u.id""")
def _(t):
    recent = materialise(_recent(t), "recent-events")
    facts = P.profiles(t.users, recent, t.orders, t.session_events, t.reviews, t.search_events, SG.rule_segments(t))
    rows = flat(P.whole_profiles(facts, P.behaviour(recent, t.events_as_of), t.order_items, t.search_events))
    return rows.withColumns({"purchased": F.array_join("purchased", ","), "search_terms": F.array_join("search_terms", "|")}).select(
        "user_id", "interaction_count", "category_affinity", "brand_affinity", "price_p10", "price_p90", "recently_viewed", "cart", "wishlist", "n_slots", "purchased",
        "search_terms", "order_count", "total_spend", "segment")


@query("pf_05_whole_anonymous_profiles", f"WITH {behaviour_sql('lt_sessions', 'session_id', 200)} SELECT * FROM bh")
def _(t):
    recent = materialise(P.last_events(t.session_events, t.products, "session_id", 200), "recent-session-events")
    return flat(P.behaviour(recent, t.events_as_of, "session_id"))


def _affinities(t):
    recent = _recent(t)
    return P.affinity(recent, "category_id", t.events_as_of), P.affinity(recent, "brand_id", t.events_as_of)


SLOTS_SQL = f"""WITH {RECENT}{AFF.format(d='category')}{AFF.format(d='brand')},
sl AS (SELECT user_id, slot, sum(w) AS w FROM (SELECT user_id, category_id % 16 AS slot, affinity AS w FROM category_aff
  UNION ALL SELECT user_id, (brand_id * 7) % 16, affinity * 0.5::DOUBLE FROM brand_aff) GROUP BY 1, 2)
SELECT user_id, slot, preference FROM (SELECT user_id, CAST(slot AS INTEGER) AS slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 5) AS preference FROM sl) WHERE preference <> 0"""


@query("pf_06_preference_vector", SLOTS_SQL)
def _(t):
    v = P.preference_vector(*_affinities(t)).select("user_id", F.posexplode("preference").alias("slot", "preference"))
    return v.where("preference <> 0")


FS1 = """
WITH po AS (SELECT user_id, count(*) AS n, avg(total_amount) AS aov, sum(total_amount) AS amt, max(placed_at) AS last_at, sum(discount_amount) AS disc
  FROM lt_orders WHERE status IN ('paid','shipped','delivered') GROUP BY 1),
w AS (SELECT po.*, date_diff('day', last_at, o_now) AS rec, coalesce(s.n, 0) AS ses, coalesce(d.n, 0) AS dis, coalesce(r.n, 0) AS rev FROM lt_asof, po
  LEFT JOIN (SELECT user_id, count(DISTINCT session_id) AS n FROM lt_sessions GROUP BY 1) s ON s.user_id = po.user_id
  LEFT JOIN (SELECT user_id, count(DISTINCT product_id) AS n FROM lt_items GROUP BY 1) d ON d.user_id = po.user_id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM lt_reviews GROUP BY 1) r ON r.user_id = po.user_id)
SELECT user_id, unnest(['user_purchase_frequency','user_average_order_value','user_total_spend','user_recency_days','user_session_count','user_distinct_products','user_discount_affinity','user_review_count']) AS feature_name,
  round(unnest([CAST(n AS DOUBLE), aov, amt, rec, ses, dis, disc / amt, rev]), 8) AS feature_value, 'v1' AS feature_version FROM w"""


@query("fs_01_user_features", FS1)
def _(t):
    f = FE.user_features(t.orders, t.order_items, t.session_events, t.reviews, t.orders_as_of, "v1")
    return f.withColumn("feature_value", F.round("feature_value", 8)).drop("computed_at")


FS2_WIDE = """
WITH v AS (SELECT product_id, count(*) FILTER (WHERE event_type IN ('product_view','click')) AS views, count(*) FILTER (WHERE event_type = 'purchase') AS buys,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts FROM lt_events GROUP BY 1),
d AS (SELECT product_id, sum(quantity) AS q FROM lt_items, lt_asof WHERE status IN ('paid','shipped','delivered') AND placed_at >= o_now - INTERVAL 30 DAY GROUP BY 1),
w AS (SELECT p.id AS product_id, ln(1 + rating_count) AS product_popularity, CASE WHEN views >= 3 THEN buys / views ELSE 0 END AS product_conversion_rate,
  rating_avg AS product_rating, coalesce(q, 0) AS product_demand_30d, discount_pct AS product_price_trend, CAST(coalesce(views, 0) AS DOUBLE) AS product_view_count,
  CASE WHEN views >= 3 THEN carts / views ELSE 0 END AS product_cart_rate, 0.0::DOUBLE AS product_return_rate
  FROM lt_products p LEFT JOIN v ON v.product_id = p.id LEFT JOIN d ON d.product_id = p.id)"""


@query("fs_02_product_features", FS2_WIDE + """
SELECT product_id, unnest(['product_popularity','product_conversion_rate','product_rating','product_demand_30d','product_price_trend','product_view_count','product_cart_rate','product_return_rate']) AS feature_name,
  round(unnest([product_popularity, product_conversion_rate, product_rating, product_demand_30d, product_price_trend, product_view_count, product_cart_rate, product_return_rate]), 4) AS feature_value, 'v1' AS feature_version FROM w""")
def _(t):
    f = FE.product_features(t.events, t.order_items, t.products, t.orders_as_of, "v1")
    return f.withColumn("feature_value", F.round("feature_value", 4)).drop("computed_at")


@query("fs_03_feature_vectors", FS2_WIDE + " SELECT product_id, " + ", ".join(f"round({n}, 4) AS {n}" for n in FE.PRODUCT_FEATURES) + " FROM w")
def _(t):
    f = FE.product_features(t.events, t.order_items, t.products, t.orders_as_of, "v1")
    wide = FE.read_vectors(f, "product_id", FE.PRODUCT_FEATURES, "v1")
    return wide.select("product_id", *[F.round(n, 4).alias(n) for n in FE.PRODUCT_FEATURES])


# ---- segmentation ----------------------------------------------------------
def _frame(t):
    return SG.rfm_frame(t.users_with_signup, t.orders, t.order_items, t.session_events, t.reviews, t.orders_as_of)


ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in SEGMENT_FEATURES)


@query("sg_01_rfm_frame", SG.RFM_SQL + f" SELECT user_id, {ROUNDED} FROM rfm")
def _(t):
    return _frame(t).select("user_id", *[F.round(f, 6).alias(f) for f in SEGMENT_FEATURES])


@query("jn_04_feature_frame_join", SG.RFM_SQL + " SELECT user_id, round(frequency, 6) AS frequency, round(product_diversity, 6) AS product_diversity, round(session_frequency, 6) AS session_frequency FROM rfm")
def _(t):
    return _frame(t).select("user_id", *[F.round(f, 6).alias(f) for f in ("frequency", "product_diversity", "session_frequency")])


Z = ", ".join(f"(({f}) - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1)" for f in SEGMENT_FEATURES)
Z_SQL = SG.RFM_SQL + f", zz AS MATERIALIZED (SELECT user_id, CAST(user_id % 5 AS INTEGER) AS cluster_id, [{Z}] AS z FROM rfm)"


@query("sg_02_standardised", Z_SQL + """ SELECT user_id, CAST(i - 1 AS INTEGER) AS i, round(z[i], 5) AS z FROM zz, range(1, 10) t(i)""")
def _(t):
    f = _frame(t)
    return SG.standardise(f, SG.scaling(f)).select("user_id", F.posexplode("z").alias("i", "z")).withColumn("z", F.round("z", 5))


def _labelled(t):
    f = _frame(t)
    return SG.standardise(f, SG.scaling(f)).withColumn("cluster_id", (F.col("user_id") % 5).cast("int"))


CENTS = """, ct AS MATERIALIZED (SELECT cluster_id AS cl, list(v ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(z[i]) AS v FROM zz, range(1, 10) t(i) GROUP BY 1, 2) GROUP BY 1)"""


@query("sg_07_assignment", Z_SQL + CENTS + """,
d AS (SELECT user_id, cl, list_distance(z, c) AS d, row_number() OVER (PARTITION BY user_id ORDER BY list_distance(z, c), cl) AS rn FROM zz, ct)
SELECT a.user_id, a.cl AS cluster_id, round(least(greatest(1 - a.d / greatest(b.d, 0.000001), 0), 1), 5) AS confidence FROM d a JOIN d b ON a.user_id = b.user_id AND a.rn = 1 AND b.rn = 2""")
def _(t):
    lab = _labelled(t)
    out = SG.assign(lab.drop("cluster_id"), SG.centroids_of(lab))
    return out.select("user_id", "cluster_id", F.round("confidence", 5).alias("confidence"))


@query("sg_08_rfm_score", SG.SEGMENT_SQL + "SELECT user_id, round(rfm_score, 6) AS rfm_score FROM sc")
def _(t):
    return SG.rfm_score(_frame(t)).select("user_id", F.round("rfm_score", 6).alias("rfm_score"))


@query("sg_09_cluster_quality", Z_SQL + CENTS + """,
g AS (SELECT list(v ORDER BY i) AS g FROM (SELECT i, avg(z[i]) AS v FROM zz, range(1, 10) t(i) GROUP BY 1)),
p AS (SELECT cl, any_value(c) AS c, count(*) AS n, avg(list_distance(z, c)) AS s, sum(list_distance(z, c) * list_distance(z, c)) AS sse FROM zz JOIN ct ON cl = cluster_id GROUP BY cl),
db AS (SELECT avg(w) AS db FROM (SELECT a.cl, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM p a JOIN p b ON a.cl <> b.cl GROUP BY 1))
SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS customers, round(any_value(db), 4) AS davies_bouldin,
  round((sum(n * list_distance(c, g) * list_distance(c, g)) / (count(*) - 1)) / (sum(sse) / (sum(n) - count(*))), 4) AS calinski_harabasz,
  round(max(n) / sum(n), 5) AS largest_share FROM p, g, db""")
def _(t):
    lab = _labelled(t)
    q = SG.cluster_quality(lab, SG.centroids_of(lab))
    return q.select("n_clusters", "customers", F.round("davies_bouldin", 4).alias("davies_bouldin"),
                    F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("largest_share", 5).alias("largest_share"))


@query("jn_09_latest_segment", SG.SEGMENT_SQL + "SELECT user_id, arg_max(segment_label, created_at) AS segment_label, arg_max(model_version, created_at) AS model_version FROM seg GROUP BY 1")
def _(t):
    return SG.latest_segment(SG.rule_segments(t)).select("user_id", "segment_label", "model_version")


@query("sg_10_segment_members", SG.SEGMENT_SQL + """SELECT s.user_id, segment_label, email, full_name, round(rfm_score, 6) AS rfm_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY segment_label
  ORDER BY round(rfm_score, 6) DESC, user_id) AS INTEGER) AS rank FROM seg WHERE model_version = 'v2') s JOIN lt_users u ON u.id = s.user_id WHERE rank <= 50""")
def _(t):
    m = SG.members(SG.rule_segments(t), t.users, "v2")
    return m.select("user_id", "segment_label", "email", "full_name", F.round("rfm_score", 6).alias("rfm_score"), "rank")


def _fit(t):
    f = materialise(_frame(t), "rfm-frame")
    z = SG.standardise(f, SG.scaling(f))
    return f, z, fitted_once(t, "segments", lambda t: SG.fit_kmeans(z))


@query("sg_03_kmeans_segments")
def _(t):
    _, z, fit = _fit(t)
    return SG.assign(z, fit["centroids"]).groupBy("cluster_id").agg(
        F.count("*").alias("customers"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


@query("sg_04_silhouette", Z_SQL + CENTS + """,
d AS (SELECT user_id, min(CASE WHEN cl = cluster_id THEN list_distance(z, c) END) AS own, min(CASE WHEN cl <> cluster_id THEN list_distance(z, c) END) AS other FROM zz, ct GROUP BY 1)
SELECT count(*) AS customers, round(avg((other - own) / greatest(own, other)), 5) AS silhouette FROM d""")
def _(t):
    z = _labelled(t)
    return z.agg(F.count("*").alias("customers")).withColumn("silhouette", F.lit(round(SG.silhouette(z), 5)))


@query("sg_04_pairwise_silhouette", Z_SQL.replace("zz AS MATERIALIZED", "z0 AS") + """, zz AS MATERIALIZED (SELECT * FROM z0 ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 2000),
ds AS (SELECT a.user_id, a.cluster_id AS mine, b.cluster_id AS cl, sum(list_distance(a.z, b.z)) AS d, count(*) AS n FROM zz a, zz b GROUP BY ALL),
ab AS (SELECT user_id, min(CASE WHEN cl = mine THEN d / greatest(n - 1, 1) END) AS own, min(CASE WHEN cl <> mine THEN d / n END) AS other, min(CASE WHEN cl = mine THEN n END) AS n FROM ds GROUP BY 1)
SELECT count(*) AS customers, round(avg(CASE WHEN n = 1 THEN 0 ELSE (other - own) / greatest(own, other) END), 5) AS silhouette FROM ab""")
def _(t):
    z = _labelled(t)
    counted = z.agg(F.least(F.count("*"), F.lit(SG.SILHOUETTE_SAMPLE)).alias("customers"))
    return counted.withColumn("silhouette", F.lit(round(SG.pairwise_silhouette(z), 5)))


@query("sg_05_k_selection")
def _(t):
    _, z, fit = _fit(t)
    return z.agg(F.count("*").alias("customers")).withColumn("chosen_k", F.lit(fit["k"]))


PROFILE_SQL = SG.RFM_SQL + ", pr AS (SELECT CAST(user_id % 5 AS INTEGER) AS cluster_id, count(*) AS customers, " + ", ".join(f"avg({f}) AS {f}" for f in SEGMENT_FEATURES) + " FROM rfm GROUP BY 1)"
RANK_SQL = PROFILE_SQL + ", up AS (" + " UNION ALL ".join(
    f"SELECT cluster_id, '{f}' AS feature, (row_number() OVER (ORDER BY {f}, cluster_id) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS up FROM pr" for f in SEGMENT_FEATURES) + ")"


def _naming_sql() -> str:
    """The rules one after another, each over the clusters that are still free."""
    picks = []
    for nth, (label, weights) in enumerate(SEGMENT_RULES):
        fit = " + ".join(f"CASE WHEN feature = '{f}' THEN {w} * up ELSE 0 END" if w > 0 else
                         f"CASE WHEN feature = '{f}' THEN {-w} * (1 - up) ELSE 0 END" for f, w in weights.items())
        free = "".join(f" AND cluster_id NOT IN (SELECT cluster_id FROM n{i})" for i in range(nth))
        picks.append(f"n{nth} AS (SELECT cluster_id, '{label}' AS segment_label FROM (SELECT cluster_id, round(sum({fit}), 9) AS fit FROM up WHERE true{free} GROUP BY 1) ORDER BY fit DESC, cluster_id LIMIT 1)")
    named = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(len(SEGMENT_RULES)))
    return f"{RANK_SQL}, {', '.join(picks)} SELECT cluster_id, customers, coalesce(segment_label, '{SEGMENT_REST}') AS segment_label FROM pr LEFT JOIN ({named}) USING (cluster_id)"


def _profiles(t):
    return _labelled(t).groupBy("cluster_id").agg(F.count("*").alias("customers"), *[F.avg(c).alias(c) for c in SEGMENT_FEATURES])


@query("win_06_centroid_ranks", RANK_SQL + " SELECT cluster_id, feature, round(up, 6) AS up FROM up")
def _(t):
    return SG.feature_ranks(_profiles(t)).withColumn("up", F.round("up", 6))


@query("sg_06_cluster_names", _naming_sql())
def _(t):
    profiles = _profiles(t)
    return profiles.select("cluster_id", "customers").join(SG.name_clusters(profiles), "cluster_id")
