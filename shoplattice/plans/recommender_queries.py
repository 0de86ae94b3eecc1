"""Recommender signals, graphs and ranked lists."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window as W, functions as F

from shoplattice.functions.grouped import best_unseen, numbered, scalar, top_k
from shoplattice.functions.scalars import minmax, ntz
from shoplattice.operators import catalog as C, evaluate as E, personal as P, recommend as R
from shoplattice.plans.customer_queries import AFF, RECENT, W_SQL
from shoplattice.plans.registry import query
from shoplattice.session import materialise

MATRIX = f"""mx AS (SELECT user_id, product_id, ln(1 + c) AS w FROM (SELECT user_id, product_id,
  sum({W_SQL} * exp(-((epoch_us(e_now) - epoch_us(occurred_at)) / 86400000000.0) / 180.0)) AS c FROM lt_events, lt_asof GROUP BY 1, 2) WHERE c > 0)"""
BM = MATRIX + """, ul AS (SELECT user_id, sum(w) AS len FROM mx GROUP BY 1), il AS (SELECT product_id, count(*) AS df FROM mx GROUP BY 1),
nu AS (SELECT count(*) AS n, avg(len) AS a FROM ul),
bm AS (SELECT mx.user_id, mx.product_id, w * 2.6::DOUBLE / (w + 1.6::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) * ln((n - df + 0.5) / (df + 0.5) + 1.0) AS w
  FROM mx JOIN ul USING (user_id) JOIN il USING (product_id), nu)"""
NEIGH = BM + """, nm AS (SELECT product_id, sqrt(sum(w * w)) AS nrm FROM bm GROUP BY 1),
un AS (SELECT user_id, bm.product_id, w / nrm AS w FROM bm JOIN nm USING (product_id)),
sm AS (SELECT a.product_id AS src, b.product_id AS dst, sum(a.w * b.w) AS similarity FROM un a JOIN un b ON a.user_id = b.user_id AND a.product_id <> b.product_id GROUP BY 1, 2),
nb AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY round(similarity, 6) DESC, dst) AS INTEGER) AS rank FROM sm) WHERE rank <= 50)"""
SIGNALS = """ps AS (SELECT p.*, ln(1 + coalesce(pb, 0)) AS pop, ln(1 + coalesce(tr, 0)) AS trd, CASE WHEN vw >= 3 THEN least(pb / vw, 1) ELSE 0 END AS conversion,
  least(greatest((price * (1 - discount_pct / 100.0) - base_cost) / greatest(price * (1 - discount_pct / 100.0), 0.001), 0), 1) AS margin,
  CASE WHEN inventory > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS availability, rating_avg / 5.0 AS rating FROM lt_products p LEFT JOIN (
  SELECT product_id, count(*) FILTER (WHERE event_type = 'purchase') AS pb, count(*) FILTER (WHERE event_type IN ('product_view','click')) AS vw,
  count(*) FILTER (WHERE event_type IN ('product_view','add_to_cart','purchase') AND occurred_at >= e_now - INTERVAL 30 DAY) AS tr
  FROM lt_events, lt_asof GROUP BY 1) e ON e.product_id = p.id),
s1 AS (SELECT *, pop / max(pop) OVER () AS popularity, trd / max(trd) OVER () AS trending FROM ps),
s2 AS (SELECT *, 0.55::DOUBLE * margin + 0.25::DOUBLE * conversion + 0.20::DOUBLE * availability AS bu, 0.7::DOUBLE * popularity + 0.3::DOUBLE * trending AS bl,
  0.45::DOUBLE * popularity + 0.3::DOUBLE * trending + 0.25::DOUBLE * rating AS cs FROM s1),
sig AS (SELECT *, (bu - min(bu) OVER ()) / (max(bu) OVER () - min(bu) OVER ()) AS business, (bl - min(bl) OVER ()) / (max(bl) OVER () - min(bl) OVER ()) AS blend,
  (cs - min(cs) OVER ()) / (max(cs) OVER () - min(cs) OVER ()) * (0.3::DOUBLE + 0.7::DOUBLE * availability) AS cold_start FROM s2)"""
HIST = """hs AS (SELECT * FROM (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS recency
  FROM lt_events WHERE event_type IN ('purchase','add_to_cart','wishlist','click','product_view')) WHERE recency <= 60)"""


def matrix(t):
    return R.interaction_matrix(t.events, t.events_as_of)


def neighbours(t):
    return R.item_neighbours(R.bm25_weighted(matrix(t)))


def signals(t):
    return R.item_signals(t.products, t.events, t.events_as_of)


CUT_SQL = "cut AS (SELECT quantile_cont(CAST(epoch_us(occurred_at) AS DOUBLE), 0.85) AS c FROM lt_events)"


@query("rc_01_temporal_split", f"""
WITH {CUT_SQL} SELECT CASE WHEN epoch_us(occurred_at) <= c THEN 'train' WHEN event_type IN ('purchase','add_to_cart') THEN 'test' ELSE 'dropped' END AS split,
  event_type, count(*) AS n FROM lt_events, cut GROUP BY 1, 2""")
def _(t):
    return R.temporal_split(t.events).groupBy("split", "event_type").agg(F.count("*").alias("n"))


@query("win_12_time_percentile_cut", f"WITH {CUT_SQL} SELECT id, epoch_us(occurred_at) <= c AS is_train FROM lt_events, cut")
def _(t):
    return t.events.select("id", (F.unix_micros(F.col("occurred_at").cast("timestamp")) <= R.temporal_cut(t.events, 0.85)).alias("is_train"))


@query("rc_02_interaction_matrix", f"WITH {MATRIX} SELECT user_id, product_id, round(w, 6) AS weight FROM mx")
def _(t):
    return matrix(t).withColumn("weight", F.round("weight", 6))


@query("rc_03_bm25_matrix", f"WITH {BM} SELECT user_id, product_id, round(w, 6) AS weight FROM bm")
def _(t):
    return R.bm25_weighted(matrix(t)).withColumn("weight", F.round("weight", 6))


@query("rc_05_item_neighbours", f"WITH {NEIGH} SELECT src, dst, round(similarity, 6) AS similarity, rank FROM nb")
def _(t):
    return neighbours(t).withColumn("similarity", F.round("similarity", 6))


@query("rc_07_popularity", f"WITH {SIGNALS} SELECT id, round(popularity, 6) AS popularity, round(trending, 6) AS trending, round(blend, 6) AS blend FROM sig")
def _(t):
    return signals(t).select("id", *[F.round(c, 6).alias(c) for c in ("popularity", "trending", "blend")])


@query("rc_08_conversion", f"WITH {SIGNALS} SELECT id, round(conversion, 6) AS conversion FROM sig")
def _(t):
    return signals(t).select("id", F.round("conversion", 6).alias("conversion"))


GRAPH = """bk AS (SELECT DISTINCT order_id, product_id FROM lt_lines), ic AS (SELECT product_id, count(*) AS n FROM bk GROUP BY 1),
nn AS (SELECT count(DISTINCT order_id) AS total FROM bk),
pr AS (SELECT a.product_id AS src, b.product_id AS dst, count(*) AS n_ab FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.product_id <> b.product_id GROUP BY 1, 2),
wt AS (SELECT src, dst, ln(1 + n_ab) * least(n_ab * total / (x.n * y.n), 25) AS weight FROM pr JOIN ic x ON x.product_id = src JOIN ic y ON y.product_id = dst, nn),
gr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY round(weight, 6) DESC, dst) AS INTEGER) AS rank FROM wt) WHERE rank <= 12)"""


@query("rc_09_co_purchase_graph", f"WITH {GRAPH} SELECT src, dst, round(weight, 5) AS weight, rank FROM gr")
def _(t):
    return R.co_purchase_graph(t.order_lines).withColumn("weight", F.round("weight", 5))


@query("jn_07_basket_pairs", """
SELECT a.product_id AS a, b.product_id AS b, count(*) AS n FROM (SELECT DISTINCT order_id, product_id FROM lt_lines) a
JOIN (SELECT DISTINCT order_id, product_id FROM lt_lines) b ON a.order_id = b.order_id AND a.product_id < b.product_id GROUP BY 1, 2""")
def _(t):
    from shoplattice.functions.grouped import group_items, item_pairs
    return item_pairs(group_items(t.order_lines, "order_id", "product_id"), "order_id", "product_id").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("rc_17_bought_together", f"WITH {GRAPH} SELECT src AS product_id, dst AS other_id, round(weight, 5) AS score, rank, 'co_purchase_model' AS strategy FROM gr WHERE rank <= 5")
def _(t):
    out = R.bought_together(R.co_purchase_graph(t.order_lines), t.order_lines, 5)
    return out.withColumn("score", F.round("score", 5))


# A model of the last 90 days; products that it doesn't know take the counts over all orders.
@query("rc_17_bought_together_fallback", "WITH fresh AS (SELECT order_id, product_id FROM lt_items, lt_asof WHERE placed_at >= o_now - INTERVAL 90 DAY), " + GRAPH.replace("lt_lines", "fresh") + """,
md AS (SELECT src AS product_id, dst AS other_id, round(weight, 5) AS score, rank, 'co_purchase_model' AS strategy FROM gr WHERE rank <= 5),
cn AS (SELECT a.product_id, b.product_id AS other_id, count(*) AS n FROM (SELECT DISTINCT order_id, product_id FROM lt_lines) a JOIN lt_lines b ON a.order_id = b.order_id AND a.product_id <> b.product_id GROUP BY 1, 2)
SELECT * FROM md UNION ALL SELECT product_id, other_id, round(n / max(n) OVER (PARTITION BY product_id), 5) AS score, CAST(row_number() OVER (PARTITION BY product_id ORDER BY n DESC, other_id) AS INTEGER) AS rank,
  'co_purchase_sql' AS strategy FROM cn WHERE product_id NOT IN (SELECT product_id FROM md) QUALIFY rank <= 5""")
def _(t):
    fresh = t.order_items.where(F.col("placed_at") >= ntz(t.orders_as_of - timedelta(days=90)))
    out = R.bought_together(R.co_purchase_graph(fresh), t.order_lines, 5)
    return out.withColumn("score", F.round("score", 5))


CF = f"""WITH {NEIGH}, {HIST},
sd AS (SELECT user_id, product_id AS src, count(*) AS times FROM hs WHERE recency <= 25 GROUP BY 1, 2),
rw AS (SELECT user_id, dst AS product_id, sum(similarity * times) AS raw FROM sd JOIN nb USING (src) GROUP BY 1, 2),
sp AS (SELECT user_id, CASE WHEN count(*) < (SELECT count(*) FROM lt_products) THEN least(min(raw), 0) ELSE min(raw) END AS lo, max(raw) AS hi FROM rw GROUP BY 1)
SELECT user_id, product_id, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (raw - lo) / (hi - lo) END, 5) AS score FROM rw JOIN sp USING (user_id)"""


@query("rc_11_item_cf", CF)
def _(t):
    n = t.products.agg(F.count("*")).scalar()
    return R.item_cf_scores(R.user_history(t.events), neighbours(t), n).withColumn("score", F.round("score", 5))


CONTENT = f"""WITH {HIST}, sd AS (SELECT user_id, product_id, count(*) AS times FROM hs WHERE recency <= 25 GROUP BY 1, 2),
pv AS (SELECT user_id, list(v ORDER BY i) AS v FROM (SELECT user_id, i, sum(times * vector[i]) AS v FROM sd JOIN lt_vectors x ON x.id = product_id, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
pn AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pv),
cs AS (SELECT user_id, id AS product_id, list_dot_product(v, vector) AS c FROM pn, lt_vectors),
cm AS (SELECT *, min(c) OVER (PARTITION BY user_id) AS lo, max(c) OVER (PARTITION BY user_id) AS hi,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(c, 6) DESC, product_id) AS INTEGER) AS rank FROM cs)
SELECT user_id, product_id, round((c - lo) / (hi - lo), 5) AS score, rank FROM cm WHERE rank <= 20"""


@query("rc_12_content_scores", CONTENT)
def _(t):
    return R.content_topk(R.user_history(t.events), t.vectors).withColumn("score", F.round("score", 5))


@query("rc_13_personal_scores", f"""WITH {RECENT}{AFF.format(d='category')}{AFF.format(d='brand')},
cb AS (SELECT DISTINCT category_id, brand_id FROM lt_products),
pe AS (SELECT user_id, category_id, brand_id, sum(p) AS p FROM (SELECT user_id, cb.category_id, cb.brand_id, 0.65::DOUBLE * affinity AS p FROM category_aff JOIN cb USING (category_id)
  UNION ALL SELECT user_id, cb.category_id, cb.brand_id, 0.35::DOUBLE * affinity FROM brand_aff JOIN cb USING (brand_id)) GROUP BY 1, 2, 3),
sp AS (SELECT user_id, CASE WHEN count(*) < (SELECT count(*) FROM cb) THEN least(min(p), 0) ELSE min(p) END AS lo,
  CASE WHEN count(*) < (SELECT count(*) FROM cb) THEN greatest(max(p), 0) ELSE max(p) END AS hi FROM pe GROUP BY 1)
SELECT user_id, category_id, brand_id, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (p - lo) / (hi - lo) END, 5) AS score FROM pe JOIN sp USING (user_id)""")
def _(t):
    recent = P.last_events(t.events, t.products)
    s = R.personal_scaled(P.affinity(recent, "category_id", t.events_as_of), P.affinity(recent, "brand_id", t.events_as_of), t.products)
    return s.withColumn("score", F.round("score", 5))


@query("rc_14_business_scores", f"WITH {SIGNALS} SELECT id, round(business, 6) AS business FROM sig")
def _(t):
    return signals(t).select("id", F.round("business", 6).alias("business"))


SIMILAR = """n AS (SELECT count(*) AS c FROM lt_vectors),
bs AS (SELECT src, CASE WHEN count(*) < (SELECT c FROM n) THEN least(min(similarity), 0) ELSE min(similarity) END AS lo, max(similarity) AS hi FROM nb GROUP BY 1),
pp AS (SELECT a.id, b.id AS product_id, list_dot_product(a.vector, b.vector) AS c, a.category_id = b.category_id AS same FROM lt_vectors a, lt_vectors b),
pc AS (SELECT *, min(c) OVER (PARTITION BY id) AS clo, max(c) OVER (PARTITION BY id) AS chi FROM pp),
f AS (SELECT pc.id, pc.product_id, 0.5::DOUBLE * (c - clo) / (chi - clo) + 0.35::DOUBLE * CASE WHEN hi - lo >= 1e-9 THEN (coalesce(similarity, 0) - lo) / (hi - lo) ELSE 0 END
  + CASE WHEN same THEN 0.15::DOUBLE ELSE 0 END AS score FROM pc LEFT JOIN bs ON bs.src = pc.id LEFT JOIN nb ON nb.src = pc.id AND nb.dst = pc.product_id WHERE pc.id <> pc.product_id)"""


@query("rc_16_similar_items", f"""WITH {NEIGH}, {SIMILAR}
SELECT id, product_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 5) DESC, product_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    return R.similar_items(t.vectors, neighbours(t)).withColumn("score", F.round("score", 5))


@query("rc_18_cold_start", f"""WITH {SIGNALS} SELECT 'category' AS scope, id, category_id, round(cold_start, 5) AS score,
  CAST(row_number() OVER (PARTITION BY category_id ORDER BY round(cold_start, 6) DESC, id) AS INTEGER) AS rank FROM sig WHERE cold_start > 0 QUALIFY rank <= 10
UNION ALL SELECT 'all', id, category_id, round(cold_start, 5), CAST(row_number() OVER (ORDER BY round(cold_start, 6) DESC, id) AS INTEGER) AS rank FROM sig WHERE cold_start > 0 QUALIFY rank <= 10""")
def _(t):
    s = signals(t)
    a = R.cold_start_items(s, 10, per_category=True).withColumn("scope", F.lit("category"))
    b = R.cold_start_items(s, 10).withColumn("scope", F.lit("all"))
    return a.unionByName(b).select("scope", "id", "category_id", F.round("cold_start", 5).alias("score"), "rank")


@query("rc_19_trending_items", f"""WITH {SIGNALS} SELECT id, round(trending, 5) AS trending, CAST(row_number() OVER (ORDER BY round(trending * (0.3::DOUBLE + 0.7::DOUBLE * availability), 6) DESC, id) AS INTEGER) AS rank
FROM sig QUALIFY rank <= 10""")
def _(t):
    return R.trending_items(signals(t)).select("id", F.round("trending", 5).alias("trending"), "rank")


ROUTE_SQL = f"""it AS (SELECT user_id, count(*) AS n FROM rec WHERE {W_SQL} <> 0 GROUP BY 1),
rt AS (SELECT u.id AS user_id, CASE WHEN coalesce(it.n, 0) < 3 THEN 'cold_start' ELSE 'hybrid' END AS strategy FROM lt_users u LEFT JOIN it ON it.user_id = u.id)"""


def routed(t):
    """Users with the strategy that serves them."""
    recent = P.last_events(t.events, t.products)
    n = recent.where(F.col("event_type").isin(*P.WEIGHTED)).groupBy("user_id").agg(F.count("*").alias("n"))
    return t.users.select(F.col("id").alias("user_id")).join(n, "user_id", "left").select(
        "user_id", F.when(F.coalesce("n", F.lit(0)) < 3, "cold_start").otherwise("hybrid").alias("strategy"))


@query("rc_20_strategy_router", f"WITH {RECENT}, {ROUTE_SQL} SELECT user_id, strategy FROM rt")
def _(t):
    return routed(t)


def serving(t, lists):
    """Served lists of all users: their own list, then the stored cold-start lists (10 for each category, 10 for all), then popularity."""
    recent = P.last_events(t.events, t.products)
    favourite = P.affinity(recent, "category_id", t.events_as_of).groupBy("user_id").agg(
        F.min_by("category_id", F.struct(-F.col("affinity"), "category_id")).alias("category_id"))
    s = materialise(signals(t), "item-signals")
    cold = s.where("cold_start > 0").select(F.col("id").alias("product_id"), "category_id", "cold_start")
    order = [F.round("cold_start", 6).desc(), F.col("product_id")]
    by_category = top_k(cold, ["category_id"], order, 10, rank="pos")
    for_all = top_k(cold.orderBy(*order).limit(10).withColumn("_g", F.lit(1)), ["_g"], order, 10, rank="pos")
    popular = numbered(s.select(F.col("id").alias("product_id"), F.round("popularity", 6).alias("p")), [F.col("p").desc(), F.col("product_id")])
    users = routed(t).join(favourite, "user_id", "left")
    return R.served_lists(users, lists, by_category, for_all, popular, R.user_history(t.events).select("user_id", "product_id").distinct(), 10)


SERVED = CF[:CF.rindex("SELECT user_id")] + f""", {RECENT}, {ROUTE_SQL}{AFF.format(d='category')}, {SIGNALS},
fav AS (SELECT user_id, arg_min(category_id, (-affinity, category_id)) AS category_id FROM category_aff GROUP BY 1),
cl AS (SELECT id, category_id, round(cold_start, 6) AS c FROM sig WHERE cold_start > 0),
arms AS (SELECT user_id, product_id, 1 AS arm, row_number() OVER (PARTITION BY user_id ORDER BY round(raw, 6) DESC, product_id) AS pos FROM rw JOIN rt USING (user_id) WHERE strategy = 'hybrid'
UNION ALL SELECT user_id, c.id, 2, pos FROM rt JOIN fav USING (user_id) JOIN (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY c DESC, id) AS pos FROM cl QUALIFY pos <= 10) c USING (category_id) WHERE strategy = 'cold_start'
UNION ALL SELECT user_id, c.id, 3, pos FROM rt, (SELECT *, row_number() OVER (ORDER BY c DESC, id) AS pos FROM cl QUALIFY pos <= 10) c
UNION ALL SELECT user_id, c.id, 4, pos FROM rt, (SELECT id, row_number() OVER (ORDER BY round(popularity, 6) DESC, id) AS pos FROM sig) c),
one AS (SELECT user_id, product_id, min((arm, pos)) AS place FROM arms ANTI JOIN hs USING (user_id, product_id) GROUP BY 1, 2),
sl AS (SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY place) AS INTEGER) AS rank, CASE place[1] WHEN 1 THEN 'hybrid' WHEN 4 THEN 'popularity_fallback' ELSE 'cold_start' END AS strategy
FROM one QUALIFY rank <= 10)"""


def item_cf_lists(t):
    history = materialise(R.user_history(t.events), "history")
    raw = R.item_cf_raw(history, neighbours(t)).join(history.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")
    return top_k(raw, ["user_id"], [F.round("raw", 6).desc(), F.col("product_id")], 10)


@query("rc_20_refilled_lists", SERVED + " SELECT user_id, product_id, rank, strategy FROM sl")
def _(t):
    return serving(t, item_cf_lists(t))


@query("rc_20_served_lists")
def _(t):
    u, i = hybrid_inputs(t)
    return serving(t, R.hybrid_topk(u, i, 10).select("user_id", "product_id", "rank"))


VIEWED = """vw AS (SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ats DESC) AS INTEGER) AS position FROM
  (SELECT user_id, product_id, max((occurred_at, id)) AS ats FROM lt_events WHERE event_type IN ('product_view','click') GROUP BY 1, 2)),
ct AS (SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ats DESC) AS INTEGER) AS position FROM (SELECT user_id, product_id, max((occurred_at, id)) AS ats
  FROM lt_events WHERE event_type IN ('add_to_cart','remove_from_cart') GROUP BY 1, 2 HAVING arg_max(event_type, (occurred_at, id)) = 'add_to_cart')),
bo AS (SELECT DISTINCT user_id, product_id FROM lt_events WHERE event_type = 'purchase')"""


def cart_minus_bought(t):
    bought = t.events.where("event_type = 'purchase'").select("user_id", "product_id").distinct()
    left = P.cart_state(t.events).join(bought, ["user_id", "product_id"], "left_anti")
    return top_k(left, ["user_id"], [F.col("position")], 8, rank="rank")


@query("rc_21_continue_shopping", f"""WITH {VIEWED} SELECT 'recently_viewed' AS rail, user_id, product_id, position AS rank, round(1.0 - (position - 1) * 0.01, 4) AS score FROM vw WHERE position <= 10
UNION ALL SELECT 'cart', user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY position) AS INTEGER) AS rank, 1.0 FROM (SELECT * FROM ct WHERE position <= 30)
  ANTI JOIN bo USING (user_id, product_id) QUALIFY rank <= 8""")
def _(t):
    v = P.recently_viewed(t.events, n=10).select(F.lit("recently_viewed").alias("rail"), "user_id", "product_id", F.col("position").alias("rank"),
                                                 F.round(1.0 - (F.col("position") - 1) * 0.01, 4).alias("score"))
    return v.unionByName(cart_minus_bought(t).select(F.lit("cart").alias("rail"), "user_id", "product_id", "rank", F.lit(1.0).alias("score")))


@query("set_03_cart_minus_purchased", f"""WITH {VIEWED} SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY position) AS INTEGER) AS rank
FROM (SELECT * FROM ct WHERE position <= 30) ANTI JOIN bo USING (user_id, product_id) QUALIFY rank <= 8""")
def _(t):
    return cart_minus_bought(t).select("user_id", "product_id", "rank")


@query("jn_06_exclude_history", f"""WITH {HIST}, {SIGNALS} SELECT user_id, id AS product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY b DESC, id) AS INTEGER) AS rank
  FROM (SELECT u.user_id, s.id, round(s.blend, 6) AS b FROM (SELECT DISTINCT user_id FROM hs) u, sig s) x WHERE NOT EXISTS (SELECT 1 FROM hs WHERE hs.user_id = x.user_id AND hs.product_id = x.id) QUALIFY rank <= 20""")
def _(t):
    hist = R.user_history(t.events).select("user_id", "product_id")
    ranking = numbered(signals(t).select(F.col("id").alias("product_id"), F.round("blend", 6).alias("blend")), [F.col("blend").desc(), F.col("product_id")])
    return best_unseen(ranking, hist, hist, 20).select("user_id", "product_id", "rank")


@query("jn_14_hydrate_ranked", f"""WITH {SIGNALS} SELECT s.id AS product_id, CAST(row_number() OVER (ORDER BY round(s.blend, 6) DESC, s.id) AS INTEGER) AS rank, title, brand_name FROM sig s QUALIFY rank <= 50""")
def _(t):
    best = signals(t).select(F.col("id").alias("product_id"), "blend").orderBy(F.round("blend", 6).desc(), "product_id").limit(50)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.round("blend", 6).desc(), "product_id")))
    return ranked.join(t.products.select(F.col("id").alias("product_id"), "title", "brand_name"), "product_id").drop("blend")


TREND_USER = """dl AS (SELECT id AS product_id, CAST(row_number() OVER (ORDER BY discount_pct DESC, rating_avg DESC, id) AS INTEGER) AS rank FROM lt_products
  WHERE is_active AND discount_pct > 0 AND inventory > 0 QUALIFY rank <= 8)"""


@query("rc_22_homepage_rails", f"""WITH {RECENT}, {ROUTE_SQL}, {VIEWED}, {TREND_USER}
SELECT 'recent' AS rail, user_id, product_id, position AS rank FROM vw JOIN rt USING (user_id) WHERE strategy = 'hybrid' AND position <= 8
UNION ALL SELECT 'continue', user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY position) AS INTEGER) AS rank FROM (SELECT ct.* FROM ct JOIN rt USING (user_id) WHERE strategy = 'hybrid' AND position <= 30)
  ANTI JOIN bo USING (user_id, product_id) QUALIFY rank <= 8
UNION ALL SELECT 'deals', user_id, product_id, rank FROM rt, dl""")
def _(t):
    from shoplattice.plans.jobs import homepage
    return homepage(t).where(F.col("rail").isin("recent", "continue", "deals")).select("rail", "user_id", "product_id", "rank")


# The whole page reads the lists served above, the similar items of the last view, and the trending counts.
FILLED = f"""{VIEWED}, {SIMILAR},
sr AS (SELECT id, product_id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 5) DESC, product_id) AS INTEGER) AS rank FROM f),
cm AS (SELECT user_id, product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY position) AS INTEGER) AS rank FROM (SELECT * FROM ct WHERE position <= 30) ANTI JOIN bo USING (user_id, product_id) QUALIFY rank <= 8),
cf AS (SELECT user_id, product_id, rank, 'cart' AS origin FROM cm UNION ALL SELECT vw.user_id, sr.product_id, CAST(sr.rank + coalesce(n, 0) AS INTEGER), 'similar' FROM vw JOIN sr ON sr.id = vw.product_id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM cm GROUP BY 1) USING (user_id) WHERE position = 1 AND sr.rank + coalesce(n, 0) <= 8)"""


def continued(t, k=8):
    return R.continue_shopping(cart_minus_bought(t), P.recently_viewed(t.events, n=1), R.similar_items(t.vectors, neighbours(t), k), k)


@query("rc_21_continue_filled", f"WITH {NEIGH}, {FILLED} SELECT user_id, product_id, rank, origin FROM cf")
def _(t):
    return continued(t)


HOME = SERVED + f""", {FILLED}, {TREND_USER},
tn AS (SELECT product_id, category_id, count(*) AS n FROM lt_events e JOIN lt_products p ON p.id = product_id, lt_asof
  WHERE p.is_active AND event_type IN ('product_view','add_to_cart','purchase') AND occurred_at >= e_now - INTERVAL 14 DAY GROUP BY 1, 2),
page AS (SELECT 'for_you' AS rail, strategy, user_id, product_id, rank FROM sl WHERE rank <= 8
UNION ALL SELECT 'continue', 'continue_shopping', user_id, product_id, cf.rank FROM cf JOIN rt USING (user_id) WHERE rt.strategy = 'hybrid'
UNION ALL SELECT 'recent', 'recently_viewed', user_id, product_id, position FROM vw JOIN rt USING (user_id) WHERE rt.strategy = 'hybrid' AND position <= 8
UNION ALL SELECT 'deals', 'deals', user_id, product_id, dl.rank FROM rt, dl
UNION ALL SELECT 'trending', 'trending_events', user_id, product_id, x.rank FROM rt, (SELECT product_id, CAST(row_number() OVER (ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM tn QUALIFY rank <= 8) x
UNION ALL SELECT 'category_affinity', 'trending_events', user_id, product_id, x.rank FROM fav JOIN (SELECT category_id, product_id, CAST(row_number() OVER (PARTITION BY category_id ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM tn QUALIFY rank <= 8) x USING (category_id))"""


@query("rc_22_whole_homepage", HOME + " SELECT rail, strategy, user_id, product_id, rank FROM page")
def _(t):
    from shoplattice.plans.jobs import whole_homepage
    return whole_homepage(t, item_cf_lists(t))


@query("rc_23_explanations", f"""WITH {SIGNALS}, b AS (SELECT id, [('popularity', blend, 0), ('business', business, 1)] AS l, blend, business FROM sig)
SELECT id, CASE WHEN blend <= 0.05 AND business <= 0.05 THEN 'Recommended based on overall store trends'
  WHEN business <= 0.05 THEN 'Recommended because it is trending across the store' WHEN blend <= 0.05 THEN 'Recommended because it is well stocked and highly rated'
  WHEN blend >= business THEN 'Recommended because it is trending across the store and it is well stocked and highly rated'
  ELSE 'Recommended because it is well stocked and highly rated and it is trending across the store' END AS explanation FROM b""")
def _(t):
    s = signals(t)
    reasons = {"blend": R.RECOMMENDER_REASONS["popularity"], "business": R.RECOMMENDER_REASONS["business"]}
    return s.select("id", R.explain_components(reasons).alias("explanation"))


# ---- fitted parts ----------------------------------------------------------
def hybrid_inputs(t):
    hist = R.user_history(t.events)
    recent = P.last_events(t.events, t.products)
    weighted = materialise(R.bm25_weighted(matrix(t)), "matrix")
    uf, itf = R.latent_factors(weighted, rank=32, iterations=8)
    users = hist.select("user_id").distinct()
    rows = R.user_inputs(users, uf, hist, R.item_neighbours(weighted), t.vectors, P.affinity(recent, "category_id", t.events_as_of),
                         P.affinity(recent, "brand_id", t.events_as_of), t.products)
    return materialise(rows, "user-inputs"), materialise(R.item_inputs(signals(t), itf, t.vectors), "item-inputs")


@query("rc_04_latent_factors")
def _(t):
    uf, itf = R.latent_factors(R.bm25_weighted(matrix(t)), rank=32, iterations=8)
    return uf.withColumn("side", F.lit("user")).unionByName(itf.withColumn("side", F.lit("item"))).groupBy("side").agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("rank"))


@query("rc_10_collaborative_scores")
def _(t):
    from shoplattice.functions.grouped import block_topk
    uf, itf = R.latent_factors(R.bm25_weighted(matrix(t)), rank=32, iterations=8)
    return block_topk(uf, itf, 10).select(F.col("query_id").alias("user_id"), F.col("id").alias("product_id"), F.round("score", 4).alias("score"), "rank")


@query("rc_15_hybrid_recommendations")
def _(t):
    u, i = hybrid_inputs(t)
    return R.hybrid_topk(u, i, 10).withColumn("explanation", R.explain_components())


@query("rc_26_evaluation_ranking")
def _(t):
    u, i = hybrid_inputs(t)
    return R.hybrid_topk(u, i, 20, {"personalization": 0.0}).select("user_id", "product_id", "rank", F.round("score", 5).alias("score"))


@query("rc_25_baselines")
def _(t):
    return E.baseline_report(t.events, t.products, t.events_as_of)


@query("rc_24_weight_grid")
def _(t):
    grid = E.weight_grid(t.events, t.products, t.events_as_of, t.vectors)
    return grid.select("grid_id", "evaluated_users", F.round("ndcg", 5).alias("ndcg"), *[F.col(n).alias(f"w_{n}") for n in E.RECOMMENDER_WEIGHTS], "chosen")


# ---- normalisation windows -------------------------------------------------
@query("win_07_minmax_two_flavours", """
SELECT id, round((price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w), 6) AS scaled, 1.0::DOUBLE AS constant_search, 0.0::DOUBLE AS constant_recommender FROM lt_products WINDOW w AS (PARTITION BY category_id)""")
def _(t):
    span = t.products.groupBy("category_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    one = F.lit(5.0)
    return t.products.join(span, "category_id").select(
        "id", F.round(minmax(F.col("price"), F.col("lo"), F.col("hi")), 6).alias("scaled"),
        minmax(one, one, one, 1.0).alias("constant_search"), minmax(one, one, one).alias("constant_recommender"))


@query("win_08_residualise", """
WITH m AS (SELECT category_id, covar_pop(price, inventory) AS cv, var_pop(inventory) AS vr FROM lt_products GROUP BY 1),
r AS (SELECT p.id, p.category_id, price - cv / vr * inventory AS r FROM lt_products p JOIN m USING (category_id))
SELECT id, round((r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w), 5) AS residual FROM r WINDOW w AS (PARTITION BY category_id)""")
def _(t):
    p = t.products.select("id", "category_id", "price", F.col("inventory").cast("double").alias("inventory"))
    return R.residualise(p, "category_id", "price", "inventory", "residual").select("id", F.round("residual", 5).alias("residual"))


@query("win_09_last_n_per_user", f"WITH {HIST} SELECT user_id, product_id, recency FROM hs")
def _(t):
    return R.user_history(t.events).select("user_id", "product_id", F.col("recency").cast("long").alias("recency"))


@query("win_11_served_rank", f"WITH {SIGNALS} SELECT id, category_id, CAST(row_number() OVER (PARTITION BY category_id ORDER BY round(blend, 6) DESC, id) AS INTEGER) AS rank FROM sig QUALIFY rank <= 15")
def _(t):
    return top_k(signals(t).select("id", "category_id", "blend"), ["category_id"], [F.round("blend", 6).desc(), F.col("id")], 15).drop("blend")


@query("topk_01_topk_with_exclusion", """SELECT user_id, id AS product_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rating_avg DESC, id) AS INTEGER) AS rank FROM
  (SELECT DISTINCT user_id FROM lt_events) u, lt_products p
  WHERE NOT EXISTS (SELECT 1 FROM lt_events e WHERE e.user_id = u.user_id AND e.product_id = p.id) QUALIFY rank <= 5""")
def _(t):
    seen = t.events.select("user_id", "product_id")
    ranking = numbered(t.products.select(F.col("id").alias("product_id"), "rating_avg"), [F.col("rating_avg").desc(), F.col("product_id")])
    return best_unseen(ranking, seen, seen, 5).select("user_id", "product_id", "rank")


@query("topk_02_per_group_topk", "SELECT user_id, product_id, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, product_id) AS INTEGER) AS rank FROM (SELECT user_id, product_id, count(*) AS n FROM lt_events GROUP BY 1, 2) QUALIFY rank <= 12")
def _(t):
    n = t.events.groupBy("user_id", "product_id").agg(F.count("*").alias("n"))
    return top_k(n, ["user_id"], [F.col("n").desc(), F.col("product_id")], 12)
