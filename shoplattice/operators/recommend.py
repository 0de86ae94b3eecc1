"""Hybrid recommender for all users at once.

Signals per item and sparse signals per (user, item) are plain DataFrame jobs.
The dense part (latent and content similarity of every user with every item)
is scored block against block: a task holds one block of users and one block
of items, and only per-user moments or the best k rows leave it. Full-catalogue
normalisation is therefore exact without ever writing users x items rows.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoplattice.constants import (
    EVENT_WEIGHTS, INTERACTION_DECAY_DAYS, RECOMMENDER_REASONS, RECOMMENDER_WEIGHTS, TRENDING_TYPES, VIEW_TYPES,
)
from shoplattice.functions.grouped import block_best, both_directions, group_items, grouped_percentiles, item_pairs, salted_join, top_k
from shoplattice.functions.scalars import age_days, clip, dot, event_weight, minmax, ntz, top_labels
from shoplattice.operators.catalog import margin
from shoplattice.session import materialise

WEIGHTED = tuple(k for k in EVENT_WEIGHTS if k != "search")
POSITIVE = ("purchase", "add_to_cart", "wishlist", "click", "product_view")
SIMILARITY_DIGITS = 6
#: Items of a group that one task orders.
GROUP_ROWS = 500_000


# ---- split and interaction matrix ------------------------------------------
def usable_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("product_id").isNotNull() & F.col("user_id").isNotNull() & F.col("event_type").isin(*WEIGHTED))


def temporal_cut(events: DataFrame, q: float) -> Column:
    """Event-time percentile as a scalar (microseconds)."""
    us = events.select(F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"))
    return grouped_percentiles(us, [], "us", {"cut": q}).select("cut").scalar()


def temporal_split(events: DataFrame, test_fraction: float = 0.15) -> DataFrame:
    """Usable events tagged train / test / dropped; test keeps purchases and cart adds after the cut."""
    usable = usable_events(events)
    late = F.unix_micros(F.col("occurred_at").cast("timestamp")) > temporal_cut(usable, 1 - test_fraction)
    return usable.withColumn("split", F.when(~late, "train").when(
        F.col("event_type").isin("purchase", "add_to_cart"), "test").otherwise("dropped"))


def interaction_matrix(events: DataFrame, as_of: datetime) -> DataFrame:
    """(user_id, product_id, weight): decayed confidence, clipped at zero, log1p."""
    conf = event_weight() * F.exp(-age_days(as_of, "occurred_at") / INTERACTION_DECAY_DAYS)
    summed = usable_events(events).groupBy("user_id", "product_id").agg(F.sum(conf).alias("c"))
    return summed.where(F.col("c") > 0).select("user_id", "product_id", F.log1p("c").alias("weight"))


def bm25_weighted(matrix: DataFrame, n_users: int | None = None, k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """Damp heavy users and popular items. ``n_users`` defaults to the users present."""
    matrix = materialise(matrix, "interactions")  # read by users, items, facts and the join
    users = matrix.groupBy("user_id").agg(F.sum("weight").alias("len"))
    items = matrix.groupBy("product_id").agg(F.count("*").alias("df"))
    facts = users.agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("avg"))).scalar()
    joined = matrix.join(users, "user_id").join(items, "product_id").withColumn("_f", facts)
    n = F.lit(n_users) if n_users else F.col("_f.n")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    damp = F.col("weight") * (k1 + 1.0) / (F.col("weight") + k1 * (1.0 - b + b * F.col("len") / F.col("_f.avg")))
    return joined.select("user_id", "product_id", (damp * idf).alias("weight"))


def item_neighbours(matrix: DataFrame, k: int = 50) -> DataFrame:
    """Top-k cosine neighbours per item, exact, from block-wise pairs of every user's items."""
    matrix = materialise(matrix, "weighted-interactions")  # read by norms and by the pairs' two sides
    norms = matrix.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = matrix.join(norms, "product_id").select("user_id", "product_id", (F.col("weight") / F.col("norm")).alias("w"))
    sims = item_pairs(unit, "user_id", "product_id", ["w"]).groupBy("a", "b").agg(
        F.sum(F.col("w_a") * F.col("w_b")).alias("similarity"))
    edges = both_directions(sims, "similarity")
    return top_k(edges, ["src"], [F.round("similarity", SIMILARITY_DIGITS).desc(), F.col("dst")], k)


# ---- item signals ----------------------------------------------------------
def item_signals(products: DataFrame, events: DataFrame, as_of: datetime, trending_days: int = 30) -> DataFrame:
    """Popularity, trending, conversion, margin, availability, rating, business and blend per product."""
    kind = F.col("event_type")
    recent = (F.col("occurred_at") >= ntz(as_of - timedelta(days=trending_days))) & kind.isin(*TRENDING_TYPES)
    per = usable_events(events).groupBy(F.col("product_id").alias("id")).agg(
        F.count_if(kind == "purchase").alias("_p"), F.count_if(kind.isin(*VIEW_TYPES)).alias("_v"),
        F.count_if(recent).alias("_t"))
    base = products.join(per, "id", "left").select(
        "id", "category_id", "brand_id",
        F.log1p(F.coalesce("_p", F.lit(0))).alias("_pop"), F.log1p(F.coalesce("_t", F.lit(0))).alias("_tr"),
        clip(F.when(F.col("_v") >= 3, F.col("_p") / F.col("_v")).otherwise(0.0), 0.0, 1.0).alias("conversion"),
        margin().alias("margin"), (F.col("inventory") > 0).cast("double").alias("availability"),
        clip(F.col("rating_avg") / 5.0, 0.0, 1.0).alias("rating"))
    peaks = base.agg(F.struct(F.max("_pop").alias("p"), F.max("_tr").alias("t"))).scalar()
    scaled = base.withColumn("_m", peaks).withColumns({
        "popularity": F.when(F.col("_m.p") > 0, F.col("_pop") / F.col("_m.p")).otherwise(0.0),
        "trending": F.when(F.col("_m.t") > 0, F.col("_tr") / F.col("_m.t")).otherwise(0.0)})
    raw = scaled.withColumns({
        "_bus": 0.55 * F.col("margin") + 0.25 * F.col("conversion") + 0.20 * F.col("availability"),
        "_bl": 0.7 * F.col("popularity") + 0.3 * F.col("trending"),
        "_cs": 0.45 * F.col("popularity") + 0.3 * F.col("trending") + 0.25 * F.col("rating")})
    span = raw.agg(F.struct(*[f(c).alias(f"{n}{c}") for c in ("_bus", "_bl", "_cs") for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    ranged = raw.withColumn("_s", span)
    for out, c in (("business", "_bus"), ("blend", "_bl"), ("_cold", "_cs")):
        ranged = ranged.withColumn(out, minmax(F.col(c), F.col(f"_s.lo{c}"), F.col(f"_s.hi{c}")))
    return ranged.withColumn("cold_start", F.col("_cold") * (0.3 + 0.7 * F.col("availability"))).drop(
        "_pop", "_tr", "_m", "_bus", "_bl", "_cs", "_s", "_cold")


def co_purchase_graph(order_lines: DataFrame, k: int = 12) -> DataFrame:
    """Lift-weighted co-purchase edges, top-k per item.

    weight = log1p(n_ab) * min(n_ab * N / (n_a * n_b), 25)
    """
    baskets = materialise(group_items(order_lines, "order_id", "product_id"), "baskets")  # read by counts, total and pairs
    counts = baskets.groupBy("product_id").agg(F.count("*").alias("n"))
    total = baskets.agg(F.count_distinct("order_id")).scalar()
    # pairs carry their items' counts: there are more pairs than items of baskets, and none is joined again
    pairs = item_pairs(baskets.join(counts, "product_id"), "order_id", "product_id", ["n"]).groupBy("a", "b").agg(
        F.count("*").alias("n_ab"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    lift = F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))
    weighted = pairs.select("a", "b", (F.log1p("n_ab") * F.least(lift, F.lit(25.0))).alias("weight"))
    return top_k(both_directions(weighted, "weight"), ["src"], [F.round("weight", 6).desc(), F.col("dst")], k)


def bought_together(graph: DataFrame, order_lines: DataFrame, k: int = 5) -> DataFrame:
    """Model edges where an item has any, otherwise counted co-purchases over the orders that hold such an item."""
    from shoplattice.operators.analytics import co_purchase_counts
    model = materialise(graph.where((F.col("weight") > 0) & (F.col("rank") <= k)).select(
        F.col("src").alias("product_id"), F.col("dst").alias("other_id"), F.col("weight").alias("score"), "rank",
        F.lit("co_purchase_model").alias("strategy")), "bought-together")
    unknown = materialise(order_lines.select("product_id").distinct().join(model.select("product_id").distinct(), "product_id", "left_anti"), "without-edges")
    if unknown.isEmpty():
        return model
    orders = order_lines.join(unknown, "product_id", "left_semi").select("order_id").distinct()
    fallback = co_purchase_counts(order_lines.join(orders, "order_id", "left_semi"), k)
    rest = fallback.join(unknown, "product_id", "left_semi").select(
        "product_id", "other_id", "score", "rank", F.lit("co_purchase_sql").alias("strategy"))
    return model.unionByName(rest)


def cold_start_items(signals: DataFrame, k: int = 10, per_category: bool = False) -> DataFrame:
    live = signals.where(F.col("cold_start") > 0).select("id", "category_id", "cold_start")
    order = [F.round("cold_start", 6).desc(), F.col("id")]
    if per_category:
        return top_k(live, ["category_id"], order, k)
    return top_k(live.orderBy(*order).limit(k).withColumn("_g", F.lit(1)), ["_g"], order, k).drop("_g")


def _head(ranking: DataFrame, scope: list[str], length: Column | int) -> DataFrame:
    """The first products of each scope's ranking (product_id, pos) as one array."""
    near = ranking.where(F.col("pos") <= length)
    return near.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "product_id"))), lambda r: r["product_id"]).alias("head"))


def served_lists(
    users: DataFrame, model: DataFrame, cold_category: DataFrame, cold: DataFrame, popular: DataFrame, exclude: DataFrame, k: int = 10,
) -> DataFrame:
    """(user_id, rank, product_id, strategy): ``k`` products for every user (user_id, strategy, category_id), if there are so many.

    Users of the hybrid strategy start with their own list ``model`` (user_id, product_id, rank), others with the cold-start
    ranking of their favourite category, ``cold_category`` (category_id, product_id, pos). What an arm leaves open the next
    one fills: ``cold`` (product_id, pos), then ``popular``. No arm repeats a product or gives one of ``exclude``.

    A user with s excluded products finds k among the first s + 2 k of a ranking, so only that much of each is packed; a
    user's excluded products and lists are bounded by the user's history.
    """
    gone = exclude.groupBy("user_id").agg(F.collect_set("product_id").alias("gone"))
    longest = gone.agg(F.coalesce(F.max(F.size("gone")), F.lit(0)) + 2 * k).scalar()
    own = model.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]).alias("own"))
    none = F.array().cast("array<bigint>")
    rows = users.join(gone, "user_id", "left").join(own, "user_id", "left").join(
        _head(cold_category, ["category_id"], longest).withColumnRenamed("head", "near"), "category_id", "left").withColumns({
            "gone": F.coalesce("gone", none), "own": F.when(F.col("strategy") == "hybrid", F.coalesce("own", none)).otherwise(none),
            "near": F.when(F.col("strategy") == "hybrid", none).otherwise(F.coalesce("near", none)),
            "cold": F.coalesce(_head(cold, [], longest).select("head").scalar(), none), "popular": F.coalesce(_head(popular, [], longest).select("head").scalar(), none)})
    free = lambda head, *taken: F.array_except(head, F.concat("gone", *taken))
    rows = rows.withColumn("a1", F.slice(free("own"), 1, k))
    rows = rows.withColumn("a2", F.slice(free(F.concat("near", "cold"), "a1"), F.lit(1), k - F.size("a1")))
    rows = rows.withColumn("a3", F.slice(free("popular", "a1", "a2"), F.lit(1), k - F.size("a1") - F.size("a2")))
    labelled = lambda name: lambda p: F.struct(p.alias("product_id"), F.lit(name).alias("strategy"))
    tagged = [F.transform(arm, labelled(name)) for arm, name in (("a1", "hybrid"), ("a2", "cold_start"), ("a3", "popularity_fallback"))]
    return rows.select("user_id", F.posexplode(F.concat(*tagged)).alias("at", "p")).select(
        "user_id", (F.col("at") + 1).alias("rank"), "p.product_id", "p.strategy")


def continue_shopping(cart: DataFrame, viewed: DataFrame, similar: DataFrame, k: int = 8) -> DataFrame:
    """(user_id, product_id, rank, origin): what is left in the cart, then items like the one viewed last, ``k`` in all.

    ``cart`` is (user_id, product_id, rank), ``viewed`` (user_id, product_id, position), ``similar`` (id, product_id, rank).
    As each rail of the page is read by itself, a similar item may also be in the cart. The list of similar items is one
    row per product, and users meet it in salted parts, as many may have viewed the same product last.
    """
    kept = cart.where(F.col("rank") <= k).select("user_id", "product_id", "rank", F.lit("cart").alias("origin"))
    taken = kept.groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    last = viewed.where("position = 1").select("user_id", F.col("product_id").alias("id")).join(taken, "user_id", "left")
    likes = similar.where(F.col("rank") <= k).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("likes"))
    met = salted_join(last.where(F.coalesce("n", F.lit(0)) < k), likes, ["id"], "user_id")
    fill = met.select("user_id", F.coalesce("n", F.lit(0)).alias("n"), F.explode("likes").alias("s")).select(
        "user_id", "s.product_id", (F.col("s.rank") + F.col("n")).alias("rank"), F.lit("similar").alias("origin"))
    return kept.unionByName(fill.where(F.col("rank") <= k))


def trending_items(signals: DataFrame, k: int = 10) -> DataFrame:
    damped = F.col("trending") * (0.3 + 0.7 * F.col("availability"))
    order = [F.round(damped, 6).desc(), F.col("id")]
    best = signals.select("id", "trending", "availability").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))


# ---- user signals ----------------------------------------------------------
def user_history(events: DataFrame, n: int = 60) -> DataFrame:
    """Newest ``n`` positive interactions per user; ``recency`` 1 is the newest."""
    rows = usable_events(events).where(F.col("event_type").isin(*POSITIVE)).select("user_id", "product_id", "occurred_at", "id")
    return top_k(rows, ["user_id"], [F.col("occurred_at").desc(), F.col("id").desc()], n, rank="recency")


def item_cf_raw(history: DataFrame, neighbours: DataFrame, seeds: int = 25) -> DataFrame:
    """Sum of neighbour similarity over the last seeds (sparse: untouched items are zero)."""
    s = history.where(F.col("recency") <= seeds).groupBy("user_id", F.col("product_id").alias("src")).agg(F.count("*").alias("times"))
    return s.join(neighbours, "src").groupBy("user_id", F.col("dst").alias("product_id")).agg(
        F.sum(F.col("similarity") * F.col("times")).alias("raw"))


def item_cf_scores(history: DataFrame, neighbours: DataFrame, n_items: int | Column, seeds: int = 25) -> DataFrame:
    """Min-max scaled item-CF; items nobody points at count as zero in the minimum."""
    raw = item_cf_raw(history, neighbours, seeds)
    span = raw.groupBy("user_id").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"), F.count("*").alias("_n"))
    lo = F.when(F.col("_n") < n_items, F.least(F.col("_lo"), F.lit(0.0))).otherwise(F.col("_lo"))
    return raw.join(span, "user_id").select("user_id", "product_id", minmax(F.col("raw"), lo, F.col("_hi")).alias("score"))


def seed_vectors(history: DataFrame, vectors: DataFrame, seeds: int = 25) -> DataFrame:
    """Unit-length sum of the seed items' vectors per user, of which there are at most ``seeds``, in order of id."""
    s = history.where(F.col("recency") <= seeds).groupBy("user_id", F.col("product_id").alias("id")).agg(F.count("*").alias("times"))
    few = s.join(vectors.select("id", "vector"), "id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "times", "vector"))).alias("seeds"))
    add = lambda a, x: F.zip_with(a, x["vector"], lambda p, v: F.coalesce(p, F.lit(0.0)) + F.coalesce(v.cast("double"), F.lit(0.0)) * x["times"])
    packed = few.select("user_id", F.aggregate("seeds", F.array().cast("array<double>"), add).alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return packed.withColumn("_n", norm).where("_n > 0").select(
        F.col("user_id").alias("id"), F.transform("v", lambda x: x / F.col("_n")).alias("vector"))


def content_topk(history: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """Best content matches per user with the score scaled over the whole catalogue."""
    profile = materialise(seed_vectors(history, vectors), "profiles")
    part = materialise(block_best(profile, vectors, k, least=True), "content-best")
    best = top_k(part.where("id IS NOT NULL").select("query_id", "id", "score"), ["query_id"], [F.round("score", 6).desc(), F.col("id")], k)
    worst = part.where("id IS NULL").groupBy("query_id").agg(F.min("score").alias("_lo"))
    hi = F.max("score").over(W.partitionBy("query_id"))
    return best.join(worst, "query_id").withColumn("_hi", hi).select(
        F.col("query_id").alias("user_id"), F.col("id").alias("product_id"),
        minmax(F.col("score"), F.col("_lo"), F.col("_hi")).alias("score"), "rank")


def personal_scores(category: DataFrame, brand: DataFrame, products: DataFrame) -> DataFrame:
    """Non-zero .65 category + .35 brand affinity per (user, category, brand) combination, unscaled.

    Affinity depends on a product only through its category and brand, so it is
    kept at that grain instead of one row per user and product.
    """
    combos = products.select("category_id", "brand_id").distinct()
    c = category.join(combos, "category_id").select("user_id", "category_id", "brand_id", (0.65 * F.col("affinity")).alias("p"))
    b = brand.join(combos, "brand_id").select("user_id", "category_id", "brand_id", (0.35 * F.col("affinity")).alias("p"))
    return c.unionByName(b).groupBy("user_id", "category_id", "brand_id").agg(F.sum("p").alias("personal"))


def personal_scaled(category: DataFrame, brand: DataFrame, products: DataFrame) -> DataFrame:
    """Min-max scaled personal score per (user, category, brand); absent combinations are zero before scaling."""
    raw = personal_scores(category, brand, products)
    n_combos = products.select("category_id", "brand_id").distinct().agg(F.count("*")).scalar()
    span = raw.groupBy("user_id").agg(F.min("personal").alias("_lo"), F.max("personal").alias("_hi"), F.count("*").alias("_n"))
    lo = F.when(F.col("_n") < n_combos, F.least(F.col("_lo"), F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(F.col("_n") < n_combos, F.greatest(F.col("_hi"), F.lit(0.0))).otherwise(F.col("_hi"))
    return raw.join(span, "user_id").select("user_id", "category_id", "brand_id", minmax(F.col("personal"), lo, hi).alias("score"))


def residualise(df: DataFrame, group: str, component: str, base: str, out: str) -> DataFrame:
    """Remove the least-squares projection of ``base`` from ``component`` per group and rescale.

    Moments are a partial aggregate joined back, so no group is windowed whole.
    """
    m = df.groupBy(group).agg(F.covar_pop(component, base).alias("_cov"), F.var_pop(base).alias("_var"), F.count("*").alias("_n"))
    flat = F.col("_var") * F.col("_n") < 1e-9
    r = df.join(m, group).withColumn("_r", F.when(flat, F.col(component)).otherwise(
        F.col(component) - F.col("_cov") / F.col("_var") * F.col(base))).withColumn("_flat", flat)
    span = r.groupBy(group).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    scaled = F.when(F.col("_flat"), F.col(component)).otherwise(minmax(F.col("_r"), F.col("_lo"), F.col("_hi")))
    return r.join(span, group).withColumn(out, scaled).drop("_cov", "_var", "_n", "_r", "_flat", "_lo", "_hi")


# ---- latent factors --------------------------------------------------------
def latent_factors(matrix: DataFrame, rank: int = 32, seed: int = 42, iterations: int = 8) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) by implicit ALS: distributed on both sides, no dense item matrix."""
    from pyspark.ml.recommendation import ALS
    als = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, userCol="user_id", itemCol="product_id", ratingCol="weight",
              seed=seed, coldStartStrategy="drop", checkpointInterval=5)
    model = als.fit(matrix.select(F.col("user_id").cast("int"), F.col("product_id").cast("int"), "weight"))
    cols = [F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("vector")]
    return model.userFactors.select(*cols), model.itemFactors.select(*cols)


# ---- hybrid for every user -------------------------------------------------
USER_SCHEMA = "user_id long, latent array<double>, profile array<double>, cf map<long,double>, personal map<string,double>, history array<long>"


def user_inputs(users: DataFrame, user_factors: DataFrame, history: DataFrame, neighbours: DataFrame, vectors: DataFrame,
                category: DataFrame, brand: DataFrame, products: DataFrame) -> DataFrame:
    """One row per user holding everything its scores need; all parts are bounded per user.

    History keeps 60 rows, item-CF at most 25 seeds x 50 neighbours, personal one value per (category, brand).
    """
    cf = item_cf_raw(history, neighbours).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("product_id", "raw"))).alias("cf"))
    pers = personal_scores(category, brand, products).groupBy("user_id").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("|", "category_id", "brand_id"), "personal"))).alias("personal"))
    hist = history.groupBy("user_id").agg(F.collect_set("product_id").alias("history"))
    prof = seed_vectors(history, vectors).select(F.col("id").alias("user_id"), F.col("vector").alias("profile"))
    lat = user_factors.select(F.col("id").alias("user_id"), F.col("vector").alias("latent"))
    out = users.select("user_id")
    for part in (lat, prof, cf, pers, hist):
        out = out.join(part, "user_id", "left")
    return out


def _missing(v: object) -> bool:
    return v is None or (isinstance(v, float) and np.isnan(v))


def _width(*cols: pd.Series) -> int:
    """Length of the vectors of two sides; a block of one side may hold none."""
    return next((len(v) for col in cols for v in col if not _missing(v)), 1)


def _matrix(col: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.zeros(width) if _missing(v) else np.asarray(v, float) for v in col])


def _entries(maps: pd.Series) -> tuple[np.ndarray, list, np.ndarray]:
    """Row, key and value of every entry of a column of maps."""
    tables = [{} if m is None else dict(m) for m in maps]
    row = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    return row, [k for t in tables for k in t], np.array([v for t in tables for v in t.values()], float)


def _spread(entries: tuple[np.ndarray, list, np.ndarray], rows: int, keys: pd.Index) -> np.ndarray:
    """The entries as a matrix with a column a key; zero where there is none."""
    row, found, values = entries
    out, at = np.zeros((rows, len(keys))), keys.get_indexer(found) if found else np.zeros(0, int)
    out[row[at >= 0], at[at >= 0]] = values[at >= 0]
    return out


def _raw_components(us: pd.DataFrame, cf: tuple, personal: tuple, it: pd.DataFrame) -> dict[str, np.ndarray]:
    """Unscaled latent, item-CF, content and personal scores of some users, with the entries of their maps, and some items."""
    f, d = _width(it.latent, us.latent), _width(it.content, us.profile)
    code, combos = pd.factorize(it.combo)
    return {"latent": _matrix(us.latent, f) @ _matrix(it.latent, f).T, "cf": _spread(cf, len(us), pd.Index(it.id)),
            "content": _matrix(us.profile, d) @ _matrix(it.content, d).T, "personal": _spread(personal, len(us), pd.Index(combos))[:, code]}


def _scale(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    width = (hi - lo)[:, None]
    return np.where(width < 1e-9, 0.0, (x - lo[:, None]) / np.where(width < 1e-9, 1.0, width))


def contenders(items: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The items that can be among the best ``k`` of some user, or tell the extremes and moments of a component from zero.

    An item without factors and vector that is in nobody's history or item-CF scores differs from others of the same blend,
    availability and combo by its business value alone. If ``k`` of these have no less of it and a smaller id, they come
    before it for every user, whatever the weights, as long as business doesn't count against a product. Each such group
    keeps the others, some item at least, so that the extremes stay; to sums its items only add zeros.
    """
    met = users.select(F.explode("history").alias("id")).union(users.select(F.explode(F.map_keys("cf")).alias("id"))).distinct()
    marked = materialise(items.join(met.withColumn("_met", F.lit(True)), "id", "left"), "marked-items")
    odd = [F.col(c).isNull() | F.isnan(c) for c in ("blend", "business", "availability")]
    alike = ["blend", "availability", "combo"]
    plain = F.col("_met").isNull() & F.col("latent").isNull() & F.col("content").isNull() & F.col("combo").isNotNull() & ~(odd[0] | odd[1] | odd[2])
    plain &= F.col("availability") >= 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, least = None, []  # the k smallest ids so far, negated
        for pdf in batches:
            kept = np.zeros(len(pdf), bool)
            for at, (key, number) in enumerate(zip(zip(*(pdf[c] for c in (*alike, "_part"))), pdf["id"])):
                if key != now:
                    now, least = key, []
                if len(least) < k:
                    heapq.heappush(least, -number)
                    kept[at] = True
                elif number < -least[0]:
                    heapq.heapreplace(least, -number)
                    kept[at] = True
            yield pdf[kept]

    rows = marked.where(plain).select("id", "business", *alike)
    for parts in sorted({max(1, -(-rows.count() // GROUP_ROWS)), 1}, reverse=True):  # a large group in parts first
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(*alike, "_part")
        rows = dealt.sortWithinPartitions(*alike, "_part", F.col("business").desc(), "id").mapInPandas(run, dealt.schema).drop("_part")
    few = rows.select(F.col("id").alias("_id")).distinct()
    return marked.join(few, marked.id == few._id, "left").where(~plain | F.col("_id").isNotNull()).select(*items.columns)


def hybrid_topk(user_rows: DataFrame, item_rows: DataFrame, k: int = 10, weights: Mapping[str, float] | None = None,
                block_rows: int = 1024, grid: Sequence[Mapping[str, float]] | None = None) -> DataFrame:
    """Exact hybrid top-k with component breakdown for every user row.

    Pass 1 gathers per-user extremes and popularity moments of the raw
    components, pass 2 the extremes after popularity is projected out, pass 3
    blends and keeps k rows per user and tile. Between passes only a few
    numbers per user move. A ``grid`` of weight vectors is ranked in the same
    third pass and adds ``grid_id``. Only ``contenders`` are met. Users and
    items are dealt into tiles of up to 4 and 16 times ``block_rows``, so that
    a row is sent few times, and a tile is worked in small steps.
    """
    options = [{**RECOMMENDER_WEIGHTS, **w} for w in (grid or [weights or {}])]
    pop = item_rows.agg(F.avg("blend").alias("m"), (F.var_pop("blend") * F.count("*")).alias("s")).first()
    pop_mean, pop_ss = float(pop["m"] or 0.0), float(pop["s"] or 0.0)
    if all(w["business"] >= 0 for w in options):
        item_rows = materialise(contenders(item_rows, user_rows, k), "contenders")
    nu, ni = user_rows.count(), item_rows.count()
    ub = max(1, -(-nu // (4 * block_rows)), min(-(-nu // block_rows), 16))
    ib = max(1, -(-ni // (16 * block_rows)), min(-(-ni // (4 * block_rows)), 2))
    user_step, item_step = max(1, block_rows // 4), 2 * block_rows

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(3 * ub * ib, "ub", "ib").groupBy("ub", "ib")

    blocks_i = item_rows.select("*", F.pmod(F.xxhash64("id"), F.lit(ib)).alias("ib")).withColumn(
        "ub", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ub - 1).cast("long"))))

    def users_with(extra: DataFrame | None) -> DataFrame:
        u = user_rows if extra is None else user_rows.join(extra, "user_id")
        return u.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(ub))).withColumn(
            "ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ib - 1).cast("long"))))

    def run(extra: DataFrame | None, fn, schema: str, closing=lambda pdf: pdf) -> DataFrame:
        def tile(us: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
            out = []
            for begin in range(0, len(us) if len(it) else 0, user_step):
                some = us.iloc[begin:begin + user_step]
                cf, personal = _entries(some.cf), _entries(some.personal)
                out.append(closing(pd.concat([fn(some, part, _raw_components(some, cf, personal, part)) for part in (
                    it.iloc[at:at + item_step] for at in range(0, len(it), item_step))])))
            return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

        return dealt(users_with(extra)).cogroup(dealt(blocks_i)).applyInPandas(tile, schema)

    names = ("latent", "cf", "content", "personal")

    def first(us: pd.DataFrame, it: pd.DataFrame, raw: dict[str, np.ndarray]) -> pd.DataFrame:
        b = it.blend.to_numpy() - pop_mean
        out = {"user_id": us.user_id.to_numpy()}
        for n in names:
            out |= {f"lo_{n}": raw[n].min(1), f"hi_{n}": raw[n].max(1), f"sp_{n}": raw[n] @ b}
        return pd.DataFrame(out)

    schema1 = "user_id long, " + ", ".join(f"{a}_{n} double" for n in names for a in ("lo", "hi", "sp"))
    m1 = run(None, first, schema1).groupBy("user_id").agg(*[
        {"lo": F.min, "hi": F.max, "sp": F.sum}[a](f"{a}_{n}").alias(f"{a}_{n}") for n in names for a in ("lo", "hi", "sp")])

    def mixed(us: pd.DataFrame, it: pd.DataFrame, raw: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Collaborative and content after residualisation but before the last scaling; personal scaled."""
        col = lambda c: us[c].to_numpy(float)
        lat = _scale(raw["latent"], col("lo_latent"), col("hi_latent"))
        cf = _scale(raw["cf"], col("lo_cf"), col("hi_cf"))
        seeded = np.array([h is not None and len(h) > 0 for h in us.history])
        coll = np.where(seeded[:, None], 0.6 * lat + 0.4 * cf, lat)
        cont = _scale(raw["content"], col("lo_content"), col("hi_content"))
        width = lambda n: np.where(col(f"hi_{n}") - col(f"lo_{n}") < 1e-9, np.inf, col(f"hi_{n}") - col(f"lo_{n}"))
        if pop_ss >= 1e-9:
            b_lat, b_cf = col("sp_latent") / width("latent"), col("sp_cf") / width("cf")
            beta = np.where(seeded, 0.6 * b_lat + 0.4 * b_cf, b_lat) / pop_ss
            blend = it.blend.to_numpy()
            coll = coll - beta[:, None] * blend
            cont = cont - (col("sp_content") / width("content") / pop_ss)[:, None] * blend
        return coll, cont, _scale(raw["personal"], col("lo_personal"), col("hi_personal"))

    def second(us: pd.DataFrame, it: pd.DataFrame, raw: dict[str, np.ndarray]) -> pd.DataFrame:
        coll, cont, _ = mixed(us, it, raw)
        return pd.DataFrame({"user_id": us.user_id.to_numpy(), "lo_coll": coll.min(1), "hi_coll": coll.max(1),
                             "lo_cont": cont.min(1), "hi_cont": cont.max(1)})

    m2 = run(m1, second, "user_id long, lo_coll double, hi_coll double, lo_cont double, hi_cont double").groupBy("user_id").agg(
        F.min("lo_coll").alias("lo_coll"), F.max("hi_coll").alias("hi_coll"), F.min("lo_cont").alias("lo_cont"), F.max("hi_cont").alias("hi_cont"))
    parts = ("collaborative", "content", "popularity", "personalization", "business")

    def third(us: pd.DataFrame, it: pd.DataFrame, raw: dict[str, np.ndarray]) -> pd.DataFrame:
        coll, cont, pers = mixed(us, it, raw)
        coll = _scale(coll, us.lo_coll.to_numpy(float), us.hi_coll.to_numpy(float))
        cont = _scale(cont, us.lo_cont.to_numpy(float), us.hi_cont.to_numpy(float))
        blend, bus, ids = it.blend.to_numpy(), it.business.to_numpy(), it.id.to_numpy()
        damp = (0.35 + 0.65 * it.availability.to_numpy())[None, :]
        seen = np.stack([np.isin(ids, list(h)) if h is not None else np.zeros(len(ids), bool) for h in us.history])
        n, few, who = len(ids), min(k, len(ids)), us.user_id.to_numpy()
        after = np.argsort(np.argsort(-ids))  # of equal scores the smaller id comes first
        frames = []
        for g, w in enumerate(options):
            score = (w["collaborative"] * coll + w["content"] * cont + w["popularity"] * blend[None, :]
                     + w["personalization"] * pers + w["business"] * bus[None, :]) * damp
            key = np.where(seen, -(1 << 62), np.rint(np.round(score, 6) * 1e6).astype(np.int64) * n + after[None, :])
            best = np.argpartition(-key, few - 1, axis=1)[:, :few] if few < n else np.broadcast_to(np.arange(n), key.shape)
            row = np.broadcast_to(np.arange(len(us))[:, None], best.shape)
            open_ = ~seen[row, best]
            row, best = row[open_], best[open_]
            frames.append(pd.DataFrame({
                "grid_id": g, "user_id": who[row], "product_id": ids[best], "score": score[row, best], "collaborative": coll[row, best],
                "content": cont[row, best], "popularity": blend[best], "personalization": pers[row, best], "business": bus[best]}))
        return pd.concat(frames)

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best ``k`` of all steps for each user and weight vector."""
        order = np.lexsort((pdf.product_id, -np.round(pdf.score, 6), pdf.user_id, pdf.grid_id))
        pdf = pdf.iloc[order]
        return pdf[pdf.groupby(["grid_id", "user_id"], sort=False).cumcount() < k]

    schema3 = "grid_id int, user_id long, product_id long, score double, " + ", ".join(f"{p} double" for p in parts)
    best = run(m1.join(m2, "user_id"), third, schema3, leading)
    ranked = top_k(best, ["grid_id", "user_id"], [F.round("score", 6).desc(), F.col("product_id")], k)
    return ranked if grid else ranked.drop("grid_id")


def item_inputs(signals: DataFrame, item_factors: DataFrame, vectors: DataFrame) -> DataFrame:
    lat = item_factors.select("id", F.col("vector").alias("latent"))
    con = vectors.select("id", F.col("vector").cast("array<double>").alias("content"))
    return signals.select("id", "blend", "business", "availability", F.concat_ws("|", "category_id", "brand_id").alias("combo")).join(
        lat, "id", "left").join(con, "id", "left")


def explain_components(cols: Mapping[str, str] = RECOMMENDER_REASONS) -> Column:
    """Top-two reasons above .05."""
    return top_labels([(F.col(c), label) for c, label in cols.items()], 2, 0.05, "Recommended because ",
                      "Recommended based on overall store trends")


def similar_items(vectors: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """.5 content + .35 behaviour + .15 same category for every item with a vector, exact.

    Items without a behavioural link are ranked by content plus a category
    bonus alone, so the best k of that ranking and the (at most 50) linked items
    contain the answer; the linked ones are scored directly. As the bonus isn't
    negative, that ranking's best are among the best of all and those of the
    item's own category, which one pass gathers with the least content score.
    """
    part = materialise(block_best(vectors, vectors, k + 10, exclude_self=True, group="category_id", least=True), "similar-best")
    lows = part.where("id IS NULL").groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("c_lo"))
    v = vectors.join(lows, "id").withColumn("c_hi", dot("vector", "vector"))
    raised = part.where("id IS NOT NULL").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "score", "own").join(
        v.select("id", (0.3 * (F.col("c_hi") - F.col("c_lo"))).alias("bonus")), "id")
    best = raised.groupBy("id", "other").agg(F.max(F.col("score") + F.when(F.col("own"), F.col("bonus")).otherwise(0.0)).alias("score"))
    plain = top_k(best, ["id"], [F.round("score", 6).desc(), F.col("other")], k + 10).select("id", "other")
    edges = neighbours.select(F.col("src").alias("id"), F.col("dst").alias("other"), "similarity")
    span = edges.groupBy("id").agg(F.min("similarity").alias("_bl"), F.max("similarity").alias("b_hi"), F.count("*").alias("_bn"))
    n_items = vectors.agg(F.count("*")).scalar()
    other = vectors.select(F.col("id").alias("other"), F.col("vector").alias("v2"), F.col("category_id").alias("c2"))
    scored = plain.unionByName(edges.select("id", "other")).distinct().join(v, "id").join(other, "other").join(
        edges, ["id", "other"], "left").join(span, "id", "left")
    b_lo = F.when(F.col("_bn") < n_items, F.least(F.col("_bl"), F.lit(0.0))).otherwise(F.col("_bl"))
    behaviour = F.coalesce(minmax(F.coalesce("similarity", F.lit(0.0)), b_lo, F.col("b_hi")), F.lit(0.0))
    final = (0.5 * minmax(dot("vector", "v2"), F.col("c_lo"), F.col("c_hi")) + 0.35 * behaviour
             + F.when(F.col("category_id") == F.col("c2"), 0.15).otherwise(0.0))
    return top_k(scored.select("id", F.col("other").alias("product_id"), final.alias("score")), ["id"],
                 [F.round("score", 5).desc(), F.col("product_id")], k)
