"""Hand-computed cases and invariants on tiny frames."""
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplattice.functions.grouped import best_unseen, block_topk, grouped_percentiles, item_pairs, numbered
from shoplattice.functions.scalars import minmax
from shoplattice.operators import catalog, evaluate, forecast, monitoring, personal, recommend, search, segments, sentiment


def recs(spark, items, user=1):
    return spark.createDataFrame([(user, r, i) for r, i in enumerate(items, 1)], "user_id long, rank int, product_id long")


def rel(spark, items, user=1):
    return spark.createDataFrame([(user, i) for i in items], "user_id long, product_id long")


def test_precision_and_recall(spark):
    row = evaluate.per_user_ranking(recs(spark, [1, 2, 3, 4, 5]), rel(spark, [2, 5, 9]), (5,)).first()
    assert row["precision"] == pytest.approx(0.4) and row["recall"] == pytest.approx(2 / 3)


def test_perfect_ranking(spark):
    row = evaluate.per_user_ranking(recs(spark, [1, 2, 3]), rel(spark, [1, 2, 3]), (3,)).first()
    assert row["ndcg"] == pytest.approx(1.0) and row["precision"] == 1.0


def test_coverage(spark):
    both = recs(spark, [1, 2], 1).union(recs(spark, [2, 3], 2))
    assert evaluate.catalogue_coverage(both, 10, 2).first()[0] == 0.3


def test_forecast_metrics(spark):
    m = evaluate.forecast_metrics(spark.createDataFrame([(10.0, 12.0), (10.0, 8.0)], "actual double, predicted double")).first()
    assert (m["mae"], m["rmse"], m["bias"]) == (2.0, 2.0, 0.0)
    z = evaluate.forecast_metrics(spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (5.0, 5.0)], "actual double, predicted double")).first()
    assert np.isfinite(z["mape"]) and np.isfinite(z["smape"])


def test_psi(spark):
    rng = np.random.default_rng(1)
    base = [(float(v),) for v in rng.normal(0, 1, 500)]
    df = spark.createDataFrame(base, "v double")
    assert evaluate.psi(df, df, "v").first()[0] == 0.0
    assert evaluate.psi(df, df.select((F.col("v") + 3).alias("v")), "v").first()[0] > 0.2
    assert evaluate.psi(df.limit(1), df.limit(1), "v").first()[0] == 0.0


def test_percentiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(2)
    data = [(1, float(v)) for v in rng.exponential(10, 900)] + [(2, 5.0)] * 40 + [(3, 1.5)]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in grouped_percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.75}).collect()}
    for g in (1, 2, 3):
        vals = [v for k, v in data if k == g]
        assert got[g] == pytest.approx((np.percentile(vals, 10), np.percentile(vals, 75)))


def test_item_pairs_split_a_giant_group(spark):
    rows = [(1, i) for i in range(60)] + [(2, 3), (2, 7)]
    df = spark.createDataFrame(rows, "g long, i long")
    pairs = [(r["a"], r["b"]) for r in item_pairs(df, "g", "i", block=8).collect()]
    want = [(a, b) for a in range(60) for b in range(a + 1, 60)] + [(3, 7)]
    assert sorted(pairs) == sorted(want)


def test_block_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vector array<double>")
    got = {}
    for r in block_topk(df, df, 3, block_rows=16, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    scores = vecs @ vecs.T
    np.fill_diagonal(scores, -np.inf)
    for q in range(50):
        assert [i for _, i in sorted(got[q])] == list(np.argsort(-scores[q])[:3])


def test_block_best_by_steps(monkeypatch):
    from shoplattice.functions import grouped
    monkeypatch.setattr(grouped, "STEP", 7)
    rng = np.random.default_rng(9)
    vecs = np.concatenate([rng.integers(-2, 3, (40, 3)).astype(float), [[np.nan, 0, 0]]])  # many ties, one score that isn't finite
    ids = rng.permutation(41)
    rows, found, got, least = grouped._best(ids, vecs, ids, vecs, 5, True)
    scores = np.round(vecs @ vecs.T, 6)
    for n in range(41):
        want = sorted((-s, i) for s, i in zip(scores[n], ids) if i != ids[n] and np.isfinite(s))[:5]
        assert list(zip(-got[rows == n], found[rows == n])) == want
        assert least[n] == min((s for s in scores[n] if np.isfinite(s)), default=np.inf)


def test_similar_items_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 3 if i else None) for i, v in enumerate(vecs)], "id long, vector array<double>, category_id int")
    edges = spark.createDataFrame([(1, 9, 0.5), (1, 40, 0.25), (2, 1, 0.75)], "src long, dst long, similarity double")
    got = {}
    for r in recommend.similar_items(df, edges, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["product_id"])
    dots = vecs @ vecs.T
    near = {(1, 9): 1.0, (1, 40): 0.5, (2, 1): 1.0}
    for n in range(60):
        content = (dots[n] - dots[n].min()) / (dots[n, n] - dots[n].min())
        scores = [0.5 * content[i] + 0.35 * near.get((n, i), 0.0) + 0.15 * (n > 0 and i > 0 and n % 3 == i % 3) for i in range(60)]
        assert got[n] == [i for _, i in sorted((-round(s, 5), i) for i, s in enumerate(scores) if i != n)[:4]]


def test_read_in_parts_follows_the_rows(spark):
    from shoplattice.session import materialise, read_in_parts
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = materialise(spark.range(32_000).repartition(32, "id"), "parts")
    assert df.select("id").rdd.getNumPartitions() < 16
    with read_in_parts(df, 2_000):
        inside = df.select("id")
        assert inside.rdd.getNumPartitions() >= 16 and inside.count() == 32_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == size


def test_minmax_flavours(spark):
    one = spark.range(1)
    five = F.lit(5.0)
    assert one.select(minmax(five, five, five), minmax(five, five, five, 1.0)).first()[:] == (0.0, 1.0)


def test_residualise(spark):
    df = spark.createDataFrame([(1, 2.0 * b, float(b), float((b * 7) % 5)) for b in range(10)], "g int, c double, b double, o double")
    same = recommend.residualise(df, "g", "c", "b", "r").agg(F.stddev_pop("r")).first()[0]
    other = recommend.residualise(df, "g", "o", "b", "r").agg(F.stddev_pop("r")).first()[0]
    assert same < 1e-6 < other


def test_osa_and_typos(spark):
    pairs = spark.createDataFrame([("cat", "cat"), ("cat", "cut"), ("cat", "act")], "a string, b string")
    assert [r[0] for r in pairs.select(search.osa_distance("a", "b")).collect()] == [0, 1, 1]
    vocab = spark.createDataFrame([("headphones", 3), ("wireless", 2), ("speaker", 9)], "term string, df long")
    near = search.closest_terms(spark.createDataFrame([("headphnes",), ("wirless",)], "word string"), vocab)
    assert {(r["word"], r["term"]) for r in near.collect()} == {("headphnes", "headphones"), ("wirless", "wireless")}


def test_bm25_order_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "wireless headphones with noise cancelling"), (2, "wired earbuds"), (3, "laptop stand"), (4, "wireless mouse pad")], "id long, text string")
    q = spark.createDataFrame([(1, "wireless headphones"), (2, "zzz"), (3, "")], "query_id long, query string")
    got = search.bm25(q, docs).collect()
    score = {r["id"]: r["score"] for r in got if r["query_id"] == 1}
    assert score[1] > score[4] and {r["query_id"] for r in got} == {1}


def test_intent(spark):
    q = spark.createDataFrame([(1, "laptop under $500"), (2, "headphones below 100"), (3, "cheap case"), (4, "best camera")], "query_id long, query string")
    cats = spark.createDataFrame([(1, "laptops", "Laptops")], "id int, slug string, name string")
    r = {x["query_id"]: x for x in search.parse_intent(q, cats).collect()}
    assert r[1]["budget"] == 500 and r[2]["budget"] == 100 and r[3]["price_ascending"] and r[4]["quality_bias"]


def test_cosine_rules(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, vector array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "query_id long, vector array<double>")
    got = search.cosine_topk(q, v, 2).orderBy("rank").collect()
    assert got[0]["id"] == 1 and {r["query_id"] for r in got} == {10}
    only = search.cosine_topk(q, v, 2, spark.createDataFrame([(2,), (3,)], "id long")).collect()
    assert {r["id"] for r in only} <= {2, 3}


def test_cart_latest_event_wins(spark):
    e = spark.createDataFrame([(1, 1, 10, "add_to_cart", datetime(2024, 1, 1)), (2, 1, 10, "remove_from_cart", datetime(2024, 1, 2)),
                               (3, 1, 11, "remove_from_cart", datetime(2024, 1, 1)), (4, 1, 11, "add_to_cart", datetime(2024, 1, 3))],
                              "id long, user_id long, product_id long, event_type string, occurred_at timestamp")
    assert [r["product_id"] for r in personal.cart_state(e).collect()] == [11]


def test_aspects_on_real_sentences(spark):
    df = spark.createDataFrame([(1, "The sound is crisp with genuinely deep bass, but shipping took over three weeks with no updates.")], "id long, text string")
    got = {r["aspect"]: r["polarity"] for r in sentiment.review_aspects(sentiment.aspect_mentions(sentiment.clause_table(df))).collect()}
    assert got["sound_quality"] == "positive" and got["shipping"] == "negative"


def test_cluster_names_are_unique(spark):
    profiles = spark.createDataFrame([(i, *(float((i * 3 + j) % 5) for j in range(len(segments.SEGMENT_FEATURES)))) for i in range(5)],
                                     "cluster_id int, " + ", ".join(f"{f} double" for f in segments.SEGMENT_FEATURES))
    names = [r["segment_label"] for r in segments.name_clusters(profiles).collect()]
    assert len(names) == len(set(names)) == 5


def test_silhouette_falls_with_wrong_labels(spark):
    points = [(0, [0.0, 0.0]), (0, [0.1, 0.0]), (0, [0.0, 0.1]), (1, [5.0, 5.0]), (1, [5.1, 5.0]), (1, [5.0, 5.1])]
    right = spark.createDataFrame(points, "cluster_id int, z array<double>")
    wrong = spark.createDataFrame([(1 if i == 2 else c, z) for i, (c, z) in enumerate(points)], "cluster_id int, z array<double>")
    assert segments.silhouette(right) > 0.9 > segments.silhouette(wrong)
    swapped = spark.createDataFrame([(0, [0.0]), (0, [10.0]), (1, [1.0]), (1, [9.5])], "cluster_id int, z array<double>")
    assert segments.silhouette(swapped) < 0


def test_percentile_of_event_times(spark):
    """Sketches that meet in another order give other edges: both passes must use the same."""
    us = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    want = np.quantile(us.toPandas()["us"].to_numpy().astype(float), 0.85)
    assert grouped_percentiles(us, [], "us", {"cut": 0.85}).first()["cut"] == pytest.approx(want, abs=1)


def test_percentiles_with_an_outlier(spark):
    values = [float(n) for n in range(1000)] + [1e12]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = grouped_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert row["p50"] == 500.0 and row["p95"] == 950.0


def test_unseen_rankings(spark):
    products = spark.createDataFrame([(n * 7,) for n in range(1, 41)], "product_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    seen = spark.createDataFrame([(1, 7), (1, 21)] + [(2, n * 7) for n in range(1, 39)], "user_id long, product_id long")
    ranked = numbered(products, [F.col("product_id")])
    assert sorted(r["pos"] for r in ranked.collect()) == list(range(1, 41))
    got = {}
    for r in best_unseen(ranked, users, seen, 3).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["product_id"])
    assert got == {1: [14, 28, 35], 2: [273, 280], 3: [7, 14, 21]}
    drawn = {}
    for r in evaluate.random_unseen(products, users, seen, 5).collect():
        drawn.setdefault(r["user_id"], []).append(r["product_id"])
    assert {u: len(set(p)) for u, p in drawn.items()} == {1: 5, 2: 2, 3: 5} and sorted(drawn[2]) == [273, 280]
    assert all(p % 7 == 0 for ps in drawn.values() for p in ps) and not {7, 21} & set(drawn[1])


def test_weight_vectors_cover_the_grid(spark):
    vectors = evaluate.weight_vectors(spark)
    assert len(vectors) == 402 and len({tuple(sorted(v.items())) for v in vectors[2:]}) == 400
    assert all(abs(sum(v.values()) - 1) < 1e-4 for v in vectors[2:])
    assert evaluate.choose_weights({0: 0.5, 1: 0.5005, 2: 0.51}, vectors)[0] == 2


def test_k_rule_prefers_larger_k_within_tolerance():
    tried = [{"k": 4, "silhouette": 0.5}, {"k": 6, "silhouette": 0.45}, {"k": 8, "silhouette": 0.3}]
    assert segments.choose_k(tried)["k"] == 6


def test_promote(spark):
    reg = spark.createDataFrame([("m", "v1", "production"), ("m", "v2", "development")], "name string, version string, stage string")
    assert {r["version"]: r["stage"] for r in monitoring.promote(reg, "m", "v2").collect()} == {"v1": "archived", "v2": "production"}


def test_naive_forecast_bounds_and_length(spark):
    p = spark.createDataFrame([(1, 7.0, 7.0, {1: 1.0}, [7.0])], "product_id long, recent_mean double, overall_mean double, factors map<int,double>, tail array<double>")
    last = datetime(2024, 1, 1).date()
    rows = forecast.daily_forecast(forecast.naive_weekly(p, last, 5), last, 30).collect()
    assert len(rows) == 30 and all(r["lower"] <= r["predicted"] <= r["upper"] for r in rows)


def test_dominant_signal_without_signals(spark):
    assert spark.range(1).select(catalog.dominant_signal([])).first()[0] == "relevance"


def test_rates_stay_in_unit_interval(spark, tables):
    from shoplattice.plans.jobs import dashboard
    d = dashboard(tables)
    for section, cols in (("recommendation", ("ctr", "conversion_rate")), ("search", ("ctr", "zero_result_rate"))):
        row = d[section].first()
        assert all(0 <= row[c] <= 1 for c in cols)


def test_hybrid_ranking_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    users, items, k = 50, 80, 7
    combos = [f"{c}|{b}" for c in range(4) for b in range(3)]
    item_rows = [(int(i * 3), float(rng.random()), float(rng.random()), float(rng.integers(0, 2)), combos[rng.integers(12)],
                  rng.normal(size=4).tolist() if i % 9 else None, rng.normal(size=3).tolist()) for i in range(items)]
    user_rows = [(u, rng.normal(size=4).tolist() if u % 7 else None, rng.normal(size=3).tolist() if u % 5 else None,
                  {int(p): float(rng.random()) for p in rng.choice(items, 6, replace=False) * 3} if u % 3 else None,
                  {c: float(rng.random()) for c in combos[:5]} if u % 4 else None, [int(p) for p in rng.choice(items, 9, replace=False) * 3] if u % 6 else None) for u in range(users)]
    it = spark.createDataFrame(item_rows, "id long, blend double, business double, availability double, combo string, latent array<double>, content array<double>")
    us = spark.createDataFrame(user_rows, recommend.USER_SCHEMA)
    weights = {"collaborative": 0.4, "content": 0.3, "popularity": 0.2, "personalization": 0.1, "business": 0.05}
    got = {}
    for r in recommend.hybrid_topk(us, it, k, weights, block_rows=16).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["product_id"], round(r["score"], 6)))

    def scale(x):
        return np.zeros_like(x) if x.max() - x.min() < 1e-9 else (x - x.min()) / (x.max() - x.min())

    blend = np.array([r[1] for r in item_rows])

    def without_popularity(x):
        return scale(x - ((x - x.mean()) * (blend - blend.mean())).sum() / ((blend - blend.mean()) ** 2).sum() * blend)

    for u, latent, profile, cf, personal, history in user_rows:
        raw = [np.array([np.dot(latent, r[5]) if latent and r[5] else 0.0 for r in item_rows]), np.array([(cf or {}).get(r[0], 0.0) for r in item_rows]),
               np.array([np.dot(profile, r[6]) if profile else 0.0 for r in item_rows]), np.array([(personal or {}).get(r[4], 0.0) for r in item_rows])]
        lat, near, content, own = map(scale, raw)
        coll = without_popularity(0.6 * lat + 0.4 * near if history else lat)
        score = (0.4 * coll + 0.3 * without_popularity(content) + 0.2 * blend + 0.1 * own + 0.05 * np.array([r[2] for r in item_rows])) * (0.35 + 0.65 * np.array([r[3] for r in item_rows]))
        best = sorted((-round(float(s), 6), r[0]) for s, r in zip(score, item_rows) if r[0] not in (history or []))[:k]
        assert [i for i, _ in got[u]] == [i for _, i in best]
        assert all(abs(a + b) < 2e-6 for (_, a), (b, _) in zip(got[u], best))


def test_hybrid_ranking_with_item_blocks_without_vectors(spark):
    items = [(i, i / 40, 0.5, 1.0, "1|1", [1.0, 2.0] if i == 0 else None, [1.0, 0.0, 2.0] if i == 0 else None) for i in range(40)]
    it = spark.createDataFrame(items, "id long, blend double, business double, availability double, combo string, latent array<double>, content array<double>")
    us = spark.createDataFrame([(u, [0.5, 1.0], [1.0, 1.0, 0.0], None, None, None) for u in range(4)], recommend.USER_SCHEMA)
    one = recommend.hybrid_topk(us, it, 5)  # a single block
    cut = recommend.hybrid_topk(us, it, 5, block_rows=1)
    rows = lambda df: sorted((r["user_id"], r["rank"], r["product_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(cut) == rows(one) and len(rows(cut)) == 20


def test_counts_are_made_only_for_products_without_edges(spark, monkeypatch):
    from shoplattice.operators import analytics
    old = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 3), (3, 3), (3, 4), (4, 4), (4, 5), (5, 9)], "order_id long, product_id long")
    fresh = old.where("order_id < 3")
    rows = {tuple(r) for r in recommend.bought_together(recommend.co_purchase_graph(fresh), old, 5).where("strategy = 'co_purchase_sql'").collect()}
    counted = {tuple(r) for r in analytics.co_purchase_counts(old, 5).where("product_id > 3").select("product_id", "other_id", "score", "rank", F.lit("co_purchase_sql")).collect()}
    assert rows == counted and len(rows) == 3
    monkeypatch.setattr(analytics, "co_purchase_counts", None)
    assert recommend.bought_together(recommend.co_purchase_graph(fresh), fresh, 5).count() == 4


def test_percentiles_equal_sql_to_the_last_bit(spark):
    import duckdb
    rng = np.random.default_rng(3)
    rows = [(g, round(900 + int(p) / 10, 1)) for g in range(40) for p in rng.integers(0, 20000, g + 2)]
    got = {r["g"]: (r["a"], r["b"]) for r in grouped_percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.1, "b": 0.9}).collect()}
    for g, found in got.items():
        values = [v for n, v in rows if n == g]
        assert found == duckdb.connect().execute("SELECT quantile_cont(v, 0.1), quantile_cont(v, 0.9) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()[0]


def test_contenders_leave_the_hybrid_lists_as_they_are(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), float(rng.integers(0, 3)) / 4, float(rng.integers(0, 9)) / 9, float(rng.integers(0, 2)), f"{rng.integers(3)}|1",
             [1.0, float(i)] if i % 40 == 0 else None, [1.0, 0.0, float(i)] if i % 50 == 0 else None) for i in range(600)]
    it = spark.createDataFrame(rows, "id long, blend double, business double, availability double, combo string, latent array<double>, content array<double>")
    us = spark.createDataFrame([(u, [0.5, -0.01 * u], [1.0, 1.0, 0.1] if u else None, {7 * u: 0.5}, {"0|1": 0.3, "1|1": 0.1 * u}, [u, 3 * u + 1]) for u in range(6)], recommend.USER_SCHEMA)
    grid = [{"business": b, "popularity": p} for b in (0.0, 0.4) for p in (0.0, 0.3)]
    lists = lambda: sorted((r["grid_id"], r["user_id"], r["rank"], r["product_id"], round(r["score"], 9)) for r in recommend.hybrid_topk(us, it, 4, grid=grid).collect())
    monkeypatch.setattr(recommend, "GROUP_ROWS", 100)
    few = recommend.contenders(it, us, 4)
    assert few.columns == it.columns and 18 <= few.count() < 300
    got = lists()
    monkeypatch.setattr(recommend, "contenders", lambda items, users, k: items)
    assert got == lists() and len(got) == 4 * 6 * 4


def test_streams_run_in_several_batches(spark, tables):
    from shoplattice.streaming import events as ST
    from shoplattice.streaming import state as KS
    table = ST.run_to_table(KS.last_active(ST.replayed(tables.raw("events")), ST.LATENESS), "active", "update", keyed_state=True)
    assert table.select("batch_id").distinct().count() >= 3


def test_vocabulary_counts_documents_without_groups_of_ids(spark):
    docs = spark.createDataFrame([(1, "red red chair"), (2, "red lamp"), (3, None), (4, "")], "id long, text string")
    got = search.vocabulary(docs)
    assert sorted(map(tuple, got.collect())) == [("chair", 1), ("lamp", 1), ("red", 2)]
    groups = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys" in line]
    assert groups and all("keys=[term#" in line and "id#" not in line.split("functions")[0] for line in groups)


def test_panel_vectors_are_those_of_the_assembler(spark):
    """The dense vectors hold the columns in their order, also whole numbers, and NaN for what is unknown."""
    row = {c: (None if c.startswith("roll_std") else n * 1.5) for n, c in enumerate(forecast.FEATURES)} | {"on_promotion": 1, "month": 7}
    schema = ", ".join(f"{c} {'int' if c in ('on_promotion', 'month') else 'double'}" for c in forecast.FEATURES)
    got = forecast.assembled(spark.createDataFrame([tuple(row[c] for c in forecast.FEATURES)], schema)).first()["features"].toArray()
    assert np.array_equal(got, np.array([np.nan if row[c] is None else float(row[c]) for c in forecast.FEATURES]), equal_nan=True)


def test_a_fit_makes_one_weekly_panel(tables, monkeypatch):
    from shoplattice.plans import planning_queries
    made, weekly = [], forecast.weekly_panel
    monkeypatch.setattr(forecast, "weekly_panel", lambda *args: made.append(1) or weekly(*args))
    monkeypatch.setattr(forecast, "fit_residual", lambda train: None)
    planning_queries._fit_forecast(tables)
    assert made == [1]


def test_bm25_deals_documents_by_the_rows(spark, monkeypatch):
    """More rows are more parts, not larger ones; the ranking stays."""
    docs = spark.createDataFrame([(n, f"red chair number{n % 5} " + "lamp " * (n % 4)) for n in range(60)] + [(60, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "red lamp"), (2, "number3 chair chair"), (3, "absent"), (4, None)], "query_id long, query string")
    whole = search.bm25(asked, docs, 7).collect()
    monkeypatch.setattr(search, "TASK_ROWS", 20)
    parts = search.bm25(asked, docs, 7)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole)) and len(whole) == 14
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(query_id#") - plan.count("hashpartitioning(query_id#", plan.find("Initial Plan")) == 1


@pytest.mark.parametrize("repeats", [0, 8])
def test_item_pairs_leave_in_parts_that_follow_from_the_pairs(spark, monkeypatch, repeats):
    """Dealt by (a, b) where pairs seldom repeat, else combined before the shuffle; the counts are the same."""
    from collections import Counter
    from itertools import combinations
    from shoplattice.functions import grouped
    monkeypatch.setattr(grouped, "PAIR_ROWS", 20)
    monkeypatch.setattr(grouped, "PAIR_REPEATS", repeats)
    baskets = {g: sorted({(g * n) % 23 for n in range(1, 8)}) for g in range(1, 12)} | {12: [4], 13: list(range(30))}
    rows = [(g, i) for g, held in baskets.items() for i in held]
    lines = spark.createDataFrame(rows + rows[:9] + [(14, None)], "g long, i long")
    pairs = grouped.item_pairs(grouped.group_items(lines.where("i IS NOT NULL"), "g", "i"), "g", "i", block=8)
    want = Counter(p for held in baskets.values() for p in combinations(held, 2))
    assert {(r.a, r.b): r.n for r in pairs.groupBy("a", "b").agg(F.count("*").alias("n")).collect()} == want
    plan = pairs.groupBy("a", "b").count()._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-sum(want.values()) // 20)})" in plan and ("hashpartitioning(a#" in plan)
