"""Refreshed index, merged baselines, served lists, silhouette and panel against plain versions."""
import math
import random
import statistics

import numpy as np
import pytest

from pyspark.sql import functions as F
from shoplattice.operators import baselines as B, forecast as FC, index_store as IX, recommend as R, search as S, segments as SG
from shoplattice.session import work_dir
from shoplattice.sources.readers import daily_demand


def test_refreshed_index_equals_a_rebuild(spark, tables):
    corpus = S.product_text(tables.products)
    path, again, small = (work_dir(spark, label) for label in ("index", "rebuilt", "compacted"))
    IX.build(corpus, path)
    files = set(spark.read.parquet(f"{path}/postings").inputFiles())
    changed = corpus.where("id % 100 = 3").select("id", F.concat("text", F.lit(" zebra zebra")).alias("text"))
    added = spark.createDataFrame([(10 ** 6, "quite new zebra")], "id long, text string")
    IX.refresh(path, 1, changed.union(added), corpus.where("id % 100 = 4").select("id"))
    IX.refresh(path, 2, corpus.where("id = 103"), spark.createDataFrame([(10 ** 6,)], "id long"))
    assert files < set(spark.read.parquet(f"{path}/postings").inputFiles())  # nothing stored was rewritten
    now = corpus.where("id % 100 NOT IN (3, 4) OR id = 103").union(changed.where("id <> 103"))
    IX.build(now, again)
    IX.compact(spark, path, small)
    rows = lambda where: sorted(map(tuple, IX.live_postings(spark, where).collect()))
    assert rows(path) == rows(again) == rows(small)
    queries = spark.createDataFrame([(1, "zebra"), (2, "quite new"), (3, "the"), (4, corpus.first().text)], "query_id long, query string")
    want = {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in S.bm25(queries, now).collect()}
    assert want == {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in IX.search(spark, path, queries).collect()} and want


def test_search_reads_only_the_buckets_of_its_terms(spark, tables):
    path = work_dir(spark, "index")
    IX.build(S.product_text(tables.products), path)
    plan = IX.live_postings(spark, path, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan


def test_merged_baselines(spark):
    draw = random.Random(1)
    values = [draw.choice([0.0, draw.lognormvariate(2, 2), -draw.lognormvariate(0, 1)]) for _ in range(4000)]
    rows = spark.createDataFrame([(n, f"2024-01-{1 + n % 20:02d}", v) for n, v in enumerate(values)], "id long, at string, v double").withColumn("at", F.to_timestamp("at"))
    seen = lambda part: B.observations(part, "m", F.col("at"), {"v": F.col("v")})
    whole = B.sketch(seen(rows))
    halves = [B.sketch(seen(rows.where(f"id % 2 = {n}"))) for n in (0, 1)]
    merged = B.merge(*(halves[0][side].unionByName(halves[1][side]) for side in (0, 1)))
    of = lambda sketches: {r.statistic: r.value for r in B.statistics(*sketches).collect()}
    got, want = of(merged), of(B.merge(*whole))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    assert got["count"] == 4000 and math.isclose(got["mean"], statistics.mean(values)) and math.isclose(got["std"], statistics.stdev(values))
    assert got["zero_ratio"] == values.count(0.0) / 4000
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)):
        exact = sorted(values)[math.floor(q * 3999)]
        assert abs(got[name] - exact) <= B.WIDTH / 2 * abs(exact) * 1.01 + 1e-12


@pytest.mark.parametrize("seed", [1, 2])
def test_served_lists_against_a_plain_merge(spark, seed):
    draw = random.Random(seed)
    products, k = list(range(30)), 6
    users = [(u, draw.choice(["hybrid", "cold_start"]), draw.choice([None, 1, 2, 9])) for u in range(40)]
    own = {u: draw.sample(products, draw.randint(0, 8)) for u, _, _ in users}
    cold = {c: draw.sample(products, 5) for c in (1, 2)}
    general, popular = draw.sample(products, 7), draw.sample(products, 25)
    gone = {u: set(draw.sample(products, draw.randint(0, 12))) for u, _, _ in users[5:]}
    place = lambda items: [(p, n) for n, p in enumerate(items, 1)]
    got = R.served_lists(
        spark.createDataFrame(users, "user_id long, strategy string, category_id long"),
        spark.createDataFrame([(u, p, n) for u, items in own.items() for p, n in place(items)], "user_id long, product_id long, rank int"),
        spark.createDataFrame([(c, p, n) for c, items in cold.items() for p, n in place(items)], "category_id long, product_id long, pos int"),
        spark.createDataFrame(place(general), "product_id long, pos int"), spark.createDataFrame(place(popular), "product_id long, pos int"),
        spark.createDataFrame([(u, p) for u, items in gone.items() for p in items], "user_id long, product_id long"), k).collect()
    want = {}
    for u, strategy, category in users:
        arms = [("hybrid", own[u] if strategy == "hybrid" else []), ("cold_start", cold.get(category, []) if strategy == "cold_start" else []),
                ("cold_start", general), ("popularity_fallback", popular)]
        for name, items in arms:
            for p in items:
                served = want.setdefault(u, [])
                if len(served) < k and p not in gone.get(u, ()) and p not in [x for x, _ in served]:
                    served.append((p, name))
    found = {}
    for r in sorted(got, key=lambda r: (r.user_id, r["rank"])):
        found.setdefault(r.user_id, []).append((r.product_id, r.strategy))
    assert found == want and {name for items in want.values() for _, name in items} == {"hybrid", "cold_start", "popularity_fallback"}


def test_pairwise_silhouette_is_the_textbook_one(spark):
    draw = np.random.default_rng(5)
    points = np.concatenate([draw.normal(c, 1, (30, 3)) for c in (0, 2, 5)] + [np.full((1, 3), 40.0)])
    labels = [0] * 30 + [1] * 30 + [2] * 30 + [3]
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    total = 0.0
    for n, mine in enumerate(labels):
        if labels.count(mine) > 1:
            own = sum(far[n][m] for m, other in enumerate(labels) if other == mine) / (labels.count(mine) - 1)
            other = min(np.mean([far[n][m] for m, x in enumerate(labels) if x == name]) for name in set(labels) - {mine})
            total += (other - own) / max(own, other)
    rows = spark.createDataFrame([(n, p.tolist(), c) for n, (p, c) in enumerate(zip(points, labels))], "user_id long, z array<double>, cluster_id int")
    assert math.isclose(SG.pairwise_silhouette(rows), total / len(labels), rel_tol=1e-9)
    assert SG.pairwise_silhouette(rows.where("cluster_id = 0")) == 0.0 and -1 <= SG.pairwise_silhouette(rows, sample=20) <= 1


def test_segment_fits_share_their_passes(spark):
    draw = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0], [9.0, 9.0]])
    points = np.concatenate([draw.normal(c, 0.4, (40, 2)) for c in centres])
    rows = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(points)], "user_id long, z array<double>")
    jobs, found = {}, {}
    for seeds in ((42,), tuple(range(42, 52))):
        spark.sparkContext.setJobGroup(f"fit-{len(seeds)}", "fit")
        found[len(seeds)] = SG.fit_kmeans(rows, ks=(3, 4), seeds=seeds)
        jobs[len(seeds)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{len(seeds)}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[10] < 3 * jobs[1]
    best = found[10]
    within = sum(((points[40 * i:40 * i + 40] - points[40 * i:40 * i + 40].mean(axis=0)) ** 2).sum() for i in range(4))
    assert best["k"] == 4 and math.isclose(best["search"][1]["inertia"], within, rel_tol=1e-9)
    assert np.allclose(sorted(best["centroids"].values()), sorted(points[40 * i:40 * i + 40].mean(axis=0).tolist() for i in range(4)))
    same = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(5)], "user_id long, z array<double>")
    assert set(map(tuple, SG.fit_kmeans(same, ks=(2,), seeds=(42,))["centroids"].values())) == {(1.0, 2.0)}


def test_panel_is_spread_over_tasks(spark, tables, monkeypatch):
    whole = FC.weekly_panel(daily_demand(tables.order_items), tables.products)
    monkeypatch.setattr(FC, "PANEL_ROWS", max(1, whole.count() // 6))
    spread = FC.panel_features(FC.weekly_panel(daily_demand(tables.order_items), tables.products))
    held = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(held) >= 3 and spread.count() == whole.count()
    empty = FC.weekly_panel(daily_demand(tables.order_items.where("false")), tables.products)
    assert empty.count() == 0


def test_panel_fills_gaps_and_missing_prices_without_windows(spark, tables, monkeypatch):
    monkeypatch.setattr(FC, "FORECAST_MIN_UNITS", 2)
    monkeypatch.setattr(FC, "FORECAST_MIN_WEEKS", 2)
    days = [(1, "2024-01-15", 2.0, None), (1, "2024-01-29", 1.0, 5.0), (1, "2024-02-12", None, None), (2, "2024-01-01", 4.0, 7.0), (2, "2024-02-19", 1.0, 8.0),
            (3, "2024-01-08", 9.0, None), (3, "2024-01-15", 9.0, None), (4, "2024-01-15", 9.0, 1.0)]
    daily = spark.createDataFrame(days, "product_id long, day string, units double, avg_price double").withColumn("day", F.to_date("day"))
    panel = FC.weekly_panel(daily, tables.products)
    assert "Window" not in panel._jdf.queryExecution().executedPlan().toString()
    listed = tables.products.where("id = 3").first()["price"]
    got = {(r.product_id, r.week_index): (r.units, r.avg_price) for r in panel.collect()}
    want = {1: ([0, 0, 2, 0, 1, 0, 0, 0], [5.0] * 8), 2: ([4, 0, 0, 0, 0, 0, 0, 1], [7.0] * 7 + [8.0]), 3: ([0, 9, 9, 0, 0, 0, 0, 0], [listed] * 8)}
    assert got == {(p, w): (units[w], prices[w]) for p, (units, prices) in want.items() for w in range(8)}


def test_baselines_read_their_observations_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    observed = spark.range(100).selectExpr("'m' AS model", "'f' AS feature", "cast(id % 3 as string) AS day", "cast(id % 7 - 2 as double) AS value").mapInArrow(
        count, "model string, feature string, day string, value double")
    moments, bins = B.sketch(observed)
    assert sorted((r.day, r.n, r.total, r.squares, r.zeros) for r in moments.collect()) == [
        (str(d), len(v), sum(v), sum(x * x for x in v), v.count(0)) for d in range(3) for v in [[float(i % 7 - 2) for i in range(100) if i % 3 == d]]]
    assert bins.agg(F.sum("n")).first()[0] == 100 and set(bins.columns) == {"model", "feature", "day", "sign", "size", "n"}
    assert seen.value == 100


def test_the_cart_comes_first_then_items_like_the_last_view(spark):
    cart = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (3, 10, 1), (3, 11, 2), (3, 12, 3)], "user_id long, product_id long, rank int")
    viewed = spark.createDataFrame([(1, 50, 1), (1, 51, 2), (2, 50, 1), (3, 50, 1), (4, 99, 1)], "user_id long, product_id long, position int")
    similar = spark.createDataFrame([(50, 60 + i, i) for i in range(1, 6)] + [(51, 70, 1)], "id long, product_id long, rank int")
    got = sorted(tuple(r) for r in R.continue_shopping(cart, viewed, similar, 3).collect())
    assert got == [(1, 10, 1, "cart"), (1, 11, 2, "cart"), (1, 61, 3, "similar"), (2, 61, 1, "similar"), (2, 62, 2, "similar"), (2, 63, 3, "similar"),
                   (3, 10, 1, "cart"), (3, 11, 2, "cart"), (3, 12, 3, "cart")]
