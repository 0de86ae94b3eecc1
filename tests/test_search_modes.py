"""Filters, browsing and the filtered vector search against plain loops."""
import numpy as np
import pytest

from shoplattice.operators import search_modes as M

FILTERS = [
    {}, {"category_ids": [1]}, {"category_ids": [0, 2], "brand_ids": [3]}, {"min_price": 20.0, "max_price": 60.0}, {"min_rating": 3.0, "in_stock_only": True},
    {"on_sale_only": True, "category_slugs": ["c1"]}, {"brand_ids": [99]}, {"max_price": 60.0, "min_price": 20.0}]


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(5)
    items = [dict(id=i, category_id=i % 3, category_slug=f"c{i % 3}", brand_id=i % 7, effective_price=float(rng.integers(1, 100)), rating_avg=float(rng.integers(2, 11)) / 2,
                  inventory=int(rng.integers(0, 3)), discount_pct=float(rng.integers(0, 2) * 10), vector=rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(90)]
    asked = []
    for n, wanted in enumerate(FILTERS):
        full = dict(category_slugs=[], category_ids=[], brand_ids=[], min_price=None, max_price=None, min_rating=None, in_stock_only=False, on_sale_only=False) | wanted
        asked.append(dict(query_id=n, vector=rng.integers(-3, 4, 5).astype(float).tolist()) | full)
    schema = ("query_id long, vector array<double>, category_slugs array<string>, category_ids array<long>, brand_ids array<long>, min_price double, "
              "max_price double, min_rating double, in_stock_only boolean, on_sale_only boolean")
    return items, asked, spark.createDataFrame(items), spark.createDataFrame(asked, schema)


def passes(q, p):
    return not ((q["category_slugs"] and p["category_slug"] not in q["category_slugs"]) or (q["category_ids"] and p["category_id"] not in q["category_ids"])
                or (q["brand_ids"] and p["brand_id"] not in q["brand_ids"]) or (q["min_price"] is not None and p["effective_price"] < q["min_price"])
                or (q["max_price"] is not None and p["effective_price"] > q["max_price"]) or (q["min_rating"] is not None and p["rating_avg"] < q["min_rating"])
                or (q["in_stock_only"] and p["inventory"] <= 0) or (q["on_sale_only"] and p["discount_pct"] <= 0))


@pytest.mark.parametrize("sets", [1, 256])
def test_browse_lists_what_the_filters_admit(shop, sets, monkeypatch):
    items, asked, products, queries = shop
    monkeypatch.setattr(M, "SETS_A_BLOCK", sets)
    got = sorted(map(tuple, M.browse(queries, products).collect()))
    assert got == sorted((q["query_id"], p["id"]) for q in asked for p in items if passes(q, p))


@pytest.mark.parametrize("block", [3, 2048])
def test_filtered_neighbours_match_loops(shop, block, monkeypatch):
    items, asked, products, queries = shop
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    want = {}
    for q in asked:
        a = np.array(q["vector"])
        near = [(-round(float(a @ np.array(p["vector"]) / np.linalg.norm(a) / np.linalg.norm(p["vector"])), 6), p["id"])
                for p in items if passes(q, p) and any(p["vector"])]
        if any(q["vector"]) and near:
            want[q["query_id"]] = [i for _, i in sorted(near)[:6]]
    got = {}
    for r in M.filtered_topk(queries, products, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_missing_filters_are_open_and_text_fills_them(spark, tables):
    asked = spark.createDataFrame([(1, "ring under $20", None), (2, "ring under $20", 5.0), (3, None, None), (4, "ring in stock", None)], "query_id long, query string, max_price double")
    vocabulary = spark.createDataFrame([("ring", 3), ("stock", 1), ("under", 1)], "term string, df long")
    got = {r.query_id: r for r in M.understand(asked, vocabulary, tables.categories).collect()}
    assert [got[i].max_price for i in (1, 2, 3, 4)] == [20.0, 5.0, None, None]
    assert got[3].effective == "" and got[4].in_stock_only and not got[1].in_stock_only and got[1].category_ids == []
