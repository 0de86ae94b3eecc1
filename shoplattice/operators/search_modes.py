"""Search end to end: corrected queries, filters, three ways to find products, the personal signal, one page a query."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.functions.grouped import top_k
from shoplattice.functions.scalars import normalise_query
from shoplattice.operators import search as S
from shoplattice.session import materialise

#: Filter columns of a query table and what a missing or null one means.
OPEN_FILTERS = {
    "category_slugs": "CAST(array() AS ARRAY<STRING>)", "category_ids": "CAST(array() AS ARRAY<BIGINT>)",
    "brand_ids": "CAST(array() AS ARRAY<BIGINT>)", "min_price": "CAST(NULL AS DOUBLE)", "max_price": "CAST(NULL AS DOUBLE)",
    "min_rating": "CAST(NULL AS DOUBLE)", "in_stock_only": "false", "on_sale_only": "false"}
FILTERED = ("category_slug", "category_id", "brand_id", "effective_price", "rating_avg", "inventory", "discount_pct")
#: Filter sets that meet the catalogue as one array.
SETS_A_BLOCK = 256
BLOCK_ROWS = 2048
#: Rows the fallback finds beyond the page.
FALLBACK_SPARE = 40


class Profile(NamedTuple):
    """What the personal signal reads: (user_id, category_id, affinity), (user_id, brand_id, affinity), (user_id, price_p10, price_p90)."""
    category: DataFrame
    brand: DataFrame
    bands: DataFrame


def admits(wanted: Callable[[str], Column]) -> Column:
    """Whether the product of the row passes the filters that ``wanted`` reads by name."""
    def listed(name: str, column: str) -> Column:
        return (F.size(wanted(name)) == 0) | F.array_contains(wanted(name), F.col(column))

    def bound(name: str, test: Callable[[Column], Column]) -> Column:
        return wanted(name).isNull() | test(wanted(name))
    return (listed("category_slugs", "category_slug") & listed("category_ids", "category_id") & listed("brand_ids", "brand_id")
            & bound("min_price", lambda v: F.col("effective_price") >= v) & bound("max_price", lambda v: F.col("effective_price") <= v)
            & bound("min_rating", lambda v: F.col("rating_avg") >= v)
            & (~wanted("in_stock_only") | (F.col("inventory") > 0)) & (~wanted("on_sale_only") | (F.col("discount_pct") > 0)))


def understand(queries: DataFrame, vocabulary: DataFrame, categories: DataFrame) -> DataFrame:
    """The query table with the query that is searched (``effective``, empty: browse), its correction and complete filters.

    The budget of the text is the highest price unless a filter names one; "in stock" in the text switches that filter on.
    """
    extra = {name: F.coalesce(F.col(name), F.expr(default)) if name in queries.columns else F.expr(default)
             for name, default in OPEN_FILTERS.items()}
    fixed = S.correct_queries(queries, vocabulary).where("changed").select("query_id", "corrected")
    meant = S.parse_intent(queries, categories).drop("query")
    rows = queries.withColumns(extra).join(meant, "query_id").join(fixed, "query_id", "left")
    return rows.withColumns({
        "effective": F.coalesce("corrected", normalise_query("query"), F.lit("")),
        "max_price": F.coalesce("max_price", "budget"), "in_stock_only": F.col("in_stock_only") | F.coalesce("in_stock", F.lit(False))})


def browse(asked: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, id): every product that a query's filters admit.

    Queries with the same filters share one pass. Filter sets meet the catalogue in blocks, as arrays that are filtered
    in place, so that only admitted pairs become rows.
    """
    keyed = materialise(asked.withColumn("_set", F.xxhash64(F.to_json(F.struct(*OPEN_FILTERS)))).select("query_id", "_set", *OPEN_FILTERS), "browse-queries")
    sets = keyed.dropDuplicates(["_set"]).select("_set", *OPEN_FILTERS)
    blocks = max(1, -(-sets.count() // SETS_A_BLOCK))
    packed = sets.groupBy(F.pmod("_set", F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct("_set", *OPEN_FILTERS)).alias("_sets"))
    met = products.select("id", *FILTERED, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).join(packed, "_b")
    admitted = met.select("id", F.explode(F.filter("_sets", lambda s: admits(lambda name: s[name]))["_set"]).alias("_set"))
    return admitted.join(keyed.select("query_id", "_set"), "_set").select("query_id", "id")


def _mask(query, items: pd.DataFrame) -> np.ndarray:
    ok = np.ones(len(items), dtype=bool)
    for wanted, column in ((query.category_slugs, "category_slug"), (query.category_ids, "category_id"), (query.brand_ids, "brand_id")):
        if len(wanted):
            ok &= items[column].isin(list(wanted)).to_numpy()
    if pd.notna(query.min_price):
        ok &= (items.effective_price >= query.min_price).to_numpy()
    if pd.notna(query.max_price):
        ok &= (items.effective_price <= query.max_price).to_numpy()
    if pd.notna(query.min_rating):
        ok &= (items.rating_avg >= query.min_rating).to_numpy()
    if query.in_stock_only:
        ok &= (items.inventory > 0).to_numpy()
    if query.on_sale_only:
        ok &= (items.discount_pct > 0).to_numpy()
    return ok


def _unit(vectors: DataFrame) -> DataFrame:
    wide = vectors.withColumn("vector", F.col("vector").cast("array<double>")).withColumn(
        "_n", F.sqrt(F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)))
    return wide.where("_n > 0").withColumn("vector", F.transform("vector", lambda x: x / F.col("_n"))).drop("_n")


def filtered_topk(asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` by cosine among the items that each query's own filters admit.

    Both sides are cut into blocks by hash. Each pair of blocks is one task with one product of matrices; filters are
    masks over the block's items, and only ``k`` rows of a query leave the task.
    """
    n_queries, n_items = asked.count(), items.count()
    qb, cb = max(1, -(-n_queries // BLOCK_ROWS)), max(1, -(-n_items // BLOCK_ROWS))
    q = _unit(asked.select("query_id", "vector", *OPEN_FILTERS)).select(
        F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"),
        "query_id", "vector", *OPEN_FILTERS)
    c = _unit(items.select("id", "vector", *FILTERED)).select(
        F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(cb)).cast("int").alias("cb"), "id", "vector", *FILTERED)

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(cs):
            scores = np.stack(qs.vector.to_numpy()) @ np.stack(cs.vector.to_numpy()).T
            ids = cs.id.to_numpy()
            for row, query in enumerate(qs.itertuples(index=False)):
                at = np.flatnonzero(_mask(query, cs))
                at = at[np.lexsort((ids[at], -np.round(scores[row, at], 6)))[:k]]
                out.append(pd.DataFrame({"query_id": query.query_id, "id": ids[at], "score": scores[row, at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    part = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(best, "query_id long, id long, score double")
    return top_k(part, ["query_id"], [F.round("score", 6).desc(), F.col("id")], k)


def search(
    queries: DataFrame, query_vectors: DataFrame, products: DataFrame, vectors: DataFrame, conversion: DataFrame, vocabulary: DataFrame,
    categories: DataFrame, profile: Profile | None = None, weights: Mapping[str, float] | None = None, sort: str = "relevance",
    limit: int = 20, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(page, ranked) of a whole query table: (query_id, query, optional user_id and filter columns).

    ``strategy`` says how a query's products were found: ``browse`` (nothing to search for: all that its filters admit),
    ``hybrid`` (the best of text and vectors together, then filtered), or ``semantic_fallback`` (the filters left nothing of
    those: nearest vectors among the admitted products). A query that nothing matches has no row. ``corrected`` is null
    where the query was searched as written. With a profile the personal signal counts for queries with a user.
    """
    asked = materialise(understand(queries, vocabulary, categories), "search-queries")
    live = products.where("is_active")
    typed, bare = asked.where("effective <> ''"), asked.where("effective = ''")
    lexical = S.bm25(typed.select("query_id", F.col("effective").alias("query")), S.product_text(products))
    aimed = typed.join(query_vectors, "query_id")
    pool = S.candidates(lexical, S.cosine_topk(aimed.select("query_id", "vector"), vectors, S.CANDIDATE_POOL))
    hybrid = pool.join(typed.select("query_id", *OPEN_FILTERS), "query_id").join(live.select("id", *FILTERED), "id").where(admits(F.col))
    near = F.coalesce("semantic", F.lit(0.0)).alias("semantic")  # found by its text alone: as far as a cosine of zero
    hybrid = materialise(hybrid.select("query_id", "id", "lexical", near), "search-hybrid")
    missed = aimed.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    nearest = filtered_topk(missed, live.join(vectors.select("id", "vector"), "id"), limit + offset + FALLBACK_SPARE)
    none = F.lit(None).cast("double")
    found = hybrid.withColumn("strategy", F.lit("hybrid")).unionByName(
        nearest.select("query_id", "id", none.alias("lexical"), F.greatest("score", F.lit(0.0)).alias("semantic"), F.lit("semantic_fallback").alias("strategy"))).unionByName(
        browse(bare, live).select("query_id", "id", none.alias("lexical"), none.alias("semantic"), F.lit("browse").alias("strategy")))
    found = materialise(found, "search-found")
    personal = None
    if profile is not None:
        pairs = found.select("query_id", "id").join(live.select("id", "category_id", "brand_id", "effective_price"), "id")
        personal = S.personal_signal(pairs, asked.where("user_id IS NOT NULL"), profile.category, profile.brand, profile.bands)
    meant = asked.select("query_id", none.alias("budget"), "price_ascending", "quality_bias", F.lit(False).alias("in_stock"), "category_hint", "corrected")
    ranked = materialise(S.rank_candidates(found, meant, products, conversion, weights, personal), "search-ranked")
    return S.result_page(ranked, sort, limit, offset), ranked
