"""Catalogue projections, filters, sorts, pages and short lists."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import REVENUE_STATUSES
from shoplattice.functions.grouped import top_k
from shoplattice.functions.scalars import clip, effective_price, event_weight


# ---- projections -----------------------------------------------------------
def searchable_text() -> Column:
    specs = F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))
    return F.trim(F.concat_ws(" ", "title", "description", F.array_join("tags", " "), F.array_join(specs, " ")))


def stock_label(inventory: Column | str = "inventory") -> Column:
    n = F.col(inventory) if isinstance(inventory, str) else inventory
    return (F.when(n <= 0, "Out of stock")
            .when(n < 10, F.concat(F.lit("Only "), n, F.lit(" left"))).otherwise("In stock"))


def margin() -> Column:
    eff = F.col("price") * (1 - F.col("discount_pct") / 100.0)
    return clip((eff - F.col("base_cost")) / F.greatest(eff, F.lit(1e-3)), 0.0, 1.0)


def flag_orders(orders: DataFrame) -> DataFrame:
    return orders.withColumn("is_revenue", F.col("status").isin(*REVENUE_STATUSES))


def flag_events(events: DataFrame) -> DataFrame:
    return events.withColumn("weight", event_weight())


def flag_searches(searches: DataFrame) -> DataFrame:
    return searches.withColumn("abandoned", F.col("clicked_product_id").isNull())


def cart_summary(lines: DataFrame, cart: str = "cart_id") -> DataFrame:
    """Totals per basket of (cart, price, effective_price, quantity)."""
    off = F.greatest(F.col("price") - F.col("effective_price"), F.lit(0.0))
    base = lines.groupBy(cart).agg(
        F.sum(F.col("effective_price") * F.col("quantity")).alias("subtotal"),
        F.sum(off * F.col("quantity")).alias("savings"),
        F.sum("quantity").alias("item_count"))
    shipping = F.when((F.col("subtotal") > 50) | (F.col("subtotal") == 0), 0.0).otherwise(6.99)
    return (
        base.withColumn("shipping", shipping).withColumn("tax", F.col("subtotal") * 0.08)
        .withColumn("total", F.col("subtotal") + F.col("shipping") + F.col("tax")))


def dominant_signal(signals: Sequence[str]) -> Column:
    """Name of the largest signal column; the first wins ties, no signals give ``relevance``."""
    if not signals:
        return F.lit("relevance")
    entries = F.array(*[
        F.struct(F.col(s).alias("v"), F.lit(-i).alias("pos"), F.lit(s).alias("name")) for i, s in enumerate(signals)])
    return F.array_max(entries)["name"]


# ---- filters ---------------------------------------------------------------
@dataclass(frozen=True)
class CatalogFilter:
    """Empty fields do not restrict."""
    category_slugs: Sequence[str] = field(default_factory=tuple)
    category_ids: Sequence[int] = field(default_factory=tuple)
    brand_ids: Sequence[int] = field(default_factory=tuple)
    ids: Sequence[int] | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_rating: float | None = None
    in_stock_only: bool = False
    on_sale_only: bool = False

    def predicate(self, price: str = "price") -> Column:
        p = F.col("is_active")
        if self.category_slugs:
            p = p & F.col("category_slug").isin(*self.category_slugs)
        if self.category_ids:
            p = p & F.col("category_id").isin(*self.category_ids)
        if self.brand_ids:
            p = p & F.col("brand_id").isin(*self.brand_ids)
        if self.ids is not None:
            p = p & F.col("id").isin(*self.ids)
        if self.min_price is not None:
            p = p & (F.col(price) >= self.min_price)
        if self.max_price is not None:
            p = p & (F.col(price) <= self.max_price)
        if self.min_rating is not None:
            p = p & (F.col("rating_avg") >= self.min_rating)
        if self.in_stock_only:
            p = p & (F.col("inventory") > 0)
        if self.on_sale_only:
            p = p & (F.col("discount_pct") > 0)
        return p


def list_products(products: DataFrame, where: CatalogFilter) -> DataFrame:
    """Catalogue listing: the filter uses the list price."""
    return products.where(where.predicate("price"))


def search_filter(products: DataFrame, where: CatalogFilter) -> DataFrame:
    """Search filter: the same rules on the effective price."""
    return products.where(where.predicate("effective_price"))


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def reviews_for(reviews: DataFrame, sentiment: str | None = None, per_product: int | None = None) -> DataFrame:
    """Reviews ranked per product by helpfulness, newest first among equals."""
    kept = reviews if sentiment is None else reviews.where(F.col("sentiment_label") == sentiment)
    order = [F.col("helpful_votes").desc(), F.col("created_at").desc(), F.col("id").asc()]
    if per_product is None:
        return kept.orderBy("product_id", *order)
    return top_k(kept, ["product_id"], order, per_product, rank="position")


# ---- sort, page, short lists ----------------------------------------------
def catalogue_order(sort: str) -> list[Column]:
    orders = {
        "relevance": [F.col("rating_count").desc(), F.col("rating_avg").desc()],
        "price_asc": [F.col("price").asc()],
        "price_desc": [F.col("price").desc()],
        "rating": [F.col("rating_avg").desc(), F.col("rating_count").desc()],
        "newest": [F.col("launched_at").desc_nulls_last(), F.col("id").desc()],
        "discount": [F.col("discount_pct").desc()],
        "popularity": [F.col("rating_count").desc()],
    }
    return [*orders.get(sort, orders["relevance"]), F.col("id").asc()]


def paginate(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page with the totals a pager shows. The total is a scalar subquery, not a second column scan."""
    page, page_size = max(page, 1), max(page_size, 1)
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    pages = F.ceil(total / F.lit(float(page_size))).cast("long")
    return rows.select(
        "*", total.alias("total"), pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_previous"))


def page_after(df: DataFrame, order_key: str, last_key: float, last_id: int, page_size: int) -> DataFrame:
    """Keyset page in ascending (key, id) order: constant cost at any depth."""
    after = (F.col(order_key) > last_key) | ((F.col(order_key) == last_key) & (F.col("id") > last_id))
    return df.where(after).orderBy(order_key, "id").limit(page_size)


def low_inventory(products: DataFrame, threshold: int = 10, k: int = 20) -> DataFrame:
    return products.where(F.col("is_active") & (F.col("inventory") <= threshold)).orderBy("inventory", "id").limit(k)


def deals(products: DataFrame, k: int = 10) -> DataFrame:
    on_offer = products.where(F.col("is_active") & (F.col("discount_pct") > 0) & (F.col("inventory") > 0))
    top = on_offer.orderBy(F.col("discount_pct").desc(), F.col("rating_avg").desc(), "id").limit(k)
    return top.withColumn("score", F.col("discount_pct") / 100.0).withColumn(
        "explanation", F.concat(F.col("discount_pct").cast("int"), F.lit("% off right now")))


def popularity_fallback(products: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """Best-rated available products outside ``exclude`` (a frame with product ``id``)."""
    live = products.where(F.col("is_active") & (F.col("inventory") > 0))
    if exclude is not None:
        live = live.join(exclude, "id", "left_anti")
    return live.orderBy(F.col("rating_count").desc(), F.col("rating_avg").desc(), "id").limit(k)


def same_category_fallback(products: DataFrame, k: int) -> DataFrame:
    """Per product, the ``k`` best-rated active products of its category other than itself.

    Only the best k+1 of each category can appear, so the self-exclusion joins
    against that short list and not against the whole category.
    """
    heads = top_k(products.where("is_active").select(
        "category_id", F.col("id").alias("other_id"), F.col("rating_avg").alias("other_rating")),
        ["category_id"], [F.col("other_rating").desc(), F.col("other_id")], k + 1, rank="_r")
    own = heads.select("category_id", F.col("other_id").alias("id"), F.col("_r").alias("_own"))
    joined = products.select("id", "category_id").join(heads, "category_id").join(own, ["category_id", "id"], "left")
    rank = F.col("_r") - F.when(F.col("_own") < F.col("_r"), 1).otherwise(0)
    return (joined.where(F.col("id") != F.col("other_id")).withColumn("rank", rank)
            .where(F.col("rank") <= k).select("id", "other_id", "other_rating", "rank"))
