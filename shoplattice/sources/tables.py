"""Logical commerce tables over Parquet.

``Tables`` maps the physical Parquet files to the logical schema every operator
works on. All derivations are deterministic column expressions, so filters and
column pruning still reach the Parquet scan; nothing is cached or collected
except the two ``as_of`` instants (one row each, answered from a max aggregate).
"""
from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoplattice.functions.scalars import effective_price, normalise_query, ntz

CATEGORY_NAMES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
STRATEGIES = ("hybrid", "cold_start", "trending_events")


def category_id(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CATEGORY_NAMES]), c), F.lit(0)).cast("int")


class Tables:
    """Lazy access to every logical table of one dataset folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # ---- instants ---------------------------------------------------------
    @cached_property
    def orders_as_of(self) -> datetime:
        return self.raw("orders").agg(F.max("o_orderdate")).first()[0]

    @cached_property
    def events_as_of(self) -> datetime:
        return self.raw("events").agg(F.max("ts")).first()[0]

    # ---- catalogue --------------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        size = F.col("p_size")
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
        specs = F.when(key % 25 == 3, F.lit("{bad json")).otherwise(F.concat(
            F.lit('{"size": '), size, F.lit(', "weight_g": '), size * 10,
            F.when(size % 3 == 0, F.concat(F.lit(', "warranty_months": '), size % 24)).otherwise(F.lit("")),
            F.lit("}")))
        return self.raw("part").select(
            key.alias("id"),
            F.concat(F.lit("SKU-"), key).alias("sku"),
            F.col("p_name").alias("title"),
            F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" size "), size).alias("description"),
            category_id(F.col("p_type")).alias("category_id"),
            F.lower("p_type").alias("category_slug"),
            F.initcap("p_type").alias("category_name"),
            brand.alias("brand_id"),
            F.col("p_brand").alias("brand_name"),
            (brand / 25.0).alias("brand_reputation"),
            F.col("p_retailprice").alias("price"),
            (F.lit(0.55) * F.col("p_retailprice")).alias("base_cost"),
            ((key % 7) * 5).cast("double").alias("discount_pct"),
            F.round(1.0 + (key * 7 % 41) / 10.0, 1).alias("rating_avg"),
            (key * 13 % 200).alias("rating_count"),
            (key * 37 % 120).alias("inventory"),
            (key % 50 != 0).alias("is_active"),
            F.array(F.lower("p_type"), F.split("p_name", " ")[0]).alias("tags"),
            specs.alias("specifications_json"),
            F.from_json(specs, "map<string,string>").alias("specifications"),
            F.timestamp_add("DAY", (key % 2000).cast("int"), ntz(datetime(1995, 1, 1))).alias("launched_at"),
            effective_price(F.col("p_retailprice"), ((key % 7) * 5).cast("double")).alias("effective_price"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        t = self.raw("part").select("p_type").distinct()
        return t.select(category_id(F.col("p_type")).alias("id"), F.lower("p_type").alias("slug"),
                        F.initcap("p_type").alias("name"))

    @cached_property
    def brands(self) -> DataFrame:
        b = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
        return self.raw("part").select(b.alias("id"), F.col("p_brand").alias("name"),
                                       (b / 25.0).alias("reputation_score")).distinct()

    # ---- users ------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
        return self.raw("customer").join(nation, "c_nationkey", "left").select(
            key.alias("id"),
            F.concat(F.lit("user"), key, F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("full_name"),
            F.when(key % 97 == 0, "admin").otherwise("customer").alias("role"),
            (key % 20 != 0).alias("is_active"),
            "country",
            F.lower("c_mktsegment").alias("signup_source"),
            ((key % 11) / 10.0).alias("price_sensitivity"),
            F.concat(F.lit("["), key % 6 + 1, F.lit(","), key % 5 + 1, F.lit("]")).alias("preferred_categories_json"),
            F.concat(F.lit("["), key % 25 + 1, F.lit("]")).alias("preferred_brands_json"),
        )

    @cached_property
    def users_with_signup(self) -> DataFrame:
        first = self.orders.groupBy(F.col("user_id").alias("id")).agg(F.min("placed_at").alias("created_at"))
        return self.users.join(first, "id", "left")

    # ---- orders -----------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "delivered").when(
            F.col("o_orderstatus") == "O", "paid").otherwise("pending")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
            F.col("o_totalprice").alias("total_amount"),
            (F.col("o_totalprice") * (F.col("o_orderkey") % 10) / 100.0).alias("discount_amount"),
            F.lower(F.substring("o_orderpriority", 3, 20)).alias("channel"),
            F.col("o_orderdate").alias("placed_at"),
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_discount") * 100.0).alias("discount_pct"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_total"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Order lines with the order's user, status and time."""
        o = self.orders.select(F.col("id").alias("order_id"), "user_id", "status", "placed_at")
        return self.order_lines.join(o, "order_id")

    # ---- behaviour --------------------------------------------------------
    def _event_columns(self, event_type: Column, product: Column, quantity: Column) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), "user_id", event_type.alias("event_type"), product.alias("product_id"),
            quantity.alias("quantity"), "value",
            F.when(F.col("event_id") % 3 == 0, "mobile").otherwise("web").alias("source"),
            F.col("ts").alias("occurred_at"))

    @cached_property
    def events(self) -> DataFrame:
        raw = F.col("event_type")
        kind = (
            F.when(raw == "view", "product_view")
            .when((raw == "click") & (F.col("event_id") % 10 == 0), "wishlist")
            .when(raw == "signup", "add_to_cart")
            .when(raw == "error", "remove_from_cart")
            .otherwise(raw))
        return self._event_columns(kind, F.get_json_object("props", "$.k").cast("long"), F.lit(1))

    @cached_property
    def raw_events(self) -> DataFrame:
        """Events as submitted: unknown types, missing products and bad quantities included."""
        raw, key = F.col("event_type"), F.col("event_id")
        kind = F.when(raw == "view", "product_view").otherwise(raw)
        product = F.get_json_object("props", "$.k").cast("long") + F.when(key % 250 == 1, 10_000_000).otherwise(0)
        return self._event_columns(kind, product, F.when(key % 100 == 2, 0).otherwise(1))

    @cached_property
    def session_events(self) -> DataFrame:
        from shoplattice.operators.sessions import sessionise
        return sessionise(self.events)

    @cached_property
    def impressions(self) -> DataFrame:
        strategies = F.array(*[F.lit(s) for s in STRATEGIES])
        return self.events.where(F.col("event_type") == "product_view").select(
            F.col("id").alias("impression_id"), "user_id", "product_id",
            F.lit("homepage").alias("surface"),
            F.element_at(strategies, (F.col("id") % 3 + 1).cast("int")).alias("strategy"),
            F.lit("v1").alias("model_version"), F.col("occurred_at").alias("served_at"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Inference log: one row per model call."""
        names = F.array(*[F.lit(n) for n in ("forecasting", "price_prediction", "recommendation", "segmentation", "sentiment")])
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("model_name"),
            F.when(F.col("user_id") % 2 == 0, "v1").otherwise("v2").alias("model_version"),
            F.col("user_id").alias("entity_id"), F.col("value").alias("prediction"),
            (F.col("value") * 0.1 + (F.col("event_id") % 7)).alias("latency_ms"),
            (F.col("event_type") != "error").alias("succeeded"),
            F.when(F.col("event_type") == "error", "Timeout").alias("error_code"),
            F.col("ts").alias("predicted_at"))

    # ---- text -------------------------------------------------------------
    @cached_property
    def reviews(self) -> DataFrame:
        return self._as_reviews(self.raw("documents").join(self.raw("labels"), "doc_id"))

    @cached_property
    def pending_reviews(self) -> DataFrame:
        """Documents nobody has labelled yet."""
        docs = self.raw("documents").join(self.raw("labels"), "doc_id", "left_anti")
        return self._as_reviews(docs.withColumn("toxic", F.lit(None).cast("int")).withColumn(
            "quality", F.lit(None).cast("int"))).withColumn("sentiment_label", F.lit(None).cast("string")).withColumn(
            "sentiment_score", F.lit(None).cast("double"))

    def _as_reviews(self, docs: DataFrame) -> DataFrame:
        key = F.col("doc_id")
        parts = self.raw("part").agg(F.count("*")).scalar()
        customers = self.raw("customer").agg(F.count("*")).scalar()
        rating = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5).otherwise(3)
        label = F.when(rating >= 4, "positive").when(rating == 3, "neutral").otherwise("negative")
        score = F.when(rating >= 4, 0.5).when(rating == 3, 0.0).otherwise(-0.5) + (key % 10) / 100.0
        return docs.select(
            key.alias("id"), (key % parts).alias("product_id"), (key % customers).alias("user_id"),
            rating.alias("rating"), F.col("source").alias("title"), F.col("text").alias("body"),
            (key % 2 == 0).alias("verified_purchase"), (key % 17).alias("helpful_votes"),
            label.alias("sentiment_label"), score.alias("sentiment_score"),
            F.timestamp_add("HOUR", (key % 700).cast("int"), ntz(datetime(2024, 1, 1))).alias("created_at"))

    @cached_property
    def search_events(self) -> DataFrame:
        key = F.col("conv_id") * 100 + F.col("turn")
        customers = self.raw("customer").agg(F.count("*")).scalar()
        return self.raw("conversations").where(F.col("role") == "user").select(
            key.alias("id"), (F.col("conv_id") % customers).alias("user_id"), F.col("text").alias("query"),
            normalise_query("text").alias("normalized_query"),
            F.when(key % 6 == 0, 0).otherwise(key % 40).alias("result_count"),
            F.when(key % 3 == 0, key % 100).alias("clicked_product_id"),
            (key % 12 == 0).alias("converted"), (key % 50 / 10.0).alias("latency_ms"),
            F.timestamp_add("MINUTE", (key % 40000).cast("int"), ntz(datetime(2024, 1, 1))).alias("occurred_at"))

    @cached_property
    def corpus(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), "text")

    @cached_property
    def text_queries(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("category_id"))

    @cached_property
    def product_queries(self) -> DataFrame:
        """One search per distinct title, with the vector of its first product and mixed modifiers."""
        first = self.products.groupBy(F.col("title")).agg(F.min("id").alias("query_id"))
        n = F.col("query_id")
        text = (
            F.when(n % 5 == 0, F.concat(F.lit("best "), F.col("title")))
            .when(n % 5 == 1, F.concat(F.col("title"), F.lit(" under $800")))
            .when(n % 5 == 2, F.concat(F.lit("Cheap  "), F.col("title")))
            .when(n % 5 == 3, F.concat(F.col("title"), F.lit(" in stock")))
            .otherwise(F.concat(F.col("title"), F.lit(" promo"))))
        return first.select("query_id", text.alias("query"))

    def register_views(self) -> dict[str, DataFrame]:
        """Register every logical table as a temp view and return the bundle."""
        names = ("products", "categories", "brands", "users", "orders", "order_lines", "order_items", "events",
                 "reviews", "search_events", "impressions", "predictions", "vectors")
        bundle = {n: getattr(self, n) for n in names}
        for name, df in bundle.items():
            df.createOrReplaceTempView(f"shop_{name}")
        return bundle
