"""Price features, statistics, model, explanations and opportunities."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.constants import PRICE_FEATURES, PRICE_TREND_THRESHOLD, REVENUE_STATUSES, VIEW_TYPES
from shoplattice.functions.grouped import grouped_percentiles, top_k
from shoplattice.functions.scalars import clip, finite, ntz, ratio, whole_days
from shoplattice.sources.readers import json_number


def price_frame(products: DataFrame, order_items: DataFrame, events: DataFrame, orders_as_of: datetime, events_as_of: datetime) -> DataFrame:
    """Eighteen features per priced product; facts are aggregated per product before the join.

    Category statistics come from one aggregate and skew-safe percentiles joined
    back, never from a window over a whole category.
    """
    since = ntz(orders_as_of - timedelta(days=90))
    sold = order_items.where((F.col("placed_at") >= since) & F.col("status").isin(*REVENUE_STATUSES)).groupBy(F.col("product_id").alias("id")).agg(
        F.sum("quantity").alias("_u"), F.sum("line_total").alias("_r"))
    kind = F.col("event_type")
    seen = events.where(F.col("occurred_at") >= ntz(events_as_of - timedelta(days=90))).groupBy(F.col("product_id").alias("id")).agg(
        F.count_if(kind.isin(*VIEW_TYPES)).alias("_v"), F.count_if(kind == "purchase").alias("_p"))
    cat = products.groupBy("category_id").agg(F.sum("price").alias("_cs"), F.count("price").alias("_cn"))
    pct = grouped_percentiles(products, ["category_id"], "price", {"category_p25_price": 0.25, "category_p75_price": 0.75})
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = products.where(F.col("price") > 0).join(sold, "id", "left").join(seen, "id", "left").join(cat, "category_id").join(pct, "category_id")
    out = df.withColumns({
        "units_sold_90d": F.log1p(z("_u")), "revenue_90d": F.log1p(z("_r")), "sales_velocity": z("_u") / 90.0, "views_90d": F.log1p(z("_v")),
        "conversion_rate": clip(F.when(z("_v") >= 3, z("_p") / z("_v")).otherwise(0.0), 0.0, 1.0),
        "category_mean_price_loo": F.when(F.col("_cn") > 1, (F.col("_cs") - F.col("price")) / (F.col("_cn") - 1)).otherwise(F.col("price")),
        "days_since_launch": clip(F.coalesce(whole_days(orders_as_of, "launched_at").cast("double"), F.lit(365.0)), 0.0, 3650.0),
        "spec_weight_g": json_number("specifications_json", "weight_g", 0.0), "warranty_months": json_number("specifications_json", "warranty_months", 12.0),
        "description_length": F.length(F.coalesce("description", F.lit(""))).cast("double"), "tag_count": F.size("tags").cast("double"),
        "rating_count": F.log1p(F.col("rating_count")), "inventory": F.col("inventory").cast("double")})
    return out.select("id", "title", "category_id", "price", "effective_price", *[finite(F.col(f)).alias(f) for f in PRICE_FEATURES])


def split(frame: DataFrame) -> DataFrame:
    """Deterministic 80/20 split by id hash: adding rows never moves a product between sides."""
    bucket = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    return frame.withColumn("is_test", F.pmod(bucket, F.lit(5)) == 0)


def category_stats(frame: DataFrame, features: Sequence[str] = ("price", *PRICE_FEATURES)) -> DataFrame:
    """(category_id, feature, p25, median, p75); category -1 is the whole catalogue."""
    tall = frame.select(F.explode(F.array(F.col("category_id"), F.lit(-1))).alias("category_id"), F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]).alias("fs"))
    rows = tall.select("category_id", F.explode("fs").alias("f")).select("category_id", "f.*")
    return grouped_percentiles(rows, ["category_id", "feature"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})


def _assembled(frame: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(PRICE_FEATURES), outputCol="features").transform(frame)


def fit(train: DataFrame, max_iter: int = 400, depth: int = 6, step: float = 0.055):
    """Boosted trees on the log price; a hash-picked validation slice stops the boosting early."""
    from pyspark.ml.regression import GBTRegressor
    rows = _assembled(train).withColumn("label", F.log("price")).withColumn("is_val", F.pmod(F.xxhash64("id"), F.lit(100)) < 15)
    return GBTRegressor(labelCol="label", featuresCol="features", maxIter=max_iter, maxDepth=depth, stepSize=step, minInstancesPerNode=12,
                        validationIndicatorCol="is_val", seed=42).fit(rows)


def predict(model, frame: DataFrame) -> DataFrame:
    return model.transform(_assembled(frame)).withColumnRenamed("prediction", "log_pred").drop("features")


def price_outlook(scored: DataFrame, residual_std: float | Column) -> DataFrame:
    """Predicted price, trend, confidence and bounds from (price, log_pred)."""
    spread = F.greatest(residual_std if isinstance(residual_std, Column) else F.lit(float(residual_std)), F.lit(1e-6))
    delta = F.when(F.col("price") > 0, (F.exp("log_pred") - F.col("price")) / F.col("price")).otherwise(0.0)
    trend = F.when(delta > PRICE_TREND_THRESHOLD, "up").when(delta < -PRICE_TREND_THRESHOLD, "down").otherwise("stable")
    conf = clip(1.0 - F.least(spread / 0.5, F.lit(1.0)) * 0.7 - F.least(F.abs(delta), F.lit(0.5)) * 0.4, 0.05, 0.99)
    return scored.withColumns({
        "predicted_price": F.round(F.exp("log_pred"), 2), "price_trend": trend, "delta_pct": F.round(delta * 100, 3), "confidence": F.round(conf, 4),
        "lower_bound": F.round(F.exp(F.col("log_pred") - 1.96 * spread), 2), "upper_bound": F.round(F.exp(F.col("log_pred") + 1.96 * spread), 2)})


def contributions(model, scored: DataFrame, medians: DataFrame, k: int = 6) -> DataFrame:
    """Local ablation: each feature set to its category median, change in log price, top-k by size."""
    ref = medians.groupBy("category_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("ref"))
    variants = scored.join(ref, "category_id").select(
        "id", F.col("log_pred").alias("base"), "ref", F.explode(F.array(*[F.lit(f) for f in PRICE_FEATURES])).alias("feature"), *PRICE_FEATURES)
    ablated = variants.select("id", "base", "feature", *[
        F.when(F.col("feature") == f, F.coalesce(F.try_element_at("ref", F.lit(f)), F.col(f))).otherwise(F.col(f)).alias(f) for f in PRICE_FEATURES])
    diff = predict(model, ablated).select("id", "feature", F.round(F.col("base") - F.col("log_pred"), 6).alias("contribution"))
    return top_k(diff, ["id"], [F.abs("contribution").desc(), F.col("feature")], k).withColumn(
        "direction", F.when(F.col("contribution") > 0, "increases price").otherwise("decreases price"))


def permutation_importance(model, test: DataFrame, repeats: int = 8, seed: int = 42) -> DataFrame:
    """Mean drop of R2 when one feature is shuffled; every (feature, repeat) variant is scored in one job.

    A shuffle is a cyclic shift of row positions by a per-variant offset. Row
    positions come from ``zipWithIndex``-style numbering of hash buckets, so no
    global sort is needed.
    """
    n = test.count()
    numbered = _numbered(test, seed)
    offsets = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(r).alias("rep"), F.lit(1 + (i * 7919 + r * 104729) % max(n - 1, 1)).alias("shift"))
        for i, f in enumerate(PRICE_FEATURES) for r in range(repeats)]))
    variants = numbered.select("pos", "price", *PRICE_FEATURES, offsets.alias("o")).select(
        "pos", "price", *PRICE_FEATURES, "o.*", F.pmod(F.col("pos") + F.col("o.shift"), F.lit(n)).alias("donor"))
    tall = numbered.select(F.col("pos").alias("donor"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("swapped")) for f in PRICE_FEATURES])).alias("s")).select("donor", "s.*")
    mixed = variants.join(tall, ["donor", "feature"]).select("feature", "rep", "price", *[
        F.when(F.col("feature") == f, F.col("swapped")).otherwise(F.col(f)).alias(f) for f in PRICE_FEATURES])
    r2 = lambda: 1 - F.sum(F.pow(F.log("price") - F.col("log_pred"), F.lit(2.0))) / (F.var_pop(F.log("price")) * F.count("*"))
    base = predict(model, test).agg(r2().alias("b")).scalar()
    per = predict(model, mixed).groupBy("feature", "rep").agg(r2().alias("r"))
    return per.groupBy("feature").agg(F.avg("r").alias("r")).select("feature", F.round(base - F.col("r"), 6).alias("importance"))


def _numbered(df: DataFrame, seed: int, buckets: int = 256) -> DataFrame:
    """Dense positions 0..n-1 in pseudo-random order: offset of the hash bucket plus rank inside it."""
    from pyspark.sql import Window as W
    b = df.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)))
    sizes = b.groupBy("_b").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    w = W.partitionBy("_b").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")
    return b.withColumn("_i", F.row_number().over(w) - 1).join(base.select("_b", "_base"), "_b").withColumn("pos", F.col("_base") + F.col("_i"))


def evaluation(scored: DataFrame) -> DataFrame:
    """Model and leave-one-out category-mean baseline side by side, plus hit rates within 10 and 20 percent."""
    from shoplattice.operators.evaluate import regression_metrics
    arms = F.explode(F.array(F.struct(F.lit("model").alias("arm"), F.exp("log_pred").alias("predicted")),
                             F.struct(F.lit("category_baseline").alias("arm"), F.col("category_mean_price_loo").alias("predicted"))))
    rows = scored.select(F.col("price").alias("actual"), arms.alias("a")).select("actual", "a.*")
    off = F.abs(F.col("predicted") - F.col("actual")) / F.col("actual")
    hits = rows.groupBy("arm").agg(F.round(F.avg((off <= 0.1).cast("double")), 5).alias("within_10pct"), F.round(F.avg((off <= 0.2).cast("double")), 5).alias("within_20pct"))
    return regression_metrics(rows, ["arm"]).join(hits, "arm")


def opportunities(predictions: DataFrame, products: DataFrame, direction: str = "up", k: int = 10) -> DataFrame:
    gap = F.abs(F.col("predicted_price") - F.col("price"))
    best = predictions.where(F.col("price_trend") == direction).orderBy(F.round(gap, 6).desc(), "id").limit(k)
    return best.select("id", F.round("price", 2).alias("current_price"), "predicted_price", "price_trend", "confidence",
                       ratio((F.col("predicted_price") - F.col("price")) * 100, "price", 2).alias("delta_pct")).join(products.select("id", "title"), "id")


def narrative(outlook: DataFrame, drivers: Column | str = "drivers") -> DataFrame:
    """One sentence per product from trend, delta_pct and a driver text."""
    d = F.col(drivers) if isinstance(drivers, str) else drivers
    pct = F.format_string("%.1f", F.floor(F.abs("delta_pct") * 10 + 0.5) / 10.0)
    text = F.when(F.col("price_trend") == "up", F.concat(
        F.lit("The model prices this "), pct, F.lit("% above its current listing, driven mainly by "), d, F.lit(". There may be room to raise the price."))).when(
        F.col("price_trend") == "down", F.concat(
            F.lit("The model prices this "), pct, F.lit("% below its current listing, driven mainly by "), d, F.lit(". It may be priced above what the market supports."))).otherwise(
        F.concat(F.lit("The current price is consistent with what the model expects for this product (within "), pct, F.lit("%), based on "), d, F.lit(".")))
    return outlook.withColumn("explanation", text)


def residual_std(scored: DataFrame) -> Column:
    """Deviation of the log price from the model on held-out products, as a scalar."""
    return scored.agg(F.coalesce(F.stddev_pop(F.log("price") - F.col("log_pred")), F.lit(0.0))).scalar()


def drivers(contributed: DataFrame, k: int = 2) -> DataFrame:
    """(id, drivers): the names of the k strongest contributions, as words."""
    best = contributed.where(F.col("rank") <= k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("f"))
    return best.select("id", F.array_join(F.transform("f", lambda x: F.replace(x["feature"], F.lit("_"), F.lit(" "))), " and ").alias("drivers"))
