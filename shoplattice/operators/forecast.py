"""Weekly demand panel, features, seasonal-naive profile, fitted residual model and rollout."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoplattice.constants import (
    FORECAST_HOLDOUT_WEEKS, FORECAST_HORIZONS, FORECAST_LAGS, FORECAST_MIN_UNITS, FORECAST_MIN_WEEKS, FORECAST_WINDOWS,
)
from shoplattice.functions.scalars import cyclic, ratio, week_start
from shoplattice.session import materialise

META = ("category_id", "brand_id", "price", "inventory", "discount_pct", "rating_avg")
FEATURES = (
    *[f"lag_{k}" for k in FORECAST_LAGS], *[f"roll_mean_{w}" for w in FORECAST_WINDOWS], *[f"roll_std_{w}" for w in FORECAST_WINDOWS],
    "roll_max_12", "trend_4_12", "week_of_year", "month", "quarter", "week_index", "price_ratio", "on_promotion",
    "woy_sin", "woy_cos", "month_sin", "month_cos", *META,
)
Z_95 = 1.96
#: Panel rows of one part.
PANEL_ROWS = 100_000
#: Panel rows of which a task of the fit keeps the features; about 400 bytes each.
FIT_ROWS = 500_000


def weekly_units(daily: DataFrame) -> DataFrame:
    return daily.groupBy("product_id", week_start("day").alias("week")).agg(
        F.sum("units").alias("units"), F.avg("avg_price").alias("avg_price"))


def eligible_products(weekly: DataFrame) -> DataFrame:
    per = weekly.groupBy("product_id").agg(F.sum("units").alias("_u"), F.count("*").alias("_w"))
    return per.where((F.col("_u") >= FORECAST_MIN_UNITS) & (F.col("_w") >= FORECAST_MIN_WEEKS)).select("product_id")


def weekly_panel(daily: DataFrame, products: DataFrame) -> DataFrame:
    """Dense weekly series of eligible products: zero units in empty weeks, price carried forward then back.

    A product's weeks are packed into one row, no longer than the calendar. The eligible products are dealt by id into a
    number of parts that follows from products x weeks before the calendar is spread out, and everything after (lags,
    windows, features) keeps that dealing. Each known week is spread over the empty weeks up to the next one, the first
    also over those before it, so the panel is neither looked up, ordered nor joined.
    """
    weekly = materialise(weekly_units(daily), "weekly")
    packed = F.array_sort(F.collect_list(F.struct("week", "units", "avg_price")))
    series = materialise(weekly.groupBy("product_id").agg(packed.alias("weeks"), F.sum("units").alias("_u"), F.count("*").alias("_w")).where(
        (F.col("_u") >= FORECAST_MIN_UNITS) & (F.col("_w") >= FORECAST_MIN_WEEKS)).select("product_id", "weeks"), "weekly-series")
    span = weekly.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).first()
    meta = products.select(F.col("id").alias("product_id"), *META)
    if span["lo"] is None:
        span = {"lo": date(1970, 1, 5), "hi": date(1970, 1, 5)}
    parts = -(-series.count() * ((span["hi"] - span["lo"]).days // 7 + 1) // PANEL_ROWS)
    priced = lambda weeks: F.filter(weeks, lambda x: x["avg_price"].isNotNull())

    def run(x: Column, at: Column) -> Column:
        price = F.coalesce(x["avg_price"], F.try_element_at(priced(F.slice("weeks", 1, at + 1)), F.lit(-1))["avg_price"],
                           F.try_element_at(priced(F.col("weeks")), F.lit(1))["avg_price"])
        start = F.when(at == 0, F.lit(span["lo"])).otherwise(x["week"])
        until = F.coalesce(F.date_sub(F.get("weeks", at + 1)["week"], 7), F.lit(span["hi"]))
        return F.struct(start.alias("start"), until.alias("until"), x["week"].alias("week"), x["units"].alias("units"), price.alias("avg_price"))

    runs = series.join(meta, "product_id").repartition(max(1, parts), "product_id").select(
        "product_id", F.explode(F.transform("weeks", run)).alias("r"), *META)
    dense = runs.select("product_id", F.explode(F.sequence("r.start", "r.until", F.expr("interval 7 days"))).alias("week"), "r", *META)
    return dense.select(
        "product_id", "week", F.coalesce(F.when(F.col("week") == F.col("r.week"), F.col("r.units")), F.lit(0.0)).alias("units"),
        F.coalesce("r.avg_price", "price").alias("avg_price"), *META, F.floor(F.datediff("week", F.lit(span["lo"])) / 7).cast("int").alias("week_index"))


def panel_features(panel: DataFrame) -> DataFrame:
    """Lags, rolling statistics of the preceding weeks (two at least), calendar and price features."""
    w = W.partitionBy("product_id").orderBy("week")
    cols: dict[str, Column] = {f"lag_{k}": F.lag("units", k).over(w) for k in FORECAST_LAGS}
    for n in FORECAST_WINDOWS:
        prior = w.rowsBetween(-n, -1)
        enough = F.count("units").over(prior) >= 2
        cols[f"roll_mean_{n}"] = F.when(enough, F.avg("units").over(prior))
        cols[f"roll_std_{n}"] = F.when(enough, F.stddev_samp("units").over(prior))
    cols["roll_max_12"] = F.when(F.count("units").over(w.rowsBetween(-12, -1)) >= 2, F.max("units").over(w.rowsBetween(-12, -1)))
    out = panel.withColumns(cols)
    return calendar_features(out.withColumn("trend_4_12", F.col("roll_mean_4") - F.col("roll_mean_12"))).withColumn(
        "price_ratio", ratio("avg_price", "price", default=1.0)).withColumn("on_promotion", (F.col("price_ratio") < 0.95).cast("int"))


def calendar_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({"week_of_year": F.weekofyear("week"), "month": F.month("week"), "quarter": F.quarter("week")})
    (ws, wc), (ms, mc) = cyclic("week_of_year", 52), cyclic("month", 12)
    return df.withColumns({"woy_sin": ws, "woy_cos": wc, "month_sin": ms, "month_cos": mc})


def training_rows(features: DataFrame) -> DataFrame:
    return features.where(F.col(f"lag_{max(FORECAST_LAGS)}").isNotNull())


def holdout(rows: DataFrame, weeks: int = FORECAST_HOLDOUT_WEEKS) -> DataFrame:
    """Tag rows after the last ``weeks`` weeks as test."""
    end = rows.agg(F.max("week")).scalar()
    return rows.withColumn("is_test", F.col("week") > F.date_sub(end, 7 * weeks))


def naive_profile(rows: DataFrame) -> DataFrame:
    """Per product: mean of the last four weeks, overall mean, month factors (map month -> factor), 12-week tail."""
    w = W.partitionBy("product_id").orderBy(F.col("week").desc())
    tail = rows.withColumn("_r", F.row_number().over(w))
    level = tail.groupBy("product_id").agg(
        F.avg(F.when(F.col("_r") <= 4, F.col("units"))).alias("recent_mean"), F.avg("units").alias("_mean"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 12, F.struct((-F.col("_r")).alias("o"), "units")))), lambda s: s["units"]).alias("tail"))
    level = level.withColumn("overall_mean", F.when(F.col("_mean") != 0, F.col("_mean")).otherwise(1.0))
    months = rows.groupBy("product_id", "month").agg(F.avg("units").alias("m"))
    factors = months.join(level.select("product_id", "overall_mean"), "product_id").groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.col("m") / F.col("overall_mean")))).alias("factors"))
    return level.join(factors, "product_id").select("product_id", "recent_mean", "overall_mean", "factors", "tail")


def global_seasonality(rows: DataFrame) -> DataFrame:
    overall = rows.agg(F.coalesce(F.nullif(F.avg("units"), F.lit(0.0)), F.lit(1.0))).scalar()
    return rows.groupBy("month").agg((F.avg("units") / overall).alias("factor"))


def naive_value(month: Column) -> Column:
    return F.greatest(F.col("recent_mean") * F.coalesce(F.try_element_at("factors", month), F.lit(1.0)), F.lit(0.0))


def naive_predict(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Seasonal naive; products without a profile predict zero."""
    joined = rows.join(profile.select("product_id", "recent_mean", "factors"), "product_id", "left")
    return joined.withColumn("naive", F.coalesce(naive_value(F.col("month")), F.lit(0.0))).drop("recent_mean", "factors")


def horizon_accuracy(predicted: DataFrame, horizons: Sequence[int] = FORECAST_HORIZONS) -> DataFrame:
    """Errors of cumulative units over the first round(h/7) test weeks, scaled to h days."""
    from shoplattice.operators.evaluate import forecast_metrics
    first = predicted.agg(F.min("week")).scalar()
    at = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(max(1, round(h / 7))).alias("n")) for h in horizons]))
    per = predicted.select("product_id", "week", "units", "prediction", at.alias("h")).where(
        F.datediff("week", first) < 7 * F.col("h.n")).groupBy("product_id", "h.horizon", "h.n").agg(
        F.sum("units").alias("a"), F.sum("prediction").alias("p"))
    scale = F.col("horizon") / (7.0 * F.col("n"))
    return forecast_metrics(per.select("horizon", (F.col("a") * scale).alias("actual"), (F.col("p") * scale).alias("predicted")), ["horizon"])


# ---- fitted residual model -------------------------------------------------
def assembled(rows: DataFrame) -> DataFrame:
    """Rows with the dense vector ``features``, an unknown value as NaN. Every pass of a fit makes the vectors anew; from an
    array that takes far less time than from a row of so many columns."""
    from pyspark.ml.functions import array_to_vector
    unknown = F.lit(float("nan"))
    return rows.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), unknown) for c in FEATURES])))


def fit_residual(train: DataFrame, max_iter: int = 400, depth: int = 6, step: float = 0.05):
    """Boosted trees on units minus naive, with a hash-picked validation slice for early stopping."""
    from pyspark.ml.regression import GBTRegressor
    rows = assembled(train).select("features", (F.col("units") - F.col("naive")).alias("residual"),
                                   (F.pmod(F.xxhash64("product_id", "week"), F.lit(100)) < 15).alias("is_val"))
    return GBTRegressor(labelCol="residual", featuresCol="features", maxIter=max_iter, maxDepth=depth, stepSize=step,
                        minInstancesPerNode=15, validationIndicatorCol="is_val", seed=42).fit(rows)


def predict_units(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(assembled(rows)).drop("features")
    return scored.withColumn("advanced", F.greatest(F.col("naive") + F.col("prediction"), F.lit(0.0))).drop("prediction")


def select_model(scored: DataFrame) -> DataFrame:
    """MAE of both arms, the chosen one and its residual deviation."""
    return scored.agg(
        F.avg(F.abs(F.col("units") - F.col("advanced"))).alias("advanced_mae"), F.avg(F.abs(F.col("units") - F.col("naive"))).alias("naive_mae"),
        F.stddev_pop(F.col("units") - F.col("advanced")).alias("_a"), F.stddev_pop(F.col("units") - F.col("naive")).alias("_n")).select(
        "advanced_mae", "naive_mae",
        F.when(F.col("advanced_mae") <= F.col("naive_mae"), "naive_plus_gbm_residual").otherwise("seasonal_naive").alias("selected_model"),
        F.when(F.col("advanced_mae") <= F.col("naive_mae"), F.col("_a")).otherwise(F.col("_n")).alias("residual_std"))


# ---- rollout ---------------------------------------------------------------
def _points(value: Column, spread: Column) -> list[Column]:
    return [F.round(value, 4).alias("predicted"), F.round(F.greatest(value - Z_95 * spread, F.lit(0.0)), 4).alias("lower"),
            F.round(value + Z_95 * spread, 4).alias("upper")]


def naive_weekly(profile: DataFrame, last_week: date | datetime, weeks: int, residual_std: float = 0.0) -> DataFrame:
    """Seasonal-naive weekly path per product with a constant spread."""
    spread = F.lit(max(residual_std, 0.5))
    steps = profile.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(weeks)))).withColumn(
        "week", F.date_add(F.lit(last_week).cast("date"), F.col("step") * 7))
    value = naive_value(F.month("week"))
    return steps.select("product_id", "step", "week", *_points(value, spread), F.lit("seasonal_naive").alias("model"))


def with_last_week(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the index and price ratio of each product's last panel week; the price is carried forward."""
    last = rows.groupBy("product_id").agg(F.max_by(F.struct(F.col("week_index").alias("last_index"), "price_ratio"), "week").alias("_l"))
    return profile.join(last.select("product_id", "_l.*"), "product_id")


def weekly_forecast(model, profile: DataFrame, products: DataFrame, last_week: date, weeks: int, residual_std: float,
                    checkpoint_every: int = 4) -> DataFrame:
    """Roll every product forward together; each prediction becomes the next week's lag. ``profile`` carries each product's
    last ``week_index`` and ``price_ratio`` (``with_last_week``), so the model sees the features it was fitted on.

    The history travels as an array column, so a step is one narrow transform.
    Lineage is cut every few steps by writing to the shared folder.
    """
    meta = products.select(F.col("id").alias("product_id"), *META)
    state = profile.join(meta, "product_id").withColumnRenamed("tail", "hist").withColumn("_n0", F.size("hist"))
    done = None
    for step in range(1, weeks + 1):
        week = last_week + timedelta(weeks=step)
        tail = lambda n: F.slice("hist", F.greatest(F.size("hist") - n + 1, F.lit(1)), n)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        mean = lambda a: total(a) / F.size(a)
        cols = {f"lag_{k}": F.coalesce(F.when(F.size("hist") >= k, F.try_element_at("hist", F.lit(-k))), mean(F.col("hist"))) for k in FORECAST_LAGS}
        for n in FORECAST_WINDOWS:
            m = mean(tail(n))
            cols[f"roll_mean_{n}"] = m
            cols[f"roll_std_{n}"] = F.sqrt(F.greatest(total(F.transform(tail(n), lambda v: v * v)) - F.size(tail(n)) * m * m, F.lit(0.0))
                                           / F.greatest(F.size(tail(n)) - 1, F.lit(1)))
        cols["roll_max_12"] = F.array_max(tail(12))
        rows = state.withColumns(cols).withColumns({
            "trend_4_12": F.col("roll_mean_4") - F.col("roll_mean_12"), "week": F.lit(week), "week_index": F.col("last_index") + step})
        rows = calendar_features(rows).withColumn("on_promotion", (F.col("price_ratio") < 0.95).cast("int")).withColumn("naive", naive_value(F.col("month")))
        value = predict_units(model, rows).select(
            "product_id", "recent_mean", "factors", "last_index", "price_ratio", *META, "_n0", F.col("advanced"), "hist")
        state = value.withColumn("hist", F.concat("hist", F.array("advanced")))
        if step % checkpoint_every == 0 or step == weeks:
            state = materialise(state, "rollout")
        state = state.drop("advanced")
    spread = F.lit(max(residual_std, 0.35)) * F.sqrt(F.col("step"))
    done = state.select("product_id", "_n0", F.posexplode("hist").alias("_i", "value")).where(F.col("_i") >= F.col("_n0")).withColumn(
        "step", F.col("_i") - F.col("_n0") + 1).withColumn("week", F.date_add(F.lit(last_week), F.col("step") * 7))
    return done.select("product_id", "step", "week", *_points(F.col("value"), spread), F.lit("naive_plus_gbm_residual").alias("model"))


def daily_forecast(weekly: DataFrame, last_day: date | datetime, horizon: int = 30) -> DataFrame:
    """Spread every week over its days; the last week also covers what is left of the horizon."""
    n = -(-horizon // 7)
    days = weekly.where(F.col("step") <= n).withColumn("day", F.explode(F.sequence(
        (F.col("step") - 1) * 7 + 1, F.when(F.col("step") == n, F.lit(horizon)).otherwise(F.col("step") * 7))))
    return days.select("product_id", "day", F.date_add(F.lit(last_day).cast("date"), F.col("day").cast("int")).alias("date"),
                       *[F.round(F.col(c) / 7.0, 4).alias(c) for c in ("predicted", "lower", "upper")], "model")


def horizon_totals(daily: DataFrame, horizons: Sequence[int] = FORECAST_HORIZONS) -> DataFrame:
    h = F.explode(F.array(*[F.lit(x) for x in horizons]))
    rows = daily.select("product_id", "day", "predicted", "lower", "upper", h.alias("horizon")).where(F.col("day") <= F.col("horizon"))
    return rows.groupBy("product_id", "horizon").agg(
        F.round(F.sum("predicted"), 6).alias("predicted_units"), F.round(F.sum("lower"), 6).alias("lower_bound"),
        F.round(F.sum("upper"), 6).alias("upper_bound"), F.round(F.avg("predicted"), 4).alias("daily_average"))


def stockout_risk(totals: DataFrame, products: DataFrame) -> DataFrame:
    inv = products.select(F.col("id").alias("product_id"), F.col("inventory").cast("double").alias("inventory"))
    return totals.join(inv, "product_id").withColumns({
        "will_stock_out": F.col("predicted_units") > F.col("inventory"), "worst_case_stock_out": F.col("upper_bound") > F.col("inventory"),
        "cover_ratio": F.when(F.col("predicted_units") > 0, F.round(F.col("inventory") / F.col("predicted_units"), 3))})


def top_demand(daily: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    total = daily.where(F.col("day") <= 30).groupBy("product_id").agg(F.round(F.sum("predicted"), 6).alias("predicted_30d"))
    best = total.orderBy(F.col("predicted_30d").desc(), "product_id").limit(k)
    return best.join(products.select(F.col("id").alias("product_id"), "title", "inventory"), "product_id")


def repeat_last_week(tails: DataFrame, horizon: int) -> DataFrame:
    """Cycle the last seven values of ``tail``; an empty tail repeats zero."""
    window = F.slice("tail", F.greatest(F.size("tail") - 6, F.lit(1)), 7)
    value = F.coalesce(F.try_element_at(F.col("_w"), (F.pmod(F.col("step") - 1, F.greatest(F.size("_w"), F.lit(1))) + 1).cast("int")), F.lit(0.0))
    return tails.withColumn("_w", window).select("product_id", "_w", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select(
        "product_id", "step", value.alias("predicted"))
