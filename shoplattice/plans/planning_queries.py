"""Forecast and price queries."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shoplattice.constants import PRICE_FEATURES, SEGMENT_FEATURES
from shoplattice.functions.scalars import day
from shoplattice.operators import baselines as B, forecast as FC, pricing as PR, recommend as R, segments as SG, sentiment as SE
from shoplattice.plans.registry import fitted_once, query
from shoplattice.session import materialise, read_in_parts, work_dir
from shoplattice.sources import sinks
from shoplattice.sources.readers import daily_demand

PANEL = """wk AS MATERIALIZED (SELECT product_id, CAST(date_trunc('week', day) AS DATE) AS week, sum(units) AS units, avg(avg_price) AS avg_price FROM lt_demand GROUP BY 1, 2),
el AS MATERIALIZED (SELECT product_id FROM wk GROUP BY 1 HAVING sum(units) >= 25 AND count(*) >= 20),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM wk), (SELECT max(week) FROM wk), INTERVAL 7 DAY)) AS DATE) AS week),
dn AS (SELECT el.product_id, cal.week, coalesce(units, 0.0) AS units, coalesce(last_value(avg_price IGNORE NULLS) OVER (PARTITION BY el.product_id ORDER BY cal.week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(avg_price IGNORE NULLS) OVER (PARTITION BY el.product_id ORDER BY cal.week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS avg_price
  FROM el CROSS JOIN cal LEFT JOIN wk ON wk.product_id = el.product_id AND wk.week = cal.week),
pn AS MATERIALIZED (SELECT dn.*, category_id, brand_id, price, inventory, discount_pct, rating_avg, CAST(date_diff('day', (SELECT min(week) FROM wk), week) // 7 AS INTEGER) AS week_index FROM dn JOIN lt_products p ON p.id = product_id)"""
FEATS = PANEL + """, ft AS MATERIALIZED (SELECT *, """ + ", ".join(f"lag(units, {k}) OVER w AS lag_{k}" for k in FC.FORECAST_LAGS) + ", " + ", ".join(
    f"CASE WHEN count(units) OVER w{n} >= 2 THEN avg(units) OVER w{n} END AS roll_mean_{n}, CASE WHEN count(units) OVER w{n} >= 2 THEN stddev_samp(units) OVER w{n} END AS roll_std_{n}"
    for n in FC.FORECAST_WINDOWS) + """, CASE WHEN count(units) OVER w12 >= 2 THEN max(units) OVER w12 END AS roll_max_12, CAST(week(week) AS INTEGER) AS week_of_year, CAST(month(week) AS INTEGER) AS month,
  CAST(quarter(week) AS INTEGER) AS quarter, avg_price / price AS price_ratio FROM pn WINDOW w AS (PARTITION BY product_id ORDER BY week), """ + ", ".join(
    f"w{n} AS (PARTITION BY product_id ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in FC.FORECAST_WINDOWS) + ")"
PROFILE = FEATS + """, tr AS (SELECT * FROM ft WHERE lag_12 IS NOT NULL), sp AS MATERIALIZED (SELECT *, week > (SELECT max(week) FROM tr) - 56 AS is_test FROM tr), tn AS MATERIALIZED (SELECT * FROM sp WHERE NOT is_test),
lv AS MATERIALIZED (SELECT product_id, avg(units) FILTER (WHERE r <= 4) AS recent_mean, coalesce(nullif(avg(units), 0), 1) AS overall_mean FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS r FROM tn) GROUP BY 1),
mf AS (SELECT tn.product_id, month, avg(units) / any_value(overall_mean) AS factor FROM tn JOIN lv USING (product_id) GROUP BY 1, 2)"""


def panel(t):
    return FC.weekly_panel(daily_demand(t.order_items), t.products)


def rows(t):
    return FC.holdout(FC.training_rows(FC.panel_features(panel(t))))


def profile(t):
    return FC.naive_profile(rows(t).where("NOT is_test"))


@query("fc_01_weekly_panel", f"WITH {PANEL} SELECT product_id, strftime(week, '%Y-%m-%d') AS week, units, round(avg_price, 8) AS avg_price, week_index, category_id, inventory FROM pn")
def _(t):
    return panel(t).select("product_id", day("week").alias("week"), "units", F.round("avg_price", 8).alias("avg_price"), "week_index", "category_id", "inventory")


@query("jn_13_product_calendar", f"WITH {PANEL} SELECT product_id, count(*) AS weeks, sum(units) AS units FROM pn GROUP BY 1")
def _(t):
    return panel(t).groupBy("product_id").agg(F.count("*").alias("weeks"), F.sum("units").alias("units"))


@query("set_02_eligible_products", f"WITH {PANEL} SELECT product_id FROM el")
def _(t):
    return FC.eligible_products(FC.weekly_units(daily_demand(t.order_items)))


def _feature_query(name, cols):
    sql_cols = ", ".join(f"round(coalesce({c}, -1), 6) AS {c}" for c in cols)

    @query(name, f"WITH {FEATS} SELECT product_id, strftime(week, '%Y-%m-%d') AS week, {sql_cols} FROM ft")
    def _(t):
        f = FC.panel_features(panel(t))
        return f.select("product_id", day("week").alias("week"), *[F.round(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), 6).alias(c) for c in cols])


_feature_query("win_01_lags", [f"lag_{k}" for k in FC.FORECAST_LAGS])
_feature_query("win_02_rolling_stats", [f"roll_{s}_{n}" for s in ("mean", "std") for n in FC.FORECAST_WINDOWS])


@query("win_03_rolling_max_trend", f"WITH {FEATS} SELECT product_id, week_index, round(roll_max_12, 6) AS roll_max_12, round(roll_mean_4 - roll_mean_12, 6) AS trend_4_12 FROM ft WHERE lag_12 IS NOT NULL")
def _(t):
    return FC.training_rows(FC.panel_features(panel(t))).select("product_id", "week_index", F.round("roll_max_12", 6).alias("roll_max_12"), F.round("trend_4_12", 6).alias("trend_4_12"))


@query("win_04_fill_forward_back", f"WITH {PANEL} SELECT product_id, week_index, round(avg_price, 8) AS avg_price FROM pn WHERE units = 0")
def _(t):
    return panel(t).where("units = 0").select("product_id", "week_index", F.round("avg_price", 8).alias("avg_price"))


@query("fc_02_panel_features", f"""WITH {FEATS} SELECT product_id, week_index, week_of_year, month, quarter, round(price_ratio, 6) AS price_ratio, CAST(price_ratio < 0.95 AS INTEGER) AS on_promotion,
  round(sin(2 * pi() * week_of_year / 52.0), 6) + 0.0::DOUBLE AS woy_sin, round(cos(2 * pi() * week_of_year / 52.0), 6) + 0.0::DOUBLE AS woy_cos, round(sin(2 * pi() * month / 12.0), 6) + 0.0::DOUBLE AS month_sin, round(cos(2 * pi() * month / 12.0), 6) + 0.0::DOUBLE AS month_cos FROM ft WHERE lag_12 IS NOT NULL""")
def _(t):
    f = FC.training_rows(FC.panel_features(panel(t)))
    return f.select("product_id", "week_index", "week_of_year", "month", "quarter", F.round("price_ratio", 6).alias("price_ratio"), "on_promotion",
                    *[(F.round(c, 6) + 0.0).alias(c) for c in ("woy_sin", "woy_cos", "month_sin", "month_cos")])


@query("fc_03_temporal_holdout", f"WITH {PROFILE} SELECT is_test, count(*) AS n, sum(units) AS units, strftime(min(week), '%Y-%m-%d') AS first_week, strftime(max(week), '%Y-%m-%d') AS last_week FROM sp GROUP BY 1")
def _(t):
    return rows(t).groupBy("is_test").agg(F.count("*").alias("n"), F.sum("units").alias("units"), day(F.min("week")).alias("first_week"), day(F.max("week")).alias("last_week"))


@query("fc_04_naive_profile", f"WITH {PROFILE} SELECT product_id, month, round(recent_mean, 6) AS recent_mean, round(overall_mean, 6) AS overall_mean, round(factor, 6) AS factor FROM lv JOIN mf USING (product_id)")
def _(t):
    p = profile(t).select("product_id", F.round("recent_mean", 6).alias("recent_mean"), F.round("overall_mean", 6).alias("overall_mean"), F.explode("factors").alias("month", "factor"))
    return p.withColumn("factor", F.round("factor", 6))


@query("fc_04_global_seasonality", f"WITH {PROFILE} SELECT month, round(avg(units) / (SELECT avg(units) FROM tn), 6) AS factor FROM tn GROUP BY 1")
def _(t):
    return FC.global_seasonality(rows(t).where("NOT is_test")).withColumn("factor", F.round("factor", 6))


@query("win_13_tail_series", f"""WITH {PROFILE} SELECT product_id, array_to_string(list(CAST(CAST(units AS BIGINT) AS VARCHAR) ORDER BY week), ',') AS tail FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS r FROM tn) WHERE r <= 12 GROUP BY 1""")
def _(t):
    return profile(t).select("product_id", F.array_join(F.transform("tail", lambda v: v.cast("long").cast("string")), ",").alias("tail"))


NAIVE = PROFILE + """, pd AS (SELECT sp.product_id, week, units, greatest(recent_mean * coalesce(factor, 1), 0) AS naive FROM sp JOIN lv USING (product_id) LEFT JOIN mf ON mf.product_id = sp.product_id AND mf.month = sp.month WHERE is_test)"""


@query("fc_05_naive_prediction", f"WITH {NAIVE} SELECT product_id, strftime(week, '%Y-%m-%d') AS week, units, round(naive, 5) AS naive FROM pd")
def _(t):
    return FC.naive_predict(rows(t).where("is_test"), profile(t)).select("product_id", day("week").alias("week"), "units", F.round("naive", 5).alias("naive"))


@query("fc_08_horizon_accuracy", f"""WITH {NAIVE}, h AS (SELECT * FROM (VALUES (7, 1), (14, 2), (30, 4)) v(horizon, n)),
c AS (SELECT horizon, product_id, sum(units) * horizon / (7.0 * any_value(n)) AS a, sum(naive) * horizon / (7.0 * any_value(n)) AS p FROM pd, h WHERE date_diff('day', (SELECT min(week) FROM pd), week) < 7 * n GROUP BY 1, 2)
SELECT CAST(horizon AS INTEGER) AS horizon, round(avg(abs(p - a)), 5) AS mae, round(sqrt(avg((p - a) * (p - a))), 5) AS rmse, count(*) AS support FROM c GROUP BY 1""")
def _(t):
    p = FC.naive_predict(rows(t).where("is_test"), profile(t)).withColumn("prediction", F.col("naive"))
    return FC.horizon_accuracy(p).select("horizon", "mae", "rmse", "support")


PATH = NAIVE.replace("WHERE is_test)", "WHERE is_test)") + """, lw AS (SELECT max(week) AS w FROM tn), st AS (SELECT lv.product_id, CAST(s AS INTEGER) AS step, CAST(w + 7 * CAST(s AS INTEGER) AS DATE) AS week, recent_mean FROM lv, lw, range(1, 6) r(s)),
wp AS (SELECT st.product_id, step, week, round(greatest(recent_mean * coalesce(factor, 1), 0), 4) AS predicted, round(greatest(recent_mean * coalesce(factor, 1), 0) + 1.96::DOUBLE * 0.5::DOUBLE, 4) AS upper
  FROM st LEFT JOIN mf ON mf.product_id = st.product_id AND mf.month = month(st.week)),
dy AS (SELECT product_id, CAST(d AS INTEGER) AS day, predicted / 7.0 AS predicted, upper / 7.0 AS upper FROM wp, range(1, 31) r(d) WHERE step = (d + 6) // 7)"""


def naive_daily(t):
    last = rows(t).where("NOT is_test").agg(F.max("week")).first()[0]
    return FC.daily_forecast(FC.naive_weekly(profile(t), last, 5), last, 30)


@query("fc_10_daily_forecast", f"WITH {PATH} SELECT product_id, day, round(predicted, 4) AS predicted, round(upper, 4) AS upper FROM dy")
def _(t):
    return naive_daily(t).select("product_id", F.col("day").cast("int").alias("day"), "predicted", "upper")


TOTALS = PATH + """, tt AS (SELECT product_id, horizon, sum(round(predicted, 4)) AS u, sum(round(upper, 4)) AS up FROM dy, (VALUES (7), (14), (30)) v(horizon) WHERE day <= horizon GROUP BY 1, 2)"""


@query("fc_11_horizon_totals", f"WITH {TOTALS} SELECT product_id, CAST(horizon AS INTEGER) AS horizon, round(u, 5) AS predicted_units FROM tt")
def _(t):
    return FC.horizon_totals(naive_daily(t)).select("product_id", "horizon", F.round("predicted_units", 5).alias("predicted_units"))


@query("fc_12_stockout_risk", f"WITH {TOTALS} SELECT product_id, CAST(horizon AS INTEGER) AS horizon, round(u, 6) > inventory AS will_stock_out, round(up, 6) > inventory AS worst_case_stock_out FROM tt JOIN lt_products p ON p.id = product_id")
def _(t):
    return FC.stockout_risk(FC.horizon_totals(naive_daily(t)), t.products).select("product_id", "horizon", "will_stock_out", "worst_case_stock_out")


@query("fc_13_top_demand", f"""WITH {PATH} SELECT product_id, predicted_30d, title, CAST(inventory AS INTEGER) AS inventory FROM
  (SELECT product_id, round(sum(round(predicted, 4)), 6) AS predicted_30d FROM dy GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) JOIN lt_products p ON p.id = product_id""")
def _(t):
    return FC.top_demand(naive_daily(t), t.products)


@query("fc_15_repeat_last_week", f"""WITH {PROFILE}, tl AS (SELECT product_id, list(units ORDER BY week) AS w FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS r FROM tn) WHERE r <= 7 GROUP BY 1)
SELECT product_id, CAST(s AS INTEGER) AS step, w[(s - 1) % len(w) + 1] AS predicted FROM tl, range(1, 15) r(s)""")
def _(t):
    return FC.repeat_last_week(profile(t), 14)


def _fitted(t):
    return fitted_once(t, "forecasting", _fit_forecast)


def _fit_forecast(t):
    known = rows(t)  # one panel for the features and the profile
    data = materialise(FC.naive_predict(known, FC.naive_profile(known.where("NOT is_test"))), "panel")
    with read_in_parts(data, FC.FIT_ROWS):
        return data, FC.fit_residual(data.where("NOT is_test"))


@query("fc_06_residual_model")
def _(t):
    data, model = _fitted(t)
    return FC.predict_units(model, data.where("is_test")).select("product_id", day("week").alias("week"), "units", F.round("naive", 4).alias("naive"), F.round("advanced", 4).alias("advanced"))


@query("fc_07_model_selection")
def _(t):
    data, model = _fitted(t)
    return FC.select_model(FC.predict_units(model, data.where("is_test")))


@query("fc_09_recursive_rollout")
def _(t):
    data, model = _fitted(t)
    known = data.where("NOT is_test")
    last = known.agg(F.max("week")).first()[0]
    chosen = FC.select_model(FC.predict_units(model, data.where("is_test"))).first()
    p = FC.with_last_week(FC.naive_profile(known), known)
    if chosen["selected_model"] == "seasonal_naive":
        return FC.naive_weekly(p, last, 5, chosen["residual_std"])
    return FC.weekly_forecast(model, p, t.products, last, 5, chosen["residual_std"])


@query("fc_14_accuracy_summary")
def _(t):
    data, model = _fitted(t)
    from shoplattice.operators.evaluate import forecast_metrics
    scored = FC.predict_units(model, data.where("is_test"))
    arms = F.explode(F.array(F.struct(F.lit("advanced").alias("arm"), F.col("advanced").alias("predicted")), F.struct(F.lit("seasonal_naive").alias("arm"), F.col("naive").alias("predicted"))))
    return forecast_metrics(scored.select(F.col("units").alias("actual"), arms.alias("a")).select("actual", "a.*"), ["arm"])


# ---- pricing ---------------------------------------------------------------
PRICE = r"""sl AS (SELECT product_id, sum(quantity) AS u, sum(line_total) AS r FROM lt_items, lt_asof WHERE status IN ('paid','shipped','delivered') AND placed_at >= o_now - INTERVAL 90 DAY GROUP BY 1),
vw AS (SELECT product_id, count(*) FILTER (WHERE event_type IN ('product_view','click')) AS v, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM lt_events, lt_asof WHERE occurred_at >= e_now - INTERVAL 90 DAY GROUP BY 1),
ca AS (SELECT category_id, sum(price) AS cs, count(*) AS cn, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.75) AS p75 FROM lt_products GROUP BY 1),
pf AS (SELECT p.id, p.title, p.category_id, p.price, brand_reputation, rating_avg, ln(1 + rating_count) AS rating_count, CAST(inventory AS DOUBLE) AS inventory, discount_pct, ln(1 + coalesce(u, 0)) AS units_sold_90d, ln(1 + coalesce(r, 0)) AS revenue_90d,
  coalesce(u, 0) / 90.0 AS sales_velocity, ln(1 + coalesce(v, 0)) AS views_90d, CASE WHEN v >= 3 THEN least(b / v, 1) ELSE 0 END AS conversion_rate, (cs - p.price) / (cn - 1) AS category_mean_price_loo, p25 AS category_p25_price, p75 AS category_p75_price,
  least(greatest(CAST(date_diff('day', launched_at, o_now) AS DOUBLE), 0), 3650) AS days_since_launch, CASE WHEN bad_json THEN 0.0 ELSE size_ * 10.0 END AS spec_weight_g,
  CAST(CASE WHEN NOT bad_json AND size_ % 3 = 0 THEN size_ % 24 ELSE 12 END AS DOUBLE) AS warranty_months, CAST(length(description) AS DOUBLE) AS description_length, CAST(len(tags) AS DOUBLE) AS tag_count
  FROM lt_asof, lt_products p JOIN ca ON ca.category_id = p.category_id LEFT JOIN sl ON sl.product_id = p.id LEFT JOIN vw ON vw.product_id = p.id),
sp AS (SELECT *, CAST('0x' || md5(CAST(id AS VARCHAR))[1:8] AS BIGINT) % 5 = 0 AS is_test FROM pf)"""


def prices(t):
    return PR.price_frame(t.products, t.order_items, t.events, t.orders_as_of, t.events_as_of)


@query("pr_01_price_features", f"WITH {PRICE} SELECT id, " + ", ".join(f"round({f}, 6) AS {f}" for f in PRICE_FEATURES) + " FROM pf")
def _(t):
    return prices(t).select("id", *[F.round(f, 6).alias(f) for f in PRICE_FEATURES])


@query("win_05_category_context", f"WITH {PRICE} SELECT id, round(category_mean_price_loo, 6) AS loo_mean, round(category_p25_price, 6) AS p25, round(category_p75_price, 6) AS p75 FROM pf")
def _(t):
    return prices(t).select("id", F.round("category_mean_price_loo", 6).alias("loo_mean"), F.round("category_p25_price", 6).alias("p25"), F.round("category_p75_price", 6).alias("p75"))


@query("pr_02_hash_split", f"WITH {PRICE} SELECT id, is_test FROM sp")
def _(t):
    return PR.split(prices(t)).select("id", "is_test")


@query("pr_04_category_stats", f"""WITH {PRICE}, l AS (SELECT unnest([category_id, -1]) AS category_id, price, inventory, units_sold_90d FROM pf)
SELECT category_id, 'price' AS feature, round(quantile_cont(price, 0.25), 5) AS p25, round(quantile_cont(price, 0.5), 5) AS median, round(quantile_cont(price, 0.75), 5) AS p75 FROM l GROUP BY 1
UNION ALL SELECT category_id, 'inventory', round(quantile_cont(inventory, 0.25), 5), round(quantile_cont(inventory, 0.5), 5), round(quantile_cont(inventory, 0.75), 5) FROM l GROUP BY 1
UNION ALL SELECT category_id, 'units_sold_90d', round(quantile_cont(units_sold_90d, 0.25), 5), round(quantile_cont(units_sold_90d, 0.5), 5), round(quantile_cont(units_sold_90d, 0.75), 5) FROM l GROUP BY 1""")
def _(t):
    s = PR.category_stats(prices(t), ("price", "inventory", "units_sold_90d"))
    return s.select("category_id", "feature", *[F.round(c, 5).alias(c) for c in ("p25", "median", "p75")])


OUTLOOK = PRICE + """, ol AS (SELECT id, title, price, ln(category_mean_price_loo) AS log_pred, (exp(ln(category_mean_price_loo)) - price) / price AS delta FROM pf),
oo AS (SELECT *, exp(log_pred) AS pp, CASE WHEN delta > 0.04 THEN 'up' WHEN delta < -0.04 THEN 'down' ELSE 'stable' END AS price_trend,
  least(greatest(1.0 - least(0.1::DOUBLE / 0.5, 1.0) * 0.7::DOUBLE - least(abs(delta), 0.5) * 0.4::DOUBLE, 0.05), 0.99) AS conf FROM ol)"""


def outlook(t):
    return PR.price_outlook(prices(t).withColumn("log_pred", F.log("category_mean_price_loo")), 0.1)


@query("pr_07_price_outlook", f"WITH {OUTLOOK} SELECT id, round(pp, 2) AS predicted_price, price_trend, round(delta * 100, 3) AS delta_pct, round(conf, 4) AS confidence, round(exp(log_pred - 0.196::DOUBLE), 2) AS lower_bound, round(exp(log_pred + 0.196::DOUBLE), 2) AS upper_bound FROM oo")
def _(t):
    return outlook(t).select("id", "predicted_price", "price_trend", "delta_pct", "confidence", "lower_bound", "upper_bound")


@query("pr_08_opportunities", f"WITH {OUTLOOK} SELECT id, title, price_trend, round(price, 2) AS current_price, round(pp, 2) AS predicted_price, round((round(pp, 2) - price) * 100 / price, 2) AS delta_pct, round(conf, 4) AS confidence FROM oo WHERE price_trend = 'up' ORDER BY round(abs(round(pp, 2) - price), 6) DESC, id LIMIT 10")
def _(t):
    return PR.opportunities(outlook(t), t.products)


@query("pr_09_narratives", f"""WITH {OUTLOOK} SELECT id, CASE price_trend WHEN 'up' THEN 'The model prices this ' || printf('%.1f', floor(abs(round(delta * 100, 3)) * 10 + 0.5) / 10.0) || '% above its current listing, driven mainly by market context. There may be room to raise the price.'
  WHEN 'down' THEN 'The model prices this ' || printf('%.1f', floor(abs(round(delta * 100, 3)) * 10 + 0.5) / 10.0) || '% below its current listing, driven mainly by market context. It may be priced above what the market supports.'
  ELSE 'The current price is consistent with what the model expects for this product (within ' || printf('%.1f', floor(abs(round(delta * 100, 3)) * 10 + 0.5) / 10.0) || '%), based on market context.' END AS explanation FROM oo""")
def _(t):
    return PR.narrative(outlook(t), F.lit("market context")).select("id", "explanation")


@query("pr_10_price_evaluation", f"""WITH {OUTLOOK}, a AS (SELECT unnest(['model','category_baseline']) AS arm, price AS actual, unnest([exp(ln(category_mean_price_loo) + 0.01::DOUBLE), category_mean_price_loo]) AS predicted FROM pf)
SELECT arm, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 4) AS rmse, round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 4) AS r2, count(*) AS support,
  round(avg(CASE WHEN abs(predicted - actual) / actual <= 0.1 THEN 1.0 ELSE 0 END), 5) AS within_10pct FROM a GROUP BY 1""")
def _(t):
    e = PR.evaluation(prices(t).withColumn("log_pred", F.log("category_mean_price_loo") + 0.01))
    return e.select("arm", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2"), "support", "within_10pct")


def _price_model(t):
    return fitted_once(t, "price_prediction", _fit_price)


def _fit_price(t):
    data = materialise(PR.split(prices(t)), "prices")
    return data, PR.fit(data.where("NOT is_test"))


@query("pr_03_price_model")
def _(t):
    data, model = _price_model(t)
    return PR.evaluation(PR.predict(model, data.where("is_test")))


@query("pr_05_permutation_importance")
def _(t):
    data, model = _price_model(t)
    return PR.permutation_importance(model, data.where("is_test"), repeats=8)


@query("pr_06_local_contributions")
def _(t):
    data, model = _price_model(t)
    return PR.contributions(model, PR.predict(model, data), PR.category_stats(data))


def _model_outlook(t):
    """All products priced by the fitted model, with its deviation on the held-out ones."""
    data, model = _price_model(t)
    return PR.price_outlook(PR.predict(model, data), PR.residual_std(PR.predict(model, data.where("is_test"))))


@query("pr_07_model_outlook")
def _(t):
    return _model_outlook(t).select("id", "predicted_price", "price_trend", "delta_pct", "confidence", "lower_bound", "upper_bound")


@query("pr_08_model_opportunities")
def _(t):
    """Products that the model prices above their listing, and those it prices below, ten of each."""
    priced = materialise(_model_outlook(t), "model-outlook")
    return PR.opportunities(priced, t.products).unionByName(PR.opportunities(priced, t.products, "down"))


@query("pr_09_model_narratives")
def _(t):
    data, model = _price_model(t)
    named = PR.drivers(PR.contributions(model, PR.predict(model, data), PR.category_stats(data)))
    return PR.narrative(_model_outlook(t).join(named, "id", "left").withColumn("drivers", F.coalesce("drivers", F.lit("market context")))).select("id", "drivers", "explanation")


def observed(t):
    """What each of the five models sees, a row a value and day."""
    frame = SG.rfm_frame(t.users_with_signup, t.orders, t.order_items, t.session_events, t.reviews, t.orders_as_of)
    signals = R.item_signals(t.products, t.events, t.events_as_of).join(t.products.select("id", "launched_at"), "id")
    reviews = t.reviews.where(F.col("sentiment_label").isNotNull())
    share = {f"label:{name}": (F.col("sentiment_label") == name).cast("double") for name in ("negative", "neutral", "positive")}
    parts = [
        B.observations(frame.join(t.users_with_signup.select(F.col("id").alias("user_id"), "created_at"), "user_id"), "segmentation", F.col("created_at"), {c: F.col(c) for c in SEGMENT_FEATURES}),
        B.observations(panel(t), "forecasting", F.col("week"), {"units": F.col("units"), "avg_price": F.col("avg_price")}),
        B.observations(t.products, "price_prediction", F.col("launched_at"), {c: F.col(c) for c in ("price", "inventory", "rating_avg")}),
        B.observations(signals, "recommendation", F.col("launched_at"), {c: F.col(c) for c in ("popularity", "trending", "conversion", "availability")}),
        B.observations(reviews, "sentiment", F.col("created_at"), {**share, "chars": F.length(SE.review_text())}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("dr_04_model_baselines")
def _(t):
    moments, bins = B.sketch(observed(t))
    stored = work_dir(t.spark, "baselines")
    sinks.replace_version(moments, f"{stored}/moments", "model")
    sinks.replace_version(bins, f"{stored}/bins", "model")
    read = lambda table: t.spark.read.parquet(f"{stored}/{table}")
    return B.statistics(*B.merge(read("moments"), read("bins"))).withColumn("value", F.round("value", 4))


@query("dr_04_price_sketch", """WITH o AS (SELECT unnest(['price', 'inventory', 'rating_avg']) AS feature, unnest([price, inventory, rating_avg]) AS v FROM lt_products),
b AS (SELECT feature, v, CASE WHEN v = 0 THEN 0 ELSE sign(v) * exp((floor(ln(abs(v)) / ln(1.01::DOUBLE)) + 0.5::DOUBLE) * ln(1.01::DOUBLE)) END AS m FROM o),
s AS (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, list(m ORDER BY m) AS ms, count(*) FILTER (WHERE v = 0) / count(*) AS z FROM b GROUP BY 1)
SELECT feature, unnest(['count', 'mean', 'std', 'zero_ratio', 'p50', 'p90', 'p95']) AS statistic, round(unnest([CAST(n AS DOUBLE), mean, std, z,
  ms[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1], ms[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1], ms[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1]]), 4) AS value FROM s""")
def _(t):
    seen = B.observations(t.products, "price_prediction", F.col("launched_at"), {c: F.col(c) for c in ("price", "inventory", "rating_avg")})
    return B.statistics(*B.merge(*B.sketch(seen))).select("feature", "statistic", F.round("value", 4).alias("value"))
