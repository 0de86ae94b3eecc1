"""Fitted models against their baselines, and the rows made from their predictions against plain formulas."""
import math

import pytest

from shoplattice.constants import PRICE_FEATURES
from shoplattice.operators import forecast as FC, pricing as PR
from shoplattice.plans import planning_queries as PQ
from shoplattice.plans.registry import PLANS


@pytest.fixture(scope="module")
def priced(tables):
    data, model = PQ._price_model(tables)
    return data, model, PQ._model_outlook(tables).toPandas().set_index("id")


def test_price_model_beats_the_category_mean(priced):
    data, model, _ = priced
    arms = {r["arm"]: r for r in PR.evaluation(PR.predict(model, data.where("is_test"))).collect()}
    assert arms["model"]["mae"] < arms["category_baseline"]["mae"]
    assert arms["model"]["r2"] > max(0.5, arms["category_baseline"]["r2"])


def test_outlook_of_the_model(priced):
    data, model, got = priced
    held_out = [math.log(r["price"]) - r["log_pred"] for r in PR.predict(model, data.where("is_test")).select("price", "log_pred").collect()]
    mean = sum(held_out) / len(held_out)
    spread = max(math.sqrt(sum((x - mean) ** 2 for x in held_out) / len(held_out)), 1e-6)
    for r in PR.predict(model, data).select("id", "price", "log_pred").collect():
        delta, row = (math.exp(r["log_pred"]) - r["price"]) / r["price"], got.loc[r["id"]]
        assert row["predicted_price"] == pytest.approx(math.exp(r["log_pred"]), abs=0.006)
        assert row["price_trend"] == ("up" if delta > 0.04 else "down" if delta < -0.04 else "stable")
        assert row["confidence"] == pytest.approx(min(max(1 - min(spread / 0.5, 1) * 0.7 - min(abs(delta), 0.5) * 0.4, 0.05), 0.99), abs=1e-4)
        assert row["lower_bound"] <= row["predicted_price"] <= row["upper_bound"]


def test_opportunities_go_by_the_gap(priced, tables):
    _, _, outlook = priced
    got = PLANS["pr_08_model_opportunities"](tables).toPandas()
    for direction in ("up", "down"):
        some = outlook[outlook["price_trend"] == direction]
        gap = (some["predicted_price"] - some["price"]).abs().round(6)
        want = sorted(zip(-gap, some.index))[:10]
        assert set(got[got["price_trend"] == direction]["id"]) == {i for _, i in want}


def test_narratives_name_the_strongest_drivers(priced, tables):
    data, model, outlook = priced
    parts = PR.contributions(model, PR.predict(model, data), PR.category_stats(data)).where("rank <= 2").toPandas()
    rows = PLANS["pr_09_model_narratives"](tables).toPandas().set_index("id")
    assert set(rows.index) == set(outlook.index)
    for i, some in parts.groupby("id"):
        assert set(some["feature"]) <= set(PRICE_FEATURES)
        names = " and ".join(f.replace("_", " ") for f in some.sort_values("rank")["feature"])
        assert rows.loc[i, "drivers"] == names and names in rows.loc[i, "explanation"]
        assert ("below" if outlook.loc[i, "price_trend"] == "down" else "above" if outlook.loc[i, "price_trend"] == "up" else "consistent") in rows.loc[i, "explanation"]


@pytest.mark.parametrize("better", ["advanced", "naive"])
def test_the_forecast_with_the_lesser_error_serves(spark, better):
    other = "naive" if better == "advanced" else "advanced"
    rows = spark.range(40).selectExpr("id AS product_id", "CAST(id % 7 AS double) AS units", f"CAST(id % 7 AS double) + 0.5 AS {better}", f"CAST(id % 7 AS double) - 3 AS {other}")
    chosen = FC.select_model(rows).first()
    assert (chosen["selected_model"] == "seasonal_naive") == (better == "naive")
    assert chosen[f"{better}_mae"] < chosen[f"{other}_mae"]
