"""Training baselines as mergeable sketches, written a day at a time.

A sketch row holds a day's count, sum, sum of squares and zeros of a feature, a bin row the number of its values in one bin
of equal relative width. Both merge by addition, so days (or halves of a day) written apart give what the whole gives: the
moments up to rounding, the quantiles within ``WIDTH`` of the value at the wanted rank.
"""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shoplattice.functions.scalars import day
from shoplattice.session import materialise

#: Relative width of a bin; a quantile is off by half of it at most.
WIDTH = 0.01
_BASE = math.log1p(WIDTH)


def observations(rows: DataFrame, model: str, at: Column, features: Mapping[str, Column]) -> DataFrame:
    """(model, feature, day, value) of every row and feature; null values are no observations."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value")) for name, value in features.items()]))
    return rows.select(F.lit(model).alias("model"), day(at).alias("day"), each.alias("o")).select("model", "o.feature", "day", "o.value").where("value is not null")


def _bin(value: Column) -> Column:
    """Sign and whole logarithm: 0 for zero, otherwise the bin's number, apart from zero by its sign."""
    size = F.floor(F.log(F.abs(value)) / _BASE).cast("long")
    return F.when(value == 0, F.struct(F.lit(0).alias("sign"), F.lit(0).cast("long").alias("size"))).otherwise(
        F.struct(F.signum(value).cast("int").alias("sign"), size.alias("size")))


def sketch(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments and bins by (model, feature, day), from one pass over the observations: both come from the written bins."""
    keys = ["model", "feature", "day"]
    v = F.col("value")
    each = observed.select(*keys, "value", _bin(v).alias("b")).groupBy(*keys, "b.sign", "b.size").agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.count_if(v == 0).alias("zeros"))
    bins = materialise(each, "sketch")
    moments = bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "zeros")])
    return moments, bins.select(*keys, "sign", "size", "n")


def merge(moments: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The days of each (model, feature) added up."""
    keys = ["model", "feature"]
    summed = moments.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "zeros")])
    return summed, bins.groupBy(*keys, "sign", "size").agg(F.sum("n").alias("n"))


def statistics(moments: DataFrame, bins: DataFrame, quantiles: Mapping[str, float] = {"p50": 0.5, "p90": 0.9, "p95": 0.95}) -> DataFrame:
    """Tall (model, feature, statistic, value): count, mean, std (n - 1), zero share, and quantiles from the merged bins.

    A feature's bins are few (some hundred for each power of ten), so they are ordered in one array."""
    mean = F.col("total") / F.col("n")
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    middle = F.col("sign") * F.exp((F.col("size") + 0.5) * _BASE)
    ordered = bins.select("model", "feature", middle.alias("middle"), "n").groupBy("model", "feature").agg(F.array_sort(F.collect_list(F.struct("middle", "n"))).alias("bins"))
    both = moments.join(ordered, ["model", "feature"])

    def at(q: float) -> Column:
        rank = F.floor(F.lit(q) * (F.col("n") - 1)) + 1
        found = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value")), lambda a, b: F.struct(
            (a["seen"] + b["n"]).alias("seen"), F.when(a["value"].isNull() & (a["seen"] + b["n"] >= rank), b["middle"]).otherwise(a["value"]).alias("value")))
        return found["value"]

    values = {"count": F.col("n").cast("double"), "mean": mean, "std": F.sqrt(spread), "zero_ratio": F.col("zeros") / F.col("n"), **{name: at(q) for name, q in quantiles.items()}}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), value.alias("value")) for name, value in values.items()]))
    return both.select("model", "feature", each.alias("s")).select("model", "feature", "s.statistic", "s.value")
