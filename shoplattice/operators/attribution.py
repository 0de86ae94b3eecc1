"""Click and conversion attribution: newest earlier impression of the same user and product."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoplattice.constants import CLICK_WINDOW_HOURS, CONVERSION_WINDOW_HOURS


def _window(hours_click: int, hours_conversion: int) -> Column:
    return F.when(F.col("event_type") == "click", hours_click).otherwise(hours_conversion)


def attributed_events(
    impressions: DataFrame, events: DataFrame,
    click_hours: int = CLICK_WINDOW_HOURS, conversion_hours: int = CONVERSION_WINDOW_HOURS,
) -> DataFrame:
    """Each click or purchase with the impression it is credited to.

    Written as an as-of scan rather than a range join: impressions and actions
    share one ordered stream per (user, product, time slice) and the last
    impression is carried forward. A slice is as long as the longest window, and
    every impression is also offered to the following slice, so no user or
    product is ever held whole by one task.
    """
    slice_us = conversion_hours * 3_600_000_000
    us = F.unix_micros(F.col("at").cast("timestamp"))
    shown = impressions.select("user_id", "product_id", F.col("served_at").alias("at"), "impression_id",
                               F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("long").alias("event_id"))
    acts = events.where(F.col("event_type").isin("click", "purchase")).select(
        "user_id", "product_id", F.col("occurred_at").alias("at"), F.lit(None).cast("long").alias("impression_id"),
        "event_type", F.col("id").alias("event_id"))
    base = F.floor(us / slice_us)
    shown = shown.withColumn("_us", us).withColumn("_slice", F.explode(F.array(base, base + 1)))
    acts = acts.withColumn("_us", us).withColumn("_slice", base)
    w = W.partitionBy("user_id", "product_id", "_slice").orderBy(
        "_us", F.col("event_id").isNotNull(), "impression_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("impression_id").isNotNull(), F.struct("impression_id", "_us")), ignorenulls=True).over(w)
    seen = shown.unionByName(acts).withColumn("_last", last).where(F.col("event_id").isNotNull() & F.col("_last").isNotNull())
    limit = _window(click_hours, conversion_hours).cast("long") * 3_600_000_000
    return seen.where(F.col("_us") - F.col("_last._us") <= limit).select(
        "event_id", "event_type", F.col("_last.impression_id").alias("impression_id"))


def attribute(impressions: DataFrame, events: DataFrame, **windows: int) -> DataFrame:
    """Impressions with ``clicked`` and ``converted`` flags; a conversion also counts as a click."""
    hits = attributed_events(impressions, events, **windows).groupBy("impression_id").agg(
        F.lit(True).alias("_c"), F.max(F.col("event_type") == "purchase").alias("_p"))
    return impressions.join(hits, "impression_id", "left").withColumns({
        "clicked": F.coalesce("_c", F.lit(False)), "converted": F.coalesce("_p", F.lit(False))}).drop("_c", "_p")
