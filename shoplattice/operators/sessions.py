"""Sessionisation of the event stream (batch)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplattice.functions.grouped import running_base

SESSION_GAP_SECONDS = 1800


def sessionise(events: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Add ``session_id``: a user's events less than the gap apart share a session.

    A hot user is ordered hour by hour, see ``running_base``.
    """
    cut = events.withColumn("_hour", F.date_trunc("hour", "occurred_at"))
    numbered = running_base(cut, "user_id", "_hour", "occurred_at", "id", gap_seconds)
    return numbered.withColumn(
        "session_id", F.concat(F.col("user_id"), F.lit("-"), F.col("session_no"))).drop("_hour", "session_no")
