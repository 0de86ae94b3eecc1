"""Streaming queries: each drains the event table as a stream and is compared with batch SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from shoplattice.functions.scalars import micros
from shoplattice.operators import sentiment as SE
from shoplattice.operators.sessions import sessionise
from shoplattice.plans.analytics_queries import ATTRIBUTED
from shoplattice.plans.registry import query
from shoplattice.streaming import events as ST, state as KS


def stream(t, repeat: str | None = None):
    """The event table, delivered in four slices of time and read one slice a trigger."""
    return ST.replayed(t.raw("events"), repeat=repeat)


@query("st_01_ingest", """SELECT CASE WHEN event_type IN ('signup', 'error') THEN 'Unknown event_type ''' || event_type || '''.' ELSE 'accepted' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    raw = stream(t, repeat="30 minutes").withColumn("event_type", F.when(F.col("raw_type") == "view", "product_view").otherwise(F.col("raw_type"))).drop("raw_type")
    good, bad = ST.ingest(raw, t.products, t.users)
    a = t.spark.read.parquet(good).select(F.lit("accepted").alias("reason"))
    return a.unionByName(t.spark.read.parquet(bad).select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("st_02_stream_attribution", f"WITH {ATTRIBUTED} SELECT impression_id, converted FROM att WHERE clicked")
def _(t):
    buckets = KS.buckets_for(t.raw("events").count() // 4)  # four triggers
    actions = ST.run_to_table(KS.credited_actions(stream(t), ST.LATENESS, buckets), "credited", keyed_state=True)
    return actions.groupBy("impression_id").agg(F.max(F.col("event_type") == "purchase").alias("converted"))


def closed(t, days: int):
    """Append mode emits a window once the watermark passes its end."""
    return F.col("window_start") + F.expr(f"interval {days} days") <= F.lit(t.events_as_of.isoformat(sep=" ")).cast("timestamp") - F.expr("interval 1 hour")


@query("st_03_live_funnel", """SELECT epoch_us(date_trunc('day', occurred_at)) AS window_us, count(*) FILTER (WHERE event_type = 'product_view') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS revenue FROM lt_events, lt_asof WHERE date_trunc('day', occurred_at) + INTERVAL 1 DAY <= e_now - INTERVAL 1 HOUR GROUP BY 1""")
def _(t):
    out = ST.run_to_table(ST.live_funnel(stream(t)), "funnel").where(closed(t, 1))
    return out.select(F.unix_micros("window_start").alias("window_us"), "views", "carts", "purchases", F.round("revenue", 4).alias("revenue"))


@query("st_03_sliding_trending", """WITH w AS (SELECT product_id, unnest(generate_series(date_trunc('day', occurred_at) - INTERVAL 13 DAY, date_trunc('day', occurred_at), INTERVAL 1 DAY)) AS s FROM lt_events WHERE event_type IN ('product_view','add_to_cart','purchase'))
SELECT epoch_us(s) AS window_us, product_id, count(*) AS n FROM w, lt_asof WHERE s + INTERVAL 14 DAY <= e_now - INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(t):
    out = ST.run_to_table(ST.sliding_trending(stream(t)), "trend").where(closed(t, 14))
    return out.select(F.unix_micros("window_start").alias("window_us"), "product_id", "n")


@query("st_04_sessions_batch", "SELECT user_id, count(DISTINCT session_id) AS sessions, count(*) AS events FROM lt_sessions GROUP BY 1")
def _(t):
    return sessionise(t.events).groupBy("user_id").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"))


@query("st_04_session_stream", """SELECT user_id, epoch_us(min(occurred_at)) AS start_us, count(*) AS events FROM lt_sessions, lt_asof GROUP BY user_id, session_id HAVING max(occurred_at) + INTERVAL 30 MINUTE <= any_value(e_now) - INTERVAL 1 HOUR""")
def _(t):
    out = ST.run_to_table(ST.sessions(stream(t)), "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), "events")


@query("st_05_cart_state", """SELECT user_id, product_id FROM lt_events WHERE event_type IN ('add_to_cart','remove_from_cart') GROUP BY 1, 2 HAVING arg_max(event_type, (occurred_at, id)) = 'add_to_cart'""")
def _(t):
    state = ST.newest(ST.run_to_table(KS.cart_updates(stream(t), ST.LATENESS), "cart", "update", keyed_state=True), ["user_id", "product_id"])
    return state.where("event_type = 'add_to_cart'").select("user_id", "product_id")


@query("st_06_last_active", "SELECT user_id, epoch_us(max(occurred_at)) AS last_us FROM lt_events GROUP BY 1")
def _(t):
    out = ST.newest(ST.run_to_table(KS.last_active(stream(t), ST.LATENESS), "active", "update", keyed_state=True), ["user_id"])
    return out.select("user_id", F.unix_micros("last_active_at").alias("last_us"))


@query("st_07_incremental_scoring", "SELECT doc_id AS id, CASE WHEN length(text) % 2 = 0 THEN 'positive' ELSE 'negative' END AS label FROM documents")
def _(t):
    label = F.when(F.length("text") % 2 == 0, "positive").otherwise("negative")
    return ST.score_incrementally(ST.document_stream(t.spark, t.path), lambda b: b.select("id", label.alias("label")))


@query("st_08_late_rows", """SELECT id FROM (SELECT id, occurred_at, max(occurred_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT id, CASE WHEN id % 40 = 7 THEN occurred_at - INTERVAL 3 HOUR ELSE occurred_at END AS occurred_at FROM lt_events)) WHERE occurred_at < seen - INTERVAL 1 HOUR""")
def _(t):
    shifted = t.events.select("id", F.when(F.col("id") % 40 == 7, F.col("occurred_at") - F.expr("interval 3 hours")).otherwise(F.col("occurred_at")).alias("occurred_at"))
    return ST.late_rows(shifted).select("id")


@query("st_08_late_stream", """SELECT id, occurred_at < seen - INTERVAL 1 HOUR AS late FROM (SELECT id, occurred_at, max(occurred_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT id, CASE WHEN id % 40 = 7 THEN occurred_at - INTERVAL 3 HOUR ELSE occurred_at END AS occurred_at FROM lt_events)) WHERE seen IS NOT NULL""")
def _(t):
    events = ST.arriving(t.raw("events"))
    shifted = events.withColumn("occurred_at", F.when(F.col("id") % 40 == 7, F.col("occurred_at") - F.expr("interval 3 hours")).otherwise(F.col("occurred_at")))
    on_time, late = ST.split_late(shifted.select("id", "occurred_at"))
    both = on_time.select("id", F.lit(False).alias("late")).unionByName(late.select("id", F.lit(True).alias("late")))
    return both.join(both.agg(F.min("id").alias("first")), F.col("id") > F.col("first")).select("id", "late")


@query("st_07_model_scoring")
def _(t):
    from shoplattice.plans.review_queries import classifier
    _, model = classifier(t)
    return ST.score_incrementally(ST.document_stream(t.spark, t.path), lambda batch: SE.score_text(model, batch).select("id", "label", F.round("score", 5).alias("score")))
