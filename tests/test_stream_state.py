"""Keyed stream state: expiry by event time, credits, late rows to a table of their own."""
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from shoplattice.session import work_dir
from shoplattice.streaming import events as ST, state as KS
from tests.conftest import DATA

START = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, event_type string, product_id long, occurred_at timestamp"


def streamed(spark, batches):
    """One trigger a list of (id, user, type, product, hours after the start)."""
    folder = work_dir(spark, "test-batches")
    for rows in batches:
        rows = [(i, u, kind, p, START + timedelta(hours=h)) for i, u, kind, p, h in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def held(spark, checkpoint, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key.user_id").distinct()


def test_idle_carts_leave_the_state(spark):
    stream = streamed(spark, [
        [(1, 1, "add_to_cart", 10, 0), (2, 2, "add_to_cart", 10, 0), (3, 2, "add_to_cart", 11, 1)], [(4, 2, "remove_from_cart", 11, 20)],
        [(5, 2, "add_to_cart", 12, 40)], [(6, 3, "add_to_cart", 13, 60)], [(7, 3, "add_to_cart", 14, 61)]])
    ck = work_dir(spark, "cart-state")
    rows = ST.run_to_table(KS.cart_updates(stream, "1 hour", idle_hours=24), "cart", "update", keyed_state=True, checkpoint=ck)
    state = {(r.user_id, r.product_id): r.event_type for r in ST.newest(rows, ["user_id", "product_id"]).collect()}
    assert state == {(1, 10): "expired", (2, 10): "add_to_cart", (2, 11): "remove_from_cart", (2, 12): "add_to_cart", (3, 13): "add_to_cart", (3, 14): "add_to_cart"}
    assert {r.user_id for r in held(spark, ck, "items").collect()} == {2, 3}


def test_idle_users_leave_the_state(spark):
    stream = streamed(spark, [[(1, 1, "click", 1, 0), (2, 2, "click", 1, 2)], [(3, 2, "click", 1, 30)], [(4, 2, "click", 1, 29)], [(5, 3, "click", 1, 50)], [(6, 3, "click", 1, 51)]])
    ck = work_dir(spark, "active-state")
    rows = ST.run_to_table(KS.last_active(stream, "2 hours", idle_hours=10), "active", "update", keyed_state=True, checkpoint=ck)
    newest = {r.user_id: r.last_active_at for r in ST.newest(rows, ["user_id"]).collect()}
    assert newest == {1: START, 2: START + timedelta(hours=30), 3: START + timedelta(hours=51)}
    assert {r.user_id for r in held(spark, ck, "newest").collect()} == {3}


def test_actions_are_credited_once_to_the_newest_impression(spark):
    stream = streamed(spark, [
        [(1, 1, "product_view", 5, 0), (2, 1, "product_view", 5, 1), (3, 1, "click", 5, 2), (4, 1, "click", 6, 2)],
        [(5, 1, "product_view", 5, 3), (6, 1, "click", 5, 2.5), (7, 1, "click", 5, 8), (8, 1, "click", 5, 10)],
        [(9, 1, "purchase", 5, 50), (10, 1, "purchase", 5, 52)]])
    got = ST.run_to_table(KS.credited_actions(stream, "1 hour"), "credits", keyed_state=True).collect()
    assert sorted((r.event_id, r.event_type, r.impression_id) for r in got) == [(3, "click", 2), (6, "click", 2), (7, "click", 5), (9, "purchase", 5)]


def test_credits_meet_in_buckets(spark):
    """Many users and products are few keys of the state, each holding only what an action can still be credited to."""
    views = [(n, n % 40, "product_view", n % 7, n / 280) for n in range(280)]
    clicks = [(1000 + n, n % 40, "click", n % 7, 2) for n in range(280)]
    later = [(2000, 1, "product_view", 1, 60), (2001, 1, "purchase", 1, 40)]
    stream, ck = streamed(spark, [views, clicks, later, [(2002, 1, "click", 1, 61), (2003, 2, "product_view", 2, 100)], [(2004, 2, "product_view", 2, 101)]]), work_dir(spark, "credit-state")
    got = ST.run_to_table(KS.credited_actions(stream, "1 hour", buckets=3), "credits", keyed_state=True, checkpoint=ck).collect()
    assert {(r.event_id, r.impression_id) for r in got} == {(1000 + n, n) for n in range(280)} | {(2001, 1), (2002, 2000)} and len(got) == 282
    state = spark.read.format("statestore").option("stateVarName", "shown").load(ck)
    assert state.select("key").distinct().count() <= 3 and state.count() < 280


@pytest.mark.parametrize("files", [1, 3])
def test_late_rows_of_a_stream(tables, files):
    moved = F.when(F.col("id") % 13 == 5, F.col("occurred_at") - F.expr("interval 5 hours")).otherwise(F.col("occurred_at"))
    stream = ST.arriving(tables.raw("events"), files=files).select("id", moved.alias("occurred_at"))
    on_time, late = ST.split_late(stream)
    want = {r.id for r in ST.late_rows(tables.events.select("id", moved.alias("occurred_at"))).collect()}
    assert want and {r.id for r in late.collect()} == want
    assert {r.id for r in on_time.collect()} == {r.id for r in tables.events.select("id").collect()} - want


def test_slices_of_several_files_are_one_trigger(tables):
    one = ST.run_to_table(ST.live_funnel(ST.replayed(tables.raw("events"))), "funnel").drop("batch_id").withColumn("revenue", F.round("revenue", 4)).collect()
    several = ST.run_to_table(ST.live_funnel(ST.replayed(tables.raw("events"), files=3)), "funnel").drop("batch_id").withColumn("revenue", F.round("revenue", 4)).collect()
    assert sorted(map(str, one)) == sorted(map(str, several)) and one


def test_documents_stream_from_a_file_and_a_folder(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (DATA, str(tmp_path)):
        scored = ST.score_incrementally(ST.document_stream(spark, folder), lambda batch: batch.select("id", F.length("text").alias("n")))
        assert sorted(map(tuple, scored.collect())) == sorted((r.doc_id, len(r.text)) for r in docs.collect())
