"""Structured Streaming versions of the event operators. Each has a batch twin under ``operators``."""
from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoplattice.constants import TRENDING_TYPES
from shoplattice.operators.quality import split_valid, validate_events
from shoplattice.session import work_dir

LATENESS = "1 hour"


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: Events of one slice that go into one file.
FILE_ROWS = 1_000_000


def time_slices(raw: DataFrame, parts: int = 4, repeat: str | None = None, files: int = 1) -> str:
    """Write raw events into a folder as slices of time, one after another, as a collector would deliver them; with
    ``repeat`` (an interval) each slice delivers the end of the one before it again. A slice is ``files`` files."""
    folder = work_dir(raw.sparkSession, "slices")
    events = raw.select("event_id", "ts", "user_id", "event_type", "value", "props")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span["lo"] is None:
        events.write.mode("append").parquet(folder)
        return folder
    edges = [span["lo"] + (span["hi"] - span["lo"]) * n / parts for n in range(parts)] + [span["hi"] + timedelta(seconds=1)]
    for low, high in zip(edges, edges[1:]):
        start = F.lit(low.isoformat(sep=" ")).cast("timestamp_ntz")
        since = start - F.expr(f"interval {repeat}") if repeat and low != edges[0] else start
        rows = events.where((F.col("ts") >= since) & (F.col("ts") < F.lit(high.isoformat(sep=" ")).cast("timestamp_ntz")))
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(folder)
    return folder


def replayed(raw: DataFrame, parts: int = 4, repeat: str | None = None, files: int | None = None) -> DataFrame:
    """The event table as a stream of time slices, one slice a trigger; large slices are several files, read at once."""
    files = files or max(1, raw.count() // (parts * FILE_ROWS))
    return event_stream(raw.sparkSession, time_slices(raw, parts, repeat, files), files_per_trigger=files)


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet folder as a stream with the logical event columns and an event-time timestamp."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    kind = F.col("event_type")
    mapped = (F.when(kind == "view", "product_view").when((kind == "click") & (F.col("event_id") % 10 == 0), "wishlist")
              .when(kind == "signup", "add_to_cart").when(kind == "error", "remove_from_cart").otherwise(kind))
    return raw.select(F.col("event_id").alias("id"), "user_id", mapped.alias("event_type"), kind.alias("raw_type"),
                      F.get_json_object("props", "$.k").cast("long").alias("product_id"), F.lit(1).alias("quantity"), "value",
                      F.col("ts").cast("timestamp").alias("occurred_at"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(raw: DataFrame, parts: int = 4, files: int | None = None) -> DataFrame:
    """The event table as a stream in order of arrival (the id), cut into ranges of ids, one range a trigger."""
    spark = raw.sparkSession
    folder = work_dir(spark, "arrivals")
    files = files or max(1, raw.count() // (parts * FILE_ROWS))
    events = raw.select("event_id", "ts", "user_id", "event_type", "value", "props")
    span = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    step = ((span["hi"] or 0) - (span["lo"] or 0)) // parts + 1
    for n in range(parts):
        low = (span["lo"] or 0) + n * step
        rows = events.where((F.col("event_id") >= low) & (F.col("event_id") < low + step))
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(folder)
    return event_stream(spark, folder, files_per_trigger=files)


def run_to_table(stream: DataFrame, label: str, mode: str = "append", keyed_state: bool = False, checkpoint: str | None = None) -> DataFrame:
    """Drain the stream into a Parquet table in the shared folder and read it back.

    Update-mode rows are appended with their batch number; readers keep the newest per key. ``keyed_state`` runs the query
    on the RocksDB state store, which processors with timers and list state need.
    """
    spark = stream.sparkSession
    out, ck = work_dir(spark, label), checkpoint or work_dir(spark, f"{label}-ck")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    before = spark.conf.get(STORE)
    if keyed_state:
        spark.conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(out).drop("part")


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row per key of an update-mode table."""
    cols = [c for c in table.columns if c not in keys and c != "batch_id"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select(*keys, "s.*")


def ingest(stream: DataFrame, products: DataFrame, users: DataFrame, dedupe_within: str | None = LATENESS) -> tuple[str, str]:
    """Validated events and rejects into two folders; a redelivered event id is stored once.

    Batches are written to a folder named after the batch, so a retried batch replaces itself.
    """
    spark = stream.sparkSession
    good, bad, ck = work_dir(spark, "accepted"), work_dir(spark, "rejected"), work_dir(spark, "ingest-ck")
    clean = stream.withWatermark("occurred_at", dedupe_within).dropDuplicatesWithinWatermark(["id"]) if dedupe_within else stream

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_events(batch, products, users).persist()  # the stateful batch runs once for both folders
        try:
            accepted, rejected = split_valid(checked)
            accepted.write.mode("overwrite").parquet(f"{good}/part={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{bad}/part={batch_id}")
        finally:
            checked.unpersist()

    query = clean.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return good, bad


def live_funnel(stream: DataFrame, window: str = "1 day") -> DataFrame:
    kind = F.col("event_type")
    return stream.withWatermark("occurred_at", LATENESS).groupBy(F.window("occurred_at", window).alias("w")).agg(
        F.count_if(kind == "product_view").alias("views"), F.count_if(kind == "add_to_cart").alias("carts"), F.count_if(kind == "purchase").alias("purchases"),
        F.sum(F.when(kind == "purchase", F.col("value"))).alias("revenue")).select(F.col("w.start").alias("window_start"), "views", "carts", "purchases", "revenue")


def sliding_trending(stream: DataFrame, window: str = "14 days", slide: str = "1 day") -> DataFrame:
    return stream.where(F.col("event_type").isin(*TRENDING_TYPES)).withWatermark("occurred_at", LATENESS).groupBy(
        F.window("occurred_at", window, slide).alias("w"), "product_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "product_id", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("occurred_at", LATENESS).groupBy("user_id", F.session_window("occurred_at", gap).alias("w")).agg(
        F.count("*").alias("events"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought")).select(
        "user_id", F.col("w.start").alias("session_start"), "events", "bought")


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table as a stream of (id, text), be it one file or a folder of files: named by a pattern, since a stream
    takes the path of a folder only."""
    return spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/documents.parque[t]").select(F.col("doc_id").alias("id"), "text")


def score_incrementally(stream: DataFrame, score: Callable[[DataFrame], DataFrame], label: str = "scored") -> DataFrame:
    """Apply a batch scorer to every micro-batch of new reviews."""
    spark = stream.sparkSession
    out, ck = work_dir(spark, label), work_dir(spark, f"{label}-ck")

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out).drop("part")


def late_rows(events: DataFrame, delay_minutes: int = 60, seen: int | None = None) -> DataFrame:
    """Batch twin of the watermark: rows older than the newest earlier arrival minus the delay; ``seen`` is the newest
    event time (microseconds) that arrived before all of ``events``.

    Arrival order is the id. A running maximum over everything would need one
    task, so arrivals are cut into id ranges and those into wider ranges, each a
    thousand times the one below: an ordered window never holds more than the
    rows of one range, or the summaries of one wider range, until a few are left.
    """
    from pyspark.sql import Window as W
    start = F.lit(seen).cast("long")
    cut = events.withColumns({"_r": F.floor(F.col("id") / 1000), "_us": F.unix_micros(F.col("occurred_at").cast("timestamp"))})
    before = lambda value, part, order: F.max(value).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    per = cut.groupBy("_r").agg(F.max("_us").alias("_m")).withColumn("_w", F.floor(F.col("_r") / 1000))
    wide = per.groupBy("_w").agg(F.max("_m").alias("_m")).withColumn("_t", F.floor(F.col("_w") / 1000))
    top = wide.groupBy("_t").agg(F.max("_m").alias("_m"))
    top = top.select("_t", F.greatest(before("_m", F.lit(1), "_t"), start).alias("_b"))
    wide = wide.join(top, "_t").select("_w", F.greatest(before("_m", "_t", "_w"), "_b").alias("_b"))
    per = per.join(wide, "_w").select("_r", F.greatest(before("_m", "_w", "_r"), "_b").alias("_base"))
    seen_rows = cut.withColumn("_in", before("_us", "_r", "id")).join(per, "_r").withColumn("_seen", F.greatest("_in", "_base"))
    return seen_rows.where(F.col("_us") < F.col("_seen") - delay_minutes * 60_000_000).drop("_r", "_us", "_in", "_base", "_seen")


def split_late(stream: DataFrame, delay_minutes: int = 60) -> tuple[DataFrame, DataFrame]:
    """The stream's on-time and late rows, each in a table of its own.

    Every batch writes the newest event time of its arrivals beside its rows, in a folder named after the batch. The
    running watermark of a batch is the newest of those of the batches before it, so a retried batch finds the same one and
    replaces its own folders. Inside the batch it moves row by row, as in ``late_rows``.
    """
    spark = stream.sparkSession
    on_time, late, marks, ck = (work_dir(spark, label) for label in ("on-time", "late", "arrival-marks", "late-ck"))
    kept, mark = stream.schema, "batch long, newest long"
    spark.createDataFrame([], mark).write.parquet(f"{marks}/part=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            earlier = spark.read.schema(mark).parquet(marks).where(F.col("batch") < batch_id)
            seen = earlier.agg(F.max("newest")).first()[0]
            behind = late_rows(rows, delay_minutes, seen)
            behind.write.mode("overwrite").parquet(f"{late}/part={batch_id}")
            rows.join(spark.read.schema(kept).parquet(f"{late}/part={batch_id}").select("id"), "id", "left_anti").write.mode("overwrite").parquet(f"{on_time}/part={batch_id}")
            newest = rows.agg(F.lit(batch_id).cast("long").alias("batch"), F.max(F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("newest"))
            newest.write.mode("overwrite").parquet(f"{marks}/part={batch_id}")
        finally:
            rows.unpersist()

    stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return tuple(spark.read.schema(kept).parquet(folder) for folder in (on_time, late))
