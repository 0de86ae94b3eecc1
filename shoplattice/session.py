"""Session defaults and the shared work area."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra) -> SparkSession:
    """Session with adaptive execution on; values already set by the cluster win."""
    builder = (
        SparkSession.builder.appName("shoplattice")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder. Only a local master may fall
    back to a temporary folder, because there every task sees the same disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.gettempdir() + "/shoplattice"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss. Files of at most
    ``file_rows`` rows (0: no limit) let later passes read in more tasks than wrote them."""
    path = work_dir(df.sparkSession, label)
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def read_in_parts(written: DataFrame, rows: int) -> Iterator[None]:
    """Plans made inside read ``written`` (of ``materialise``) by about ``rows`` rows a task: what packs well on disk
    may be many times as large in memory. A row group isn't split."""
    conf, files, count = written.sparkSession.conf, written.inputFiles(), written.count()
    if not files or not count:
        yield
        return
    length = written.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    wanted = {"spark.sql.files.maxPartitionBytes": max(1, length * rows // count), "spark.sql.files.openCostInBytes": 0}
    before = {key: conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)
