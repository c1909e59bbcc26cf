"""Event streams: file replay, sessions that close after a silence, delayed and debounced onsets in keyed state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cadenza-")
    return f"{shared.rstrip('/')}/streams/{uuid.uuid4().hex}"


def closed_sessions(spark: SparkSession, sf_dir: str, gap: str = "3 hours", late: str = "0 seconds") -> DataFrame:
    """Sessions of the replayed events that the watermark has closed: those that end more than the gap before the last event."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    base = folder(spark)
    # a pattern, as the table may be one file; all files are one batch, so their order can't make rows late
    source = spark.readStream.schema(schema).parquet(f"{root}/event[s].parquet")
    timed = source.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n"))
    writer = grouped.select("user_id", "begin", "end", "n").writeStream.outputMode("append").format("parquet")
    query = writer.option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("user_id long, begin timestamp, end timestamp, n long").parquet(f"{base}/out")
    return out.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
