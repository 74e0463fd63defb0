"""Depth and runs over a stream of steps."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loops import shared_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of steps: users are paths, event types nodes."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_depth(events: DataFrame) -> DataFrame:
    """event_type, depth: a running count."""
    return events.groupBy("event_type").agg(F.count("*").alias("depth"))


def windowed_depth(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, event_type, depth over tumbling windows; in append mode rows later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("depth"))
    return w.select(F.col("window.start").alias("start"), "event_type", "depth")


def session_runs(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, n: bursts of a path's steps that lie less than ``gap`` apart."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has written to files once all that is there has been read.

    In append mode a window is written once, when the watermark has passed its end, so state stays bounded and late rows are left
    out; windows that are still open are not there. In complete mode each batch replaces the table of the one before.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    last: list[str] = []

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        last[:] = [f"{folder}/rows-{number}"]

    out.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last)
