"""Daily OpEx per site from a stream of cost events (Structured Streaming).

``readStream`` over a folder of Parquet files -> event time as TIMESTAMP
(watermarks refuse TIMESTAMP_NTZ) -> 1-day watermark -> tumbling 1-day
windows per factory -> sum of OpEx.  Each micro-batch writes the windows it
changed into its own folder of a Parquet sink (overwritten when the batch is
run again, so exactly once), and the current value of a window is that of its
last batch: open windows are part of the answer.  State holds only the open
windows; rows older than the watermark are dropped, which is the late-data
rule.  The checkpoint lives in the shared folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"  # partition folder of the sink
WINDOW_COLUMNS = "window_start timestamp, window_end timestamp, factory string, total_opex double, events long"
EVENT_COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT_COLUMNS,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def daily_kpis(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Windowed OpEx per factory: (window_start, window_end, factory, total_opex, events)."""
    rec = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("factory"),
        F.floor(F.col("value") * F.lit(100.0)).cast("double").alias("total_opex"))
    return (rec.withWatermark("ts", delay)
               .groupBy(F.window("ts", "1 day"), "factory")
               .agg(F.sum("total_opex").alias("total_opex"), F.count("*").alias("events"))
               .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       "factory", "total_opex", "events"))


def start_daily_kpis(spark: SparkSession, source: str, sink: str, checkpoint: str,
                     delay: str = "1 day", available_now: bool = True,
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run the windowed aggregation into the sink (update mode).  Files are
    taken in order of their modification time; with
    ``max_files_per_trigger`` they should follow event time."""
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch}")

    q = (daily_kpis(event_stream(spark, source, max_files_per_trigger=max_files_per_trigger), delay)
         .writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def current_windows(spark: SparkSession, sink: str) -> DataFrame:
    """Every window written so far, with the value of its last batch."""
    rows = spark.read.schema(f"{WINDOW_COLUMNS}, {BATCH} long").parquet(sink)
    last = F.max_by(F.struct("window_end", "total_opex", "events"), BATCH).alias("w")
    return rows.groupBy("window_start", "factory").agg(last).select("window_start", "w.window_end", "factory", "w.total_opex", "w.events")


def stream_daily_kpis(spark: SparkSession, source: str, work: str, delay: str = "1 day",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Process everything available in ``source`` and return all windows,
    closed and open."""
    sink, ckpt = os.path.join(work, "sink"), os.path.join(work, "checkpoint")
    start_daily_kpis(spark, source, sink, ckpt, delay, True, max_files_per_trigger).awaitTermination()
    return current_windows(spark, sink)
