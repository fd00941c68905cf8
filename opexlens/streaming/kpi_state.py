"""The KPI bundle of a running stream, per dataset (Structured Streaming with
arbitrary state).

State is kept per cell (dataset, factory, shift): the sums behind the KPIs, the
number of events, and the number of late ones.  An event whose time lies before
the watermark is late: it is counted, not added.  Each micro-batch writes the
cells it changed into its own folder (overwritten when the batch runs again),
the current value of a cell is that of its last batch, and the bundle is
computed from the cells as for a table.  A cell is a few numbers, so state grows
with sites and shifts, not with events; the checkpoint in the shared folder
carries it over a restart.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kpis import KPI_MEASURES, kpis_of_cells
from .daily import BATCH, EVENT_COLUMNS, event_stream

KEYS = ["dataset", "factory", "shift"]
COUNTS = ["events", "late_events"]
_SUMS = ", ".join(f"{c} double" for c in KPI_MEASURES)
STATE_COLUMNS = f"{_SUMS}, events long, late_events long"
CELL_COLUMNS = f"dataset string, factory string, shift string, {STATE_COLUMNS}"


def event_records(events: DataFrame) -> DataFrame:
    """Cost records of events: site, shift, dataset and the measures behind
    the KPIs; a missing value counts as 0."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("D"), F.coalesce(F.col("user_id"), F.lit(0)) % 4).alias("dataset"),
        F.col("event_type").alias("factory"), F.concat(F.lit("S"), F.coalesce(F.col("user_id"), F.lit(0)) % 3).alias("shift"),
        F.floor(value * 100.0).cast("double").alias("total_opex"), (F.coalesce(F.col("event_id"), F.lit(0)) % 50).cast("double").alias("total_energy"),
        F.floor(value * 130.0).cast("double").alias("revenue"), F.floor(value * 30.0).cast("double").alias("hr_cost"), F.floor(value * 10.0).cast("double").alias("admin_cost"))


def _add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sums = list(state.get) if state.exists else [0.0] * len(KPI_MEASURES) + [0, 0]
    mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    for part in parts:
        late = (part["ts"] < mark).to_numpy()
        on_time = part[~late]
        for i, c in enumerate(KPI_MEASURES):
            sums[i] = float(sums[i] + on_time[c].sum())
        sums[-2] += len(on_time)
        sums[-1] += int(late.sum())
    state.update(tuple(sums))
    yield pd.DataFrame([[*key, *sums]], columns=[*KEYS, *KPI_MEASURES, *COUNTS])


def cells(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of changed cells, in update mode."""
    return records.withWatermark("ts", delay).groupBy(*KEYS).applyInPandasWithState(
        _add, CELL_COLUMNS, STATE_COLUMNS, "update", GroupStateTimeout.NoTimeout)


def start_kpis(spark: SparkSession, source: str, sink: str, checkpoint: str, delay: str = "1 day", available_now: bool = True,
               max_files_per_trigger: int | None = None, schema: str = EVENT_COLUMNS) -> StreamingQuery:
    """Run the cells into the sink; start again with the same checkpoint to go on."""
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch}")

    q = (cells(event_records(event_stream(spark, source, schema, max_files_per_trigger)), delay)
         .writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write))
    return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")).start()


def current_cells(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema(f"{CELL_COLUMNS}, {BATCH} long").parquet(sink)
    values = [*KPI_MEASURES, *COUNTS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values), BATCH).alias("v")).select(*KEYS, "v.*")


def current_kpis(spark: SparkSession, sink: str) -> DataFrame:
    """The bundle per dataset (as ``kpis`` over the events on time), with the
    numbers of events and of late ones."""
    now = current_cells(spark, sink)
    # Cells with late events only hold no record.
    bundle = kpis_of_cells(now.where("events > 0").withColumn("_n", F.col("events")), KPI_MEASURES, ["factory", "shift"], by=["dataset"])
    counts = now.groupBy("dataset").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return bundle.join(counts, "dataset")


def stream_kpis(spark: SparkSession, source: str, work: str, delay: str = "1 day", max_files_per_trigger: int | None = None) -> DataFrame:
    """Process everything available in ``source`` and return the bundles."""
    sink = os.path.join(work, "sink")
    start_kpis(spark, source, sink, os.path.join(work, "checkpoint"), delay, True, max_files_per_trigger).awaitTermination()
    return current_kpis(spark, sink)
