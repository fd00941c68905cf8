"""Global order statistics without a single-partition window.

A ``Window`` without ``partitionBy`` moves every row to one task.  Global
ranks and exact quantiles here are computed the way ``zipWithIndex`` does
it, but on DataFrames:

1. pre-aggregate to distinct values with weights (a hot value becomes one
   row, so skew disappears before any ordering);
2. range-partition and sort by the value, tag each row with its partition
   id and materialise that once (reliable checkpoint in the shared folder,
   so a lost executor cannot re-shuffle rows into other partitions);
3. running sums inside each partition, plus per-partition offsets from a
   table with one row per (partition, group) -- bounded by the partition
   count, hence safe to broadcast.

Quantile targets are then located with an equi-join on (partition, group)
and an interval condition, all inside the JVM.

``column_quantiles`` needs no distinct-value table of the records at all: a
first scan brackets every target with a bounded sketch, a second one counts
the rows between brackets and keeps only the values inside them, and the
steps above then run on that small residue.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_frame

def _tag_partitions(df: DataFrame, group_cols: list[str], order_col: str) -> DataFrame:
    """Range-partition by (group, order) and record each row's partition id,
    written once (each written file then holds a single ``_pid``)."""
    keys = [*group_cols, order_col]
    tagged = (df.repartitionByRange(*keys)
                .withColumn("_pid", F.spark_partition_id()))
    return cut_lineage(tagged, "ordered")


def _partition_offsets(tagged: DataFrame, group_cols: list[str], weight_col: str) -> DataFrame:
    """One row per (partition, group): its weight and the weight before it."""
    per_part = tagged.groupBy("_pid", *group_cols).agg(F.sum(weight_col).alias("_ptotal"))
    before_part = Window.partitionBy(*group_cols).orderBy("_pid") \
                        .rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_pid", *group_cols, "_ptotal",
        F.coalesce(F.sum("_ptotal").over(before_part), F.lit(0)).alias("_offset"))


def _rows_before(tagged: DataFrame, offsets: DataFrame, group_cols: list[str], order_col: str,
                 weight_col: str) -> DataFrame:
    """Rows with ``_before``, the weight of all rows ahead of them."""
    local = Window.partitionBy("_pid", *group_cols).orderBy(order_col) \
                  .rowsBetween(Window.unboundedPreceding, -1)
    with_local = tagged.withColumn("_local", F.coalesce(F.sum(weight_col).over(local), F.lit(0)))
    names = [*tagged.columns, "_local"]
    ahead = offsets.select(F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_o_{c}") for c in group_cols], "_offset")
    on = [F.col("_pid") == F.col("_opid"), *[F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in group_cols]]
    return (with_local.join(ahead, on).select(*names, "_offset")
                      .withColumn("_before", F.col("_offset") + F.col("_local"))
                      .drop("_local", "_offset"))


def _ordered_partitions(df: DataFrame, group_cols: list[str], order_col: str,
                        weight_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_pid`` and ``_before``, per-(partition, group) offsets)."""
    tagged = _tag_partitions(df, group_cols, order_col)
    offsets = _partition_offsets(tagged, group_cols, weight_col)
    return _rows_before(tagged, offsets, group_cols, order_col, weight_col), offsets


def with_global_offsets(df: DataFrame, group_cols: list[str], order_col: str,
                        weight_col: str, out_col: str = "_before") -> DataFrame:
    """Add ``out_col`` = sum of ``weight_col`` over rows that come strictly
    before this one within its group, ordering by ``order_col``.

    ``order_col`` must be unique within a group (pre-aggregate first)."""
    rows, _ = _ordered_partitions(df, group_cols, order_col, weight_col)
    return rows.drop("_pid").withColumnRenamed("_before", out_col) if out_col != "_before" \
        else rows.drop("_pid")


def dense_rank_distinct(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """Distinct values of ``col`` with their 0-based rank in ascending order."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct() \
                 .withColumn("_one", F.lit(1))
    ranked = with_global_offsets(distinct, [], col, "_one", out_col)
    return ranked.select(col, F.col(out_col).cast("int").alias(out_col))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    group_cols: list[str] | None = None,
                    weight_col: str | None = None, summarized: bool = False, with_ends: bool = False) -> DataFrame:
    """Exact interpolated quantiles (the ``percentile`` rule: position
    ``p * (n - 1)``, linear between the neighbouring order statistics).

    Returns ``(*group_cols, q_index int, q double, value double)``.
    Unlike the ``percentile`` aggregate, no task ever holds all distinct
    values: the work is a grouped count, a range shuffle and a scan.

    ``summarized=True`` says ``df`` already holds each (group, value) once
    with its count in ``weight_col`` and is materialised; it is then used
    as is.  ``with_ends`` adds the two order statistics, lo_v and hi_v."""
    group_cols = list(group_cols or [])
    w = F.col(weight_col) if weight_col else F.lit(1)
    if summarized:
        vals = df.where(F.col(value_col).isNotNull()).select(
            *group_cols, value_col, w.cast("long").alias("_w"))
    else:
        vals = (df.where(F.col(value_col).isNotNull())
                  .groupBy(*group_cols, value_col)
                  .agg(F.sum(w).cast("long").alias("_w")))
        # Written once: the range partitioner samples its input before the
        # shuffle, which would otherwise scan and aggregate the facts twice.
        vals = cut_lineage(vals, "distinct")
    tagged = _tag_partitions(vals, group_cols, value_col)
    offsets = _partition_offsets(tagged, group_cols, "_w")

    # Targets: per group and probability the two order statistics around its
    # position.  Everything stays distributed, so groups may be many.
    sizes = offsets.groupBy(*group_cols).agg(F.sum("_ptotal").alias("_n")).where(F.col("_n").isNotNull())
    one = F.struct(F.lit(0).alias("side"), F.floor("pos").alias("r"))
    two = F.struct(F.lit(1).alias("side"), F.ceil("pos").alias("r"))
    targets = (sizes.select(*group_cols, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_t", "q"))
               .withColumn("pos", F.col("q") * (F.col("_n") - 1))
               .withColumn("e", F.explode(F.array(one, two)))
               .select(*group_cols, "_t", "q", "pos", F.col("e.side").alias("_side"), F.col("e.r").alias("_r")))
    spans = offsets.select(F.col("_pid").alias("_at"), *[F.col(c).alias(f"_s_{c}") for c in group_cols],
                           F.col("_offset").alias("_from"), "_ptotal")
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group_cols]
    placed = cut_lineage(
        targets.join(spans, [*same, F.col("_r") >= F.col("_from"), F.col("_r") < F.col("_from") + F.col("_ptotal")])
        .select(*[F.col(c).alias(f"_p_{c}") for c in group_cols], "_t", "q", "pos", "_side", "_r", "_at"), "targets")
    # Only partitions that hold a target are ordered; each target meets only
    # the rows of its own partition and group.
    wanted = placed.select(F.col("_at").alias("_pid")).distinct()
    ordered = _rows_before(tagged.join(wanted, "_pid"), offsets, group_cols, value_col, "_w")
    on = [F.col("_pid") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in group_cols]]
    hits = ordered.join(placed, [*on, F.col("_r") >= F.col("_before"), F.col("_r") < F.col("_before") + F.col("_w")])
    lo, hi = (F.max(F.when(F.col("_side") == k, F.col(value_col).cast("double"))) for k in (0, 1))
    agg = hits.groupBy(*group_cols, "_t", "q", "pos").agg(lo.alias("lo_v"), hi.alias("hi_v"))
    part = F.col("pos") - F.floor("pos")
    value = F.when(part == 0, F.col("lo_v")).otherwise(
        (F.ceil("pos") - F.col("pos")) * F.col("lo_v") + (F.col("pos") - F.floor("pos")) * F.col("hi_v"))
    return agg.select(*group_cols, F.col("_t").cast("int").alias("q_index"), F.col("q").cast("double").alias("q"), value.cast("double").alias("value"),
                      *([F.col("lo_v"), F.col("hi_v")] if with_ends else []))


def _interval(v: Column, bounds: list[float], lo: int = 0, hi: int | None = None) -> Column:
    """Number of bounds <= v, by a balanced tree of comparisons (more than
    64 bounds would outgrow a generated method: then by a vectorised search)."""
    if len(bounds) > 64:
        edges = np.array(bounds)

        @F.pandas_udf("int")
        def search(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=float), side="right").astype(np.int32))
        return search(v)
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < F.lit(bounds[mid]), _interval(v, bounds, lo, mid)).otherwise(_interval(v, bounds, mid + 1, hi))


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of several columns at once:
    ``(column, q_index, q, value)``, nulls left out; no rows for a column
    without values.

    Two scans of ``df``: bounded sketches (relative rank error 1 / accuracy)
    give a bracket around every target; then rows between brackets are only
    counted, each gap as one row, and the distinct values inside brackets
    are ranked exactly.  A target outside its bracket is looked for again
    with brackets four times as wide, until none is missed."""
    spark, names = df.sparkSession, list(columns)
    wide = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    width = 2.0 / accuracy
    while True:
        grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-width, width)} | {0.0, 1.0})
        sketch = wide.agg(*[F.percentile_approx(f"c{i}", grid, accuracy).alias(f"c{i}") for i in range(len(names))]).first()
        brackets, stacked = [], []
        for i in range(len(names)):
            if sketch[i] is None:
                continue
            at = dict(zip(grid, sketch[i]))
            spans = sorted((at[max(0.0, p - width)] if p > width else -math.inf, at[min(1.0, p + width)] if p + width < 1 else math.inf) for p in probs)
            merged: list[list[float]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            brackets.append((i, merged))
            # Interval 2k + 1 is bracket k (closed at both ends), 2k a gap.
            edges = [x for a, b in merged for x in (a, math.nextafter(b, math.inf))]
            k = _interval(F.col(f"c{i}"), [e for e in edges if -math.inf < e < math.inf]) + int(edges[0] == -math.inf)
            stacked.append(F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("v"), k.alias("k")))
        if not stacked:
            return small_frame(spark, [], "column string, q_index int, q double, value double")
        inside = F.when(F.col("e.k") % 2 == 1, F.col("e.v"))
        residue = cut_lineage(
            wide.select(F.explode(F.array(*stacked)).alias("e"))
            .where(F.col("e.v").isNotNull()).groupBy(F.col("e.column").alias("column"), F.col("e.k").alias("k"), inside.alias("in"))
            # A gap is one row; its largest value stands for its place in the order.
            .agg(F.count("*").alias("w"), F.max("e.v").alias("v")).select("column", "v", "w"), "quantile-residue")
        got = exact_quantiles(residue, "v", probs, ["column"], weight_col="w", summarized=True, with_ends=True).collect()  # columns x probabilities
        spans = dict(brackets)
        if all(any(a <= x <= b for a, b in spans[r["column"]]) for r in got for x in (r["lo_v"], r["hi_v"])):
            found = [(names[r["column"]], r["q_index"], r["q"], r["value"]) for r in got]
            return small_frame(spark, found, "column string, q_index int, q double, value double")
        width *= 4


def _out_schema(df: DataFrame, group_cols: list[str]) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group_cols]
                     + ["q_index int", "q double", "value double"])
