"""Tables behind the dashboard charts, summary statistics, correlations.

Each is a grouped aggregation (partial aggregation before the shuffle, so
a factory or day holding a third of the rows costs one row per map task).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_numeric_type, sum0
from ..plans.ranking import column_quantiles
from ..session import cut_lineage, small_frame
from ..schema import COST_COMPONENTS, ENERGY_COLUMNS, ENERGY_MIX_NAMES

_TRUNC = {"D": None, "W": "week", "M": "month"}


def trend(df: DataFrame, metric: str = "total_opex", freq: str = "D") -> DataFrame:
    """Sum of ``metric`` per day, ISO week (Monday) or month (V1, V2)."""
    if freq not in _TRUNC:
        raise ValueError("freq must be D, W or M")
    if "date" not in df.columns or metric not in df.columns:
        return small_frame(df.sparkSession, [], "period date, value double")
    d = F.to_date("date")
    period = d if _TRUNC[freq] is None else F.to_date(F.date_trunc(_TRUNC[freq], d))
    return df.groupBy(period.alias("period")).agg(sum0(metric).cast("double").alias("value"))


def cost_composition(df: DataFrame) -> DataFrame:
    """Sum of each present cost component per factory, long form
    ``(factory, component, cost)`` (V3)."""
    comps = [c for c in COST_COMPONENTS if c in df.columns]
    if not comps or "factory" not in df.columns:
        return small_frame(df.sparkSession, [], "factory string, component string, cost double")
    wide = df.groupBy("factory").agg(*[sum0(c).alias(c) for c in comps])
    return wide.unpivot("factory", comps, "component", "cost")


def factory_shift_cells(df: DataFrame) -> DataFrame:
    """Sum of total_opex per (factory, shift) that occurs, long form (V4):
    one grouped aggregate, whatever the number of sites and shifts."""
    if not all(c in df.columns for c in ("factory", "shift", "total_opex")):
        return small_frame(df.sparkSession, [], "factory string, shift string, total_opex double")
    return df.groupBy("factory", "shift").agg(sum0("total_opex").alias("total_opex"))


def factory_shift_matrix(df: DataFrame, shifts: list[str] | None = None) -> DataFrame:
    """The same cells as a factory x shift table, absent cells 0 (V4).  The
    records are read once, into the cells; the shifts become columns, so
    this form is for a number of shifts that fits a table's width (the long
    form has no such bound)."""
    if not all(c in df.columns for c in ("factory", "shift", "total_opex")):
        return small_frame(df.sparkSession, [], "factory string")
    cells = factory_shift_cells(df)
    if shifts is None:
        cells = cut_lineage(cells, "cells")
        shifts = sorted(r[0] for r in cells.select("shift").where(F.col("shift").isNotNull()).distinct().collect())
    return (cells.groupBy("factory").pivot("shift", shifts).agg(F.sum("total_opex"))
                 .na.fill(0.0, subset=shifts))


def energy_mix(df: DataFrame) -> DataFrame:
    """Energy type 1 and 2 totals with their share; no rows when both are
    0 or a type is missing (V5)."""
    if not all(c in df.columns for c in ENERGY_COLUMNS):
        return small_frame(df.sparkSession, [], "energy_type string, total double, share double")
    tot = df.agg(sum0(ENERGY_COLUMNS[0]).alias("t1"), sum0(ENERGY_COLUMNS[1]).alias("t2"))
    rows = tot.select(F.explode(F.array(
        F.struct(F.lit(ENERGY_MIX_NAMES[0]).alias("energy_type"), F.col("t1").alias("total"),
                 (F.col("t1") + F.col("t2")).alias("all")),
        F.struct(F.lit(ENERGY_MIX_NAMES[1]).alias("energy_type"), F.col("t2").alias("total"),
                 (F.col("t1") + F.col("t2")).alias("all")))).alias("e")).select("e.*")
    return rows.where(F.col("all") != 0).select(
        "energy_type", "total", (F.col("total") / F.col("all") * 100).alias("share"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Every numeric column, in schema order."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def describe(df: DataFrame, digits: int = 6, exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max of each numeric
    column and of ``date`` (V6), long form ``(column, statistic, value)``.
    Date statistics are in days since 1970-01-01 and have no std.

    Quartiles are exact and interpolated; of the records only the values in
    narrow brackets around them are shuffled (``column_quantiles``).  With
    ``exact=False`` they come from ``percentile_approx`` instead: a bounded
    sketch in the same single aggregate as the moments (relative rank error
    about 1/accuracy, no interpolation), for very large inputs."""
    cols = numeric_columns(df)
    vals = {c: F.col(c).cast("double") for c in cols}
    if "date" in df.columns:
        vals["date"] = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("double")
    if not vals:
        return small_frame(df.sparkSession, [], "column string, statistic string, value double")
    # Moments: one aggregate over the records (whole-stage codegen).
    moments = []
    for c, v in vals.items():
        moments += [F.count(v).cast("double").alias(f"{c}|count"), F.avg(v).alias(f"{c}|mean"),
                    F.min(v).alias(f"{c}|min"), F.max(v).alias(f"{c}|max")]
        if c != "date":
            moments.append(F.stddev_samp(v).alias(f"{c}|std"))
    wide = df.agg(*moments)
    names = [f"{c}|{s}" for c in vals for s in ("count", "mean", "min", "max", "std")
             if not (c == "date" and s == "std")]
    long = wide.unpivot([], names, "key", "value").select(
        F.split("key", r"\|").getItem(0).alias("column"),
        F.split("key", r"\|").getItem(1).alias("statistic"), "value")
    if not exact:
        approx = df.agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias(c)
                          for c, v in vals.items()])
        qs = approx.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in vals])).alias("e")) \
            .select("e.column", F.posexplode("e.q").alias("i", "value")) \
            .select("column", F.element_at(F.array(*[F.lit(x) for x in ("25%", "50%", "75%")]),
                                           F.col("i") + 1).alias("statistic"), "value")
        out = long.unionByName(qs)
        return out.select("column", "statistic", F.round("value", digits).alias("value"))
    qs = column_quantiles(df, vals, [0.25, 0.5, 0.75], accuracy).select(
        "column", F.concat((F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        "value")
    out = long.unionByName(qs)
    return out.select("column", "statistic", F.round("value", digits).alias("value"))


def correlation(df: DataFrame, digits: int = 8) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, one ``agg`` (V7);
    long form ``(column_a, column_b, corr)`` with column_a before column_b."""
    cols = numeric_columns(df)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return small_frame(df.sparkSession, [], "column_a string, column_b string, corr double")
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "key", "corr").select(
        F.split("key", r"\|").getItem(0).alias("column_a"),
        F.split("key", r"\|").getItem(1).alias("column_b"),
        F.round("corr", digits).alias("corr"))
