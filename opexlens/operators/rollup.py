"""Partial results stored beside a dataset, so replies need no record scan.

* ``cells``: sums and counts per (date, factory, shift).  Any mix of date,
  factory and shift filters is answered from them (F10); energy bounds are not
  covered and go to the records.
* ``forecast_blocks``: the additive part of the forecast's normal equations,
  per month.  Blocks of several uploads add up, and the model is solved for
  their union (T4, M9).
* ``value_bins``: per month and column, counts and moments by value bin.  They
  give moments of any range of days, and the bin that holds each quartile; only
  that bin's records are read (V6).
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import _interval, exact_quantiles
from ..schema import COST_COMPONENTS, DEFAULT_HORIZON, ENERGY_COLUMNS, FILTERED_SECTIONS
from ..session import cut_lineage, small_frame
from . import charts, filters, forecast, kpis

CELL_KEYS = ["date", "factory", "shift"]
CELL_MEASURES = list(dict.fromkeys([*kpis.KPI_MEASURES, *COST_COMPONENTS, *ENERGY_COLUMNS]))
COVERED = {"date_range", "factory", "shift"}


# -- dashboard cells ------------------------------------------------------------

def cells(records: DataFrame) -> DataFrame:
    """One row per (date, factory, shift): sum of every measure, ``_n`` records with a total_opex."""
    present = [c for c in CELL_MEASURES if c in records.columns]
    return records.groupBy(F.to_date("date").alias("date"), "factory", "shift").agg(*[F.sum(c).alias(c) for c in present], F.count("total_opex").alias("_n"))


def covers(spec: dict) -> bool:
    """Whether cells answer a filter exactly: it asks for nothing but days,
    factory and shift (a bound that is not set does not count)."""
    return all(k in COVERED or v is None or v == "" for k, v in spec.items())


def dashboard(spec: dict, stored: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """The filter panel's reply (F10): from the stored cells when they cover
    the filter, else from the filtered records, reduced to cells once."""
    if covers(spec):
        view = filters.apply_filters(stored, spec)
    else:
        view = cut_lineage(cells(filters.apply_filters(records, spec)), "cells")
    measures = [c for c in kpis.KPI_MEASURES if c in view.columns]
    by_cell = view.groupBy("factory", "shift").agg(*[F.sum(c).alias(c) for c in measures], F.sum("_n").alias("_n"))
    bundle = kpis.labelled(kpis.kpis_of_cells(by_cell, measures, ["factory", "shift"]))
    tables = [bundle.drop("position", "label"), charts.trend(view, "total_opex", "D"), charts.cost_composition(view),
              charts.factory_shift_cells(view), charts.energy_mix(view)]
    return dict(zip(FILTERED_SECTIONS, tables))


# -- forecast blocks ------------------------------------------------------------

_TERMS = ["one", "dow", "mon", "dom", "t"]


def _features(date: Column) -> dict[str, Column]:
    day = F.datediff(date, F.lit("1970-01-01").cast("date"))
    return {"one": F.lit(1.0), "dow": F.weekday(date).cast("double"), "mon": F.month(date).cast("double"), "dom": F.dayofmonth(date).cast("double"), "t": day.cast("double")}


def forecast_blocks(records: DataFrame) -> DataFrame:
    """Per month and day number modulo 5 (which days are held out hangs on the
    first day): sums of total_opex times each feature, first and last day."""
    d = F.to_date("date")
    x = _features(d)
    y = F.coalesce(F.col("total_opex").cast("double"), F.lit(0.0))
    return records.where(F.col("date").isNotNull()).groupBy(F.date_format(d, "yyyy-MM").alias("month"), F.pmod(F.datediff(d, F.lit("1970-01-01").cast("date")), F.lit(5)).alias("residue")) \
        .agg(*[F.sum(y * x[c]).alias(c) for c in _TERMS], F.min(d).alias("first"), F.max(d).alias("last"))


def forecast_from_blocks(blocks: DataFrame, horizon: int = DEFAULT_HORIZON, digits: int = 2) -> DataFrame:
    """The forecast of all days the blocks cover, equal to that over their
    records.  Reads the blocks and a calendar, no records."""
    spark = blocks.sparkSession
    ends = blocks.agg(F.min("first").alias("lo"), F.max("last").alias("hi")).first()
    nothing = small_frame(spark, [], forecast.FORECAST_SCHEMA)
    if ends.lo is None or (ends.hi - ends.lo).days + 1 < forecast.MIN_DAYS:
        return nothing
    start = (ends.lo - dt.date(1970, 1, 1)).days
    # Every fifth day from the first is held out.
    learn = blocks.where(F.pmod(F.col("residue") - F.lit(start), F.lit(5)) != 4)
    right = np.array(learn.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in _TERMS]).first(), float)
    days = spark.range((ends.hi - ends.lo).days + 1).where(F.col("id") % 5 != 4).select(F.date_add(F.lit(ends.lo), F.col("id").cast("int")).alias("d"))
    x = _features(F.col("d"))
    x["t"] = x["t"] - start
    sums = days.agg(*[F.sum(x[a] * x[b]) for a in _TERMS for b in _TERMS]).first()
    right[4] -= start * right[0]
    weights, *_ = np.linalg.lstsq(np.array(sums, float).reshape(5, 5), right, rcond=None)
    rows = []
    for k in range(1, horizon + 1):
        d = ends.hi + dt.timedelta(days=k)
        rows.append((k, d, round(float(weights @ [1, d.weekday(), d.month, d.day, (d - ends.lo).days]), digits)))
    return small_frame(spark, rows, forecast.FORECAST_SCHEMA)


# -- value bins ------------------------------------------------------------------

BINS = 256


def _values(records: DataFrame) -> dict[str, Column]:
    out = {c: F.col(f"`{c}`").cast("double") for c in charts.numeric_columns(records)}
    if "date" in records.columns:
        out["date"] = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return out


def bin_edges(records: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Upper ends of value bins per column, from one sketch aggregate.  Any
    edges are right; even ones keep the brackets small."""
    values = _values(records)
    got = records.agg(*[F.percentile_approx(v, [k / bins for k in range(1, bins)], 50 * bins).alias(f"q{i}") for i, v in enumerate(values.values())]).first()
    return {c: sorted(set(q or [])) for c, q in zip(values, got)}


def value_bins(records: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """month, column, bin, n, mean, m2 (squared deviations), low, high: one
    grouped aggregate over the records."""
    values = _values(records)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("v"), _interval(v, edges[c]).alias("bin")) for c, v in values.items() if c in edges]))
    rows = records.select(F.date_format(F.to_date("date"), "yyyy-MM").alias("month"), each.alias("p")).select("month", "p.*").where("v IS NOT NULL")
    return rows.groupBy("month", "column", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2"),
                                                      F.min("v").alias("low"), F.max("v").alias("high"))


def whole_months(start: str, end: str) -> tuple[str, str]:
    """First and last month that a range of days covers fully (in this order
    only if there is one)."""
    lo, hi = dt.date.fromisoformat(str(start)), dt.date.fromisoformat(str(end)) + dt.timedelta(days=1)
    first = lo if lo.day == 1 else (lo.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return first.strftime("%Y-%m"), (hi.replace(day=1) - dt.timedelta(days=1)).strftime("%Y-%m")


def range_parts(bins: DataFrame, edges: dict[str, list[float]], records: DataFrame, start: str, end: str) -> DataFrame:
    """Bins of the days from ``start`` to ``end``: stored ones of whole months,
    and those of the records at both ends."""
    first, last = whole_months(start, end)
    month = F.date_format(F.to_date("date"), "yyyy-MM")
    inside = filters.filter_dates(records, start, end)
    rest = value_bins(inside.where(~month.between(first, last)), edges)
    return bins.where(F.col("month").between(first, last)).select(rest.columns).union(rest)


def bracket_rows(parts: DataFrame, inside: DataFrame, probs: list[float]) -> DataFrame:
    """(column, v, w): every value of the bins that hold an order statistic
    around a quantile, read from the records ``inside``, and one row for each
    other bin."""
    per_bin = cut_lineage(parts.groupBy("column", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "bins")
    wanted: dict[str, list] = {}
    for r in per_bin.orderBy("column", "bin").collect():  # columns x bins
        wanted.setdefault(r["column"], []).append(r)
    held, hits = [], []
    values = _values(inside)
    for c, rows in wanted.items():
        ends = np.cumsum([r["n"] for r in rows])
        spots = {int(f(p * (ends[-1] - 1))) for p in probs for f in (np.floor, np.ceil)}
        for i in sorted({int(np.searchsorted(ends, k, side="right")) for k in spots}):
            held.append((c, rows[i]["bin"]))
            hits.append((c, rows[i]["low"], rows[i]["high"]))
    match = F.array(*[F.struct(F.lit(c).alias("column"), F.when(values[c].between(lo, hi), values[c]).alias("v")) for c, lo, hi in hits])
    picked = inside.select(F.explode(match).alias("p")).select("p.*").where("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("w"))
    taken = small_frame(inside.sparkSession, held, "column string, bin int")
    others = per_bin.join(taken, ["column", "bin"], "left_anti").select("column", F.col("high").alias("v"), F.col("n").alias("w"))
    return cut_lineage(picked.union(others), "bracket-rows")


def describe_range(bins: DataFrame, edges: dict[str, list[float]], records: DataFrame, start: str, end: str, digits: int = 6) -> DataFrame:
    """``charts.describe`` of the records between two days (both included),
    from the stored bins: records are read at the ends of the range and, of the
    rest, the values in the quartiles' bins."""
    parts = cut_lineage(range_parts(bins, edges, records, start, end), "range-bins")
    mean = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all")
    centred = parts.join(parts.groupBy("column").agg(mean), "column").withColumn("dev", F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all")))
    total = centred.groupBy("column").agg(F.sum("n").cast("double").alias("count"), F.first("all").alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"),
                                          F.when(F.sum("n") > 1, F.sqrt(F.sum("dev") / (F.sum("n") - 1))).alias("std"))
    long = total.unpivot("column", ["count", "mean", "min", "max", "std"], "statistic", "value").where("NOT (column = 'date' AND statistic = 'std')")
    probs = [0.25, 0.5, 0.75]
    rows = bracket_rows(parts, filters.filter_dates(records, start, end), probs)
    quartiles = exact_quantiles(rows, "v", probs, ["column"], weight_col="w", summarized=True) \
        .select("column", F.concat((F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"), "value")
    return long.union(quartiles).select("column", "statistic", F.round("value", digits).alias("value"))
