"""KPI bundle, rankings and filter options.

The whole numeric bundle is one ``agg`` (Catalyst de-duplicates the
repeated sums); rankings are one grouped aggregation each, reduced with
``min_by``/``max_by`` (constant-size state, partial aggregation on the map
side) and attached as scalar sub-queries -- no join, no collect.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ratio, ratio_pct, sum0
from ..plans.ranking import with_global_offsets
from ..schema import KPI_LABELS, MONEY_LABEL_WORDS, NOT_AVAILABLE, UTILIZATION_LABEL_WORD
from ..session import small_frame


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _ranked_ends(grouped: DataFrame, name: str, measure: str) -> tuple[Column, Column]:
    """(first, last) names in the order measure desc, name asc, as scalar
    sub-queries; 'N/A' when there are no groups."""
    key = F.struct((-F.col(measure)).alias("m"), F.col(name).alias("n"))
    # One scalar sub-query carries both ends.
    ends = grouped.agg(F.struct(F.min_by(name, key).alias("first"),
                                F.max_by(name, key).alias("last")).alias("e")).scalar()
    first = F.coalesce(ends.getField("first"), F.lit(NOT_AVAILABLE))
    last = F.coalesce(ends.getField("last"), F.lit(NOT_AVAILABLE))
    return first, last


def _ends(name: str, measure: str, first: str, last: str) -> list[Column]:
    """The same ends as aggregates over rows that carry their group's measure."""
    key = F.struct((-F.col(measure)).alias("m"), F.col(name).alias("n"))
    return [F.coalesce(F.min_by(name, key), F.lit(NOT_AVAILABLE)).alias(first),
            F.coalesce(F.max_by(name, key), F.lit(NOT_AVAILABLE)).alias(last)]


def factory_costs(df: DataFrame) -> DataFrame:
    return df.groupBy("factory").agg(sum0("total_opex").alias("total_opex"))


def shift_costs(df: DataFrame) -> DataFrame:
    return df.groupBy("shift").agg(F.avg("total_opex").alias("avg_opex"))


def kpis(df: DataFrame) -> DataFrame:
    """One-row KPI bundle (A1-A10); a KPI is left out when its inputs are
    missing.  ``efficiency_basis`` says whether energy efficiency is revenue
    or OpEx per unit of energy.

    The records are read once: one aggregate per (factory, shift) cell
    carries every sum and count, windows over the cells add each cell's
    factory and shift totals, and one last aggregate takes the sums and the
    ends of both rankings.  Nothing is written."""
    measures = [c for c in KPI_MEASURES if c in df.columns]
    if not measures:
        return df.sparkSession.range(1).select()
    dims = [c for c in ["factory", "shift"] if c in df.columns and "total_opex" in df.columns]
    cells = df.groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in measures],
        *([F.count("total_opex").alias("_n")] if "shift" in dims else []))
    return kpis_of_cells(cells, measures, dims)


KPI_MEASURES = ["total_opex", "total_energy", "revenue", "hr_cost", "admin_cost"]


def kpis_of_cells(cells: DataFrame, measures: list[str], dims: list[str], by: list[str] | None = None) -> DataFrame:
    """The KPI bundle from sums per (factory, shift) cell, each cell once:
    the ``measures`` and ``_n``, the records behind total_opex; one row, or a
    row per value of the ``by`` columns."""
    by = list(by or [])
    ends: list[Column] = []
    if "factory" in dims:
        cells = cells.withColumn("_factory", F.coalesce(F.sum("total_opex").over(Window.partitionBy(*by, "factory")), F.lit(0.0)))
        ends += _ends("factory", "_factory", "top_factory", "bottom_factory")
    if "shift" in dims:
        by_shift = Window.partitionBy(*by, "shift")
        cells = cells.withColumn("_shift", F.sum("total_opex").over(by_shift) / F.sum("_n").over(by_shift))
        ends += _ends("shift", "_shift", "most_expensive_shift", "cheapest_shift")
    base = cells.groupBy(*by).agg(*[sum0(c).alias(c) for c in measures], *ends)
    s = {c: F.col(c) for c in measures}
    out: dict[str, Column] = {}
    if "total_opex" in s:
        out["total_opex"] = s["total_opex"]
    if "total_energy" in s:
        out["total_energy"] = s["total_energy"]
    if "revenue" in s:
        out["total_revenue"] = s["revenue"]
        if "total_opex" in s:
            profit = s["revenue"] - s["total_opex"]
            out["profit"] = profit
            out["profit_margin"] = ratio_pct(profit, s["revenue"])
    if "total_energy" in s and "revenue" in s:
        out["energy_efficiency"] = ratio(s["revenue"], s["total_energy"])
        out["efficiency_basis"] = F.lit("revenue")
    elif "total_energy" in s and "total_opex" in s:
        out["energy_efficiency"] = ratio(s["total_opex"], s["total_energy"])
        out["efficiency_basis"] = F.lit("opex")
    if "factory" in dims:
        out["top_factory"], out["bottom_factory"] = F.col("top_factory"), F.col("bottom_factory")
    if "shift" in dims:
        out["most_expensive_shift"], out["cheapest_shift"] = F.col("most_expensive_shift"), F.col("cheapest_shift")
    if "hr_cost" in s and "total_opex" in s:
        out["hr_percent"] = ratio_pct(s["hr_cost"], s["total_opex"])
    if "admin_cost" in s and "total_opex" in s:
        out["admin_percent"] = ratio_pct(s["admin_cost"], s["total_opex"])
    return base.select(*by, *[c.alias(k) for k, c in out.items()])


def kpis_labelled(df: DataFrame) -> DataFrame:
    """Long form ``(position, kpi, label, value, text)`` of the bundle (A11):
    numbers in ``value``, names in ``text``."""
    return labelled(kpis(df))


def labelled(bundle: DataFrame) -> DataFrame:
    """The same for a bundle computed before."""
    names = [c for c in KPI_LABELS if c in bundle.columns]
    numeric = {f.name for f in bundle.schema.fields if f.dataType.typeName() == "double"}
    entries = [F.struct(F.lit(i).alias("position"), F.lit(k).alias("kpi"),
                        F.lit(KPI_LABELS[k]).alias("label"),
                        (F.col(k) if k in numeric else F.lit(None).cast("double")).alias("value"),
                        (F.lit(None).cast("string") if k in numeric else F.col(k)).alias("text"))
               for i, k in enumerate(names)]
    return bundle.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def kpis_formatted(df: DataFrame) -> DataFrame:
    """Display text per KPI (A12): two decimals; '$' before money labels
    (Revenue / Cost / Profit); labels that are percentages get a '%' suffix
    instead; 'Utilization' labels are shown x100 with one decimal."""
    long = kpis_labelled(df)
    label = F.col("label")
    num = F.format_string("%.2f", F.col("value"))
    shown = (F.when(F.col("value").isNull(), F.col("text"))
             .when(label.contains(UTILIZATION_LABEL_WORD),
                   F.concat(F.format_string("%.1f", F.col("value") * 100), F.lit("%")))
             .when(label.contains("%"), F.concat(num, F.lit("%")))
             .when(reduce(or_, [label.contains(w) for w in MONEY_LABEL_WORDS]),
                   F.concat(F.lit("$"), num))
             .otherwise(num))
    return long.select("position", "kpi", "label", shown.alias("display"))


def _rank_table(grouped: DataFrame, name: str, measure: str) -> DataFrame:
    keyed = grouped.withColumn("_k", F.struct((-F.col(measure)).alias("m"), F.col(name).alias("n"))) \
                   .withColumn("_one", F.lit(1))
    ranked = with_global_offsets(keyed, [], "_k", "_one", "_r")
    return ranked.select(name, measure, (F.col("_r") + 1).cast("int").alias("rank"))


def factory_ranking(df: DataFrame) -> DataFrame:
    """Factories by summed OpEx, rank 1 = most expensive; ties by name."""
    return _rank_table(factory_costs(df), "factory", "total_opex")


def shift_ranking(df: DataFrame) -> DataFrame:
    """Shifts by mean OpEx per record, rank 1 = most expensive (A10)."""
    return _rank_table(shift_costs(df), "shift", "avg_opex")


def most_expensive(df: DataFrame) -> DataFrame:
    """The top factory (by sum) and top shift (by mean) as one row (O3)."""
    top_f, _ = _ranked_ends(factory_costs(df), "factory", "total_opex")
    top_s, _ = _ranked_ends(shift_costs(df), "shift", "avg_opex")
    return df.sparkSession.range(1).select(top_f.alias("most_expensive_factory"),
                                           top_s.alias("most_expensive_shift"))


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct factories and shifts for the filter lists (A13), as rows
    ``(dimension, value)``, in one scan; sort at display time."""
    dims = [c for c in ["factory", "shift"] if c in df.columns]
    if not dims:
        return small_frame(df.sparkSession, [], "dimension string, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dims])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


def filter_ranges(df: DataFrame) -> DataFrame:
    """Minimum and maximum of each energy column (A14), one row."""
    aggs = []
    for i, c in [(1, "energy_type_1"), (2, "energy_type_2")]:
        if c in df.columns:
            aggs += [F.min(c).cast("double").alias(f"energy{i}_min"),
                     F.max(c).cast("double").alias(f"energy{i}_max")]
    return df.agg(*aggs) if aggs else df.sparkSession.range(1).select()
