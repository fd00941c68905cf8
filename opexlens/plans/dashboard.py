"""The two dashboard bundles as dictionaries of DataFrames, and either of
them as one long table.

``upload_analysis`` is what an upload produces (KPIs, trend, forecast with
its metrics, future KPIs, anomalies, drivers); ``filtered_dashboard`` is the
filter panel's reply (F10).  The records a bundle works on are written once
to the shared folder, so every product reads those instead of filtering or
cleaning again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_numeric_type
from ..operators import anomaly, charts, drivers, filters, forecast, kpis
from ..schema import FILTERED_SECTIONS, UPLOAD_SECTIONS
from ..session import cut_lineage

# Columns that name a row of a section; all others are its values.
ITEM_COLUMNS = {"kpi", "label", "period", "date", "day_index", "factory", "shift", "component", "energy_type", "feature"}
LONG_SCHEMA = "section string, item string, measure string, value double, text string"


def filtered_dashboard(records: DataFrame, spec: dict) -> dict[str, DataFrame]:
    view = cut_lineage(filters.apply_filters(records, spec), "filtered")
    tables = [kpis.kpis_labelled(view).drop("position", "label"), charts.trend(view, "total_opex", "D"),
              charts.cost_composition(view), charts.factory_shift_cells(view), charts.energy_mix(view)]
    return dict(zip(FILTERED_SECTIONS, tables))


def upload_analysis(cleaned: DataFrame, horizon: int = 30, with_drivers: bool = True, key_cols: list[str] | None = None) -> dict[str, DataFrame]:
    rec = cut_lineage(cleaned, "records")
    flagged = cut_lineage(anomaly.anomaly_depth(rec).select(*[c for c in ("date", "total_opex") if c in rec.columns], "anomaly"), "flagged")
    tables = [kpis.kpis_labelled(rec).drop("position", "label"), charts.trend(rec, "total_opex", "D"),
              forecast.forecast(rec, horizon), forecast.forecast_metrics(rec), forecast.future_kpis(rec, horizon),
              anomaly.anomaly_rate(flagged), anomaly.anomaly_rows(flagged)]
    if with_drivers:
        tables += drivers.driver_report(rec, key_cols=key_cols)
    return dict(zip(UPLOAD_SECTIONS, tables))


def as_long(tables: dict[str, DataFrame]) -> DataFrame:
    """All sections as ``(section, item, measure, value, text)``: a row per
    value, numbers in ``value`` and names in ``text``; ``item`` joins the
    columns that name the row."""
    parts = []
    for section, df in tables.items():
        keys = [c for c in df.columns if c in ITEM_COLUMNS]
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
        values = [F.struct(F.lit(f.name).alias("measure"),
                           (F.col(f.name).cast("double") if is_numeric_type(f.dataType) else F.lit(None).cast("double")).alias("value"),
                           (F.lit(None).cast("string") if is_numeric_type(f.dataType) else F.col(f.name).cast("string")).alias("text"))
                  for f in df.schema.fields if f.name not in keys]
        parts.append(df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.array(*values)).alias("v"))
                     .select("section", "item", "v.*"))
    return reduce(DataFrame.unionByName, parts)
