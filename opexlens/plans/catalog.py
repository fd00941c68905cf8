"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables through the cost-record views in
``sources.fixtures`` and runs over all of their rows; filters are business
filters (dates, sites, shifts, energy bounds) applied to the whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import null_token
from ..operators import anomaly as AN
from ..operators import charts as CH
from ..operators import clean as C
from ..operators import context as CX
from ..operators import drivers as DR
from ..operators import filters as FL
from ..operators import forecast as FC
from ..operators import kpis as K
from ..operators import rollup as RU
from ..operators import whatif as W
from ..session import shared_path
from ..sources import files as FS
from ..sources import fixtures as X
from ..sources import uploads as UP
from ..sources import workbook as WB
from ..streaming import daily as ST
from ..streaming import kpi_state as SK
from . import dashboard as DB

Query = Callable[[SparkSession, str], DataFrame]

KEYS = X.KEY_COLUMNS
ORDER = ["date", *KEYS]

# Parameters of the registered filter queries.
DATE_LO, DATE_HI = "1996-01-01", "1996-12-31"
ALL_FILTERS = {"date_range": ("1995-06-01", "1998-06-30"), "factory": "F03", "shift": "S_R",
               "energy1_min": 5.0, "energy1_max": 45.0, "energy2_min": 10.0}
DASHBOARD_FILTERS = {"date_range": ("1995-01-01", "1997-12-31"), "factory": "F02"}
SPARSE = {"factory": "F03", "shift": "S_A"}             # one site and shift: most days have no record
DASHBOARD_VIEW = {"date_range": ("1995-01-01", "1997-12-31"), "factory": "F02"}
ENERGY_VIEW = DASHBOARD_VIEW | {"energy1_min": 10.0, "energy2_max": 40.0}  # not covered by the cells
RANGE = ("1996-01-17", "1996-12-05")
SHORT = {"date_range": ("1996-01-01", "1996-01-09")}   # nine days: below the forecast gate


def records(spark: SparkSession, sf_dir: str, revenue: bool = True,
            shift_code: bool = False) -> DataFrame:
    """Cleaned, typed cost records over lineitem."""
    return C.clean(X.cost_records(spark, sf_dir, revenue=revenue), with_shift_code=shift_code)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as an untyped text upload."""
    return X.raw_records(spark, sf_dir)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the row key, whose numbers are names, not measures."""
    return records(spark, sf_dir).drop(*KEYS)


def extra_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with numeric columns beyond the known ones."""
    return records(spark, sf_dir).withColumns({"water_use": (F.col("l_partkey") % 50).cast("double"),
                                               "headcount": (F.col("l_suppkey") % 9).cast("int")}).drop(*KEYS)


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose total_opex is missing on line 7 of every order."""
    return records(spark, sf_dir).withColumn("total_opex", F.when(F.col("l_linenumber") != 7, F.col("total_opex")))


def two_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text upload with two date columns, the first one unreadable."""
    up = raw(spark, sf_dir).withColumnRenamed(" Date ", "Ship Date")
    return up.select(F.concat(F.lit("week "), F.col("l_linenumber").cast("string")).alias("Order Date"), *up.columns)


def upload_parts(spark: SparkSession, sf_dir: str, rows: int = 50_000) -> int:
    """Tasks that write upload files of about ``rows`` rows each (a count from
    the files' footers)."""
    return max(4 if rows <= 50_000 else 1, -(-X.table(spark, sf_dir, "lineitem").count() // rows))


def upload_rows(spark: SparkSession, sf_dir: str, remark: bool = False, rows: int = 50_000) -> DataFrame:
    """Typed cells for upload files: real dates and numbers, about ``rows`` a
    partition."""
    rec = X.cost_records(spark, sf_dir)
    cols = [F.col("date").alias("Date"), F.col("factory").alias("Factory"), F.col("shift").alias("Shift"),
            *[F.col(c).cast("long").alias(c.replace("_", " ").title()) for c in
              ("energy_type_1", "energy_type_2", "hr_cost", "operation_cost", "admin_cost", "other_cost", "revenue")]]
    text = F.concat(F.lit('say "'), F.col("factory"), F.lit('",\n then '), F.col("l_linenumber").cast("string"))
    return rec.select(*([text.alias("Remark")] if remark else []), *cols).repartition(upload_parts(spark, sf_dir, rows))


def _ntz(df: DataFrame) -> DataFrame:
    # Parsed timestamps are wall-clock values: compare them zone-free.
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def _latest_date(df: DataFrame):
    return df.agg(F.max("date")).scalar()


# --- sources, sinks, stored models, streaming --------------------------------

def _q_load_csv(s, d):
    path = FS.write_csv(raw(s, d), shared_path(s, "upload-csv"))
    return K.kpis(C.clean(FS.load_csv(s, path, multi_line=False), with_shift_code=False))


def _q_load_table(s, d):
    path = FS.write_csv(raw(s, d), shared_path(s, "upload-table"))
    return K.kpis(C.clean(FS.load_table(s, path), with_shift_code=False))


def _q_load_workbooks(s, d):
    # One workbook per partition: spread the rows so files are written in parallel.
    path = WB.write_workbooks(raw(s, d).repartition(upload_parts(s, d), F.col("l_orderkey")), shared_path(s, "upload-xlsx"))
    return K.kpis(C.clean(WB.load_workbooks(s, path), with_shift_code=False))


def _q_load_csv_quoted(s, d):
    # One file up to a million rows, then one per million: no task holds the whole upload.
    path = UP.write_csv_uploads(upload_rows(s, d, remark=True, rows=1_000_000), shared_path(s, "csv-quoted"))
    up = FS.load_table(s, path)
    kept = K.kpis(C.clean(up, with_shift_code=False))
    texts = up.agg(F.count("*").alias("rows"), F.countDistinct("Remark").alias("remarks"),
                   F.sum(F.length("Remark").cast("long")).alias("remark_chars"))
    return kept.select("total_opex", "total_energy", "total_revenue", "top_factory", *[texts.select(c).scalar().alias(c) for c in texts.columns])


def _q_load_workbook_dates(s, d):
    path = UP.write_uploads(upload_rows(s, d), shared_path(s, "xlsx-dates"), ".xlsx", UP.xlsx_bytes)
    return CH.trend(C.clean(WB.load_workbooks(s, path), with_shift_code=False), "total_opex", "M")


def _q_load_workbooks_two_headers(s, d):
    up, folder = upload_rows(s, d), shared_path(s, "xlsx-headers")
    other = up.where("Factory = 'F00'").select("Hr Cost", "Revenue", "Date", "Factory", "Operation Cost", F.lit("late").alias("Note"))
    UP.write_uploads(up.where("Factory <> 'F00'").drop("Revenue"), f"{folder}/a", ".xlsx", UP.xlsx_bytes)
    UP.write_uploads(other, f"{folder}/b", ".xlsx", UP.xlsx_bytes)
    rec = C.clean(WB.load_workbooks(s, folder), with_shift_code=False)
    return rec.groupBy("factory").agg(F.count("*").alias("rows"), F.sum("total_opex").alias("total_opex"), F.sum("revenue").alias("revenue"),
                                      F.count("note").alias("notes"), F.sum((F.col("shift") == "unknown").cast("long")).alias("no_shift"))


def _q_save_dataset(s, d):
    path = FS.save_dataset(records(s, d), shared_path(s, "dataset"))
    return FS.load_dataset(s, path)


def _q_save_dataset_range(s, d):
    path = FS.save_dataset(records(s, d), shared_path(s, "dataset"))
    return FS.load_dataset(s, path, start="1996-01-17", end="1996-12-05")


def _q_session_store(s, d):
    rec, root = records(s, d), shared_path(s, "sessions")
    model, _ = FC.fit_forecast(rec)
    back = FS.load_session(s, root, FS.save_session(root, rec, {"kpis": K.kpis(rec)}, model))
    days = FC.calendar_features(FC.daily_grid(back["records"], ["total_opex"]))
    return FC.predict_future(back["forecast_model"], days, 30)


def _stored(s, d):
    """A saved dataset and its partial results."""
    root = shared_path(s, "rolled-up")
    rec = records(s, d).drop(*KEYS)
    FS.save_dataset(rec, f"{root}/records")
    FS.save_rollups(rec, f"{root}/rollups")
    return FS.load_dataset(s, f"{root}/records"), FS.load_rollups(s, f"{root}/rollups")


def _q_dashboard_rollup(spec):
    def run(s, d):
        rec, stored = _stored(s, d)
        return DB.as_long(RU.dashboard(spec, stored["cells"], rec))
    return run


def _q_forecast_incremental(s, d):
    """Two uploads, each stored with its own blocks; the model of both."""
    rec, root = records(s, d), shared_path(s, "two-uploads")
    for name, part in (("first", rec.where("date < '1996-03-10'")), ("second", rec.where("date >= '1996-03-10'"))):
        RU.forecast_blocks(part).write.parquet(f"{root}/{name}")
    return RU.forecast_from_blocks(s.read.parquet(f"{root}/first", f"{root}/second"), 30)


def _q_describe_range(s, d):
    rec, stored = _stored(s, d)
    return RU.describe_range(stored["value_bins"], stored["bin_edges"], rec, *RANGE)


def _q_export_results(s, d):
    path = FS.export_results(K.kpis_labelled(records(s, d)), shared_path(s, "export"))
    return s.read.schema("position int, kpi string, label string, value double, text string").json(path)


def _q_forecast_reload(s, d):
    rec = records(s, d)
    model, _ = FC.fit_forecast(rec)
    path = FC.save_forecast_model(model, shared_path(s, "forecast-model"))
    return FC.forecast_reload(rec, path, 30)


def _q_stream_daily_kpis(s, d):
    work = shared_path(s, "stream")
    source = os.path.join(work, "events")
    # The events table laid out as a folder of files that the stream picks up.
    X.table(s, d, "events").repartition(8).write.mode("overwrite").parquet(source)
    out = ST.stream_daily_kpis(s, source, work)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "factory", "total_opex", F.col("events").cast("long").alias("events"))


def _q_stream_kpis(s, d):
    work = shared_path(s, "stream-kpis")
    source = os.path.join(work, "events")
    X.table(s, d, "events").repartition(8).write.mode("overwrite").parquet(source)
    return SK.stream_kpis(s, source, work)


QUERIES: dict[str, Query] = {
    # cleaning (typed input)
    "clean": lambda s, d: records(s, d, shift_code=True),
    "encode_shift": lambda s, d: C.encode_shift(records(s, d)).select(*KEYS, "shift", "shift_code"),
    "display_names": lambda s, d: C.display_names(records(s, d)),
    # cleaning (text upload)
    "normalize_columns": lambda s, d: C.normalize_columns(raw(s, d)),
    "na_tokens": lambda s, d: C.normalize_columns(raw(s, d)).select(
        *KEYS, null_token(F.col("factory")).alias("factory"), null_token(F.col("shift")).alias("shift")),
    "coerce_dates": lambda s, d: _ntz(C.coerce_dates(C.normalize_columns(raw(s, d))).select(*KEYS, "date")),
    "drop_bad_dates": lambda s, d: _ntz(C.drop_bad_dates(C.coerce_dates(C.normalize_columns(raw(s, d))))
                                        .select(*KEYS, "date")),
    "coerce_numeric": lambda s, d: C.coerce_numeric(C.normalize_columns(raw(s, d))).select(
        *KEYS, "energy_type_1", "energy_type_2", "hr_cost", "operation_cost", "admin_cost", "other_cost",
        "revenue"),
    "fill_categoricals": lambda s, d: C.fill_categoricals(C.normalize_columns(raw(s, d))).select(
        *KEYS, "factory", "shift"),
    "derive_totals": lambda s, d: C.clean(raw(s, d), with_shift_code=False).select(
        *KEYS, "total_opex", "total_energy"),
    "null_tokens": lambda s, d: C.null_tokens(C.normalize_columns(raw(s, d).withColumn(
        "Remark", F.when(F.col("l_linenumber") == 3, " NULL").when(F.col("l_linenumber") == 4, "#N/A").otherwise("ok"))))
        .select(*KEYS, "factory", "shift", "hr_cost", "remark"),
    "usable_date": lambda s, d: _ntz(C.clean(two_dates(s, d), with_shift_code=False).select(*KEYS, "date")),
    "dropped_rows": lambda s, d: C.dropped_rows(raw(s, d)),
    "canonical_names": lambda s, d: C.canonical_names(C.display_names(records(s, d))),
    "clean_raw": lambda s, d: _ntz(C.clean(raw(s, d))),
    "kpis_raw": lambda s, d: K.kpis(C.clean(raw(s, d), with_shift_code=False)),
    # KPIs, rankings, filter options
    "kpis": lambda s, d: K.kpis(records(s, d)),
    "kpis_no_revenue": lambda s, d: K.kpis(records(s, d, revenue=False)),
    # Whatever columns an upload lacks, the rest is computed; names are found whatever their case.
    "kpis_missing_columns": lambda s, d: K.kpis(records(s, d).drop("shift", "admin_cost", "revenue")),
    "case_blind": lambda s, d: K.factory_ranking(records(s, d).where("FACTORY <> 'F00' AND Shift = 'S_N'").select(
        F.col("Factory").alias("FACTORY"), F.col("TOTAL_OPEX").alias("Total_Opex"))).toDF("factory", "total_opex", "rank"),
    "kpis_labelled": lambda s, d: K.kpis_labelled(records(s, d)),
    "kpis_formatted": lambda s, d: K.kpis_formatted(records(s, d)),
    "factory_ranking": lambda s, d: K.factory_ranking(records(s, d)),
    "shift_ranking": lambda s, d: K.shift_ranking(records(s, d)),
    "most_expensive": lambda s, d: K.most_expensive(records(s, d)),
    "filter_values": lambda s, d: K.filter_values(records(s, d)),
    "filter_ranges": lambda s, d: K.filter_ranges(records(s, d)),
    # filters
    "filter_dates": lambda s, d: FL.filter_dates(records(s, d), DATE_LO, DATE_HI),
    "filter_factory": lambda s, d: FL.filter_factory(records(s, d), "F03"),
    "filter_shift": lambda s, d: FL.filter_shift(records(s, d), "S_N"),
    "filter_energy": lambda s, d: FL.filter_energy(records(s, d), 10.0, 40.0, 20.0, None),
    "filter_energy_max": lambda s, d: FL.filter_energy(records(s, d), None, None, None, 30.0),
    "apply_filters": lambda s, d: FL.apply_filters(records(s, d), ALL_FILTERS),
    "filter_preset": lambda s, d: (lambda r: FL.filter_preset(r, "1Y", as_of=_latest_date(r)))(records(s, d)),
    "filtered_kpis": lambda s, d: K.kpis(FL.apply_filters(records(s, d), DASHBOARD_FILTERS)),
    # chart tables and statistics
    "trend_daily": lambda s, d: CH.trend(records(s, d), "total_opex", "D"),
    "trend_weekly": lambda s, d: CH.trend(records(s, d), "total_opex", "W"),
    "trend_monthly": lambda s, d: CH.trend(records(s, d), "total_opex", "M"),
    "cost_composition": lambda s, d: CH.cost_composition(records(s, d)),
    "factory_shift_matrix": lambda s, d: CH.factory_shift_matrix(records(s, d)),
    "factory_shift_cells": lambda s, d: CH.factory_shift_cells(records(s, d)),
    "energy_mix": lambda s, d: CH.energy_mix(records(s, d)),
    "describe": lambda s, d: CH.describe(measures(s, d)),
    "describe_extra": lambda s, d: CH.describe(extra_measures(s, d)),
    "correlation": lambda s, d: CH.correlation(measures(s, d)),
    "correlation_extra": lambda s, d: CH.correlation(extra_measures(s, d)),
    # what-if
    "scale_energy": lambda s, d: W.scale_energy(records(s, d), 10.0).select(
        *KEYS, "energy_type_1", "energy_type_2"),
    "whatif": lambda s, d: W.whatif(records(s, d), 10.0),
    "whatif_like_for_like": lambda s, d: W.whatif_like_for_like(records(s, d), 10.0),
    # daily grid and forecast
    "daily_grid": lambda s, d: FC.daily_grid(records(s, d), ["total_opex", "total_energy"]),
    "daily_grid_filtered": lambda s, d: FC.daily_grid(FL.apply_filters(records(s, d), SPARSE),
                                                      ["total_opex", "total_energy"]),
    "calendar_features": lambda s, d: FC.calendar_features(FC.daily_grid(records(s, d), ["total_opex"])),
    "forecast_split": lambda s, d: FC.forecast_split(
        FC.calendar_features(FC.daily_grid(records(s, d), ["total_opex"]))),
    "forecast": lambda s, d: FC.forecast(records(s, d), 30),
    "forecast_90": lambda s, d: FC.forecast(records(s, d), 90),
    "forecast_too_short": lambda s, d: FC.forecast(FL.apply_filters(records(s, d), SHORT), 30),
    "forecast_filtered": lambda s, d: FC.forecast(FL.apply_filters(records(s, d), SPARSE), 30),
    "forecast_metrics": lambda s, d: FC.forecast_metrics(records(s, d)),
    "forecast_total": lambda s, d: FC.forecast_total(records(s, d), 30),
    "future_kpis": lambda s, d: FC.future_kpis(records(s, d), 30),
    "forecast_total_short": lambda s, d: FC.forecast_total(FL.apply_filters(records(s, d), SHORT), 30),
    "future_kpis_short": lambda s, d: FC.future_kpis(FL.apply_filters(records(s, d), SHORT), 30),
    "trend_line": lambda s, d: FC.trend_line(records(s, d)),
    "forecast_reload": _q_forecast_reload,
    # anomalies
    "anomaly_depth": lambda s, d: AN.anomaly_depth(records(s, d)),
    "anomaly_rate": lambda s, d: AN.anomaly_depth_rate(records(s, d)),
    "anomaly_rows": lambda s, d: AN.anomaly_rows(AN.anomaly_depth(records(s, d))),
    "anomaly_missing": lambda s, d: AN.anomaly_depth(with_gaps(s, d)).select(*KEYS, "total_opex", "anomaly_depth", "anomaly"),
    "anomaly_rate_missing": lambda s, d: AN.anomaly_depth_rate(with_gaps(s, d)),
    "anomaly_forest": lambda s, d: AN.anomaly_forest(records(s, d), key_cols=KEYS).select(*KEYS, "total_opex", "anomaly_score", "anomaly"),
    "anomaly_forest_share": lambda s, d: AN.anomaly_forest(records(s, d), key_cols=KEYS).agg(
        F.count("*").alias("rows"), F.count("anomaly_score").alias("scored"), (F.sum(F.col("anomaly").cast("long")) <= F.count("*") * 0.1).alias("within_share"),
        (F.min("anomaly_score") >= -1).alias("scores_ok")),
    # encodings, drivers, generic models
    "one_hot": lambda s, d: DR.one_hot(records(s, d).select(*KEYS, "factory", "shift")),
    "one_hot_long": lambda s, d: DR.one_hot_long(records(s, d).select(*KEYS, "factory", "shift")),
    "driver_split": lambda s, d: DR.holdout_flag(records(s, d), KEYS).groupBy("is_test").agg(F.count("*").alias("rows")),
    "driver_features": lambda s, d: DR.cost_drivers(records(s, d), key_cols=KEYS).select("feature"),
    "driver_tree_splits": lambda s, d: DR.driver_tree_splits(records(s, d), key_cols=KEYS),
    "driver_importance_total": lambda s, d: DR.cost_drivers(records(s, d), key_cols=KEYS).agg(
        F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative")),
    "cost_drivers": lambda s, d: DR.cost_drivers(records(s, d), key_cols=KEYS),
    "cost_driver_metrics": lambda s, d: DR.cost_driver_metrics(records(s, d), key_cols=KEYS),
    "top_drivers": lambda s, d: DR.top_drivers(DR.cost_drivers(records(s, d), key_cols=KEYS), 3),
    "fit_score_regression": lambda s, d: DR.fit_score_regression(
        records(s, d), ["energy_type_1", "energy_type_2", "total_opex"], "revenue", key_cols=KEYS),
    "fit_score_classifier": lambda s, d: DR.fit_score_classifier(
        records(s, d), ["energy_type_1", "energy_type_2", "hr_cost", "admin_cost", "other_cost"], "shift",
        key_cols=KEYS),
    # context tables
    "sample_rows": lambda s, d: CX.sample_rows(records(s, d), ORDER, 10),
    "insight_context": lambda s, d: CX.insight_context(records(s, d)),
    "insight_context_anomalies": lambda s, d: (lambda r: CX.insight_context(r, anomalies=AN.anomaly_depth(r)))(
        records(s, d)),
    "chat_context": lambda s, d: CX.chat_context(records(s, d), ORDER, 10, id_cols=KEYS),
    # dashboard bundles
    "filtered_dashboard": lambda s, d: DB.as_long(DB.filtered_dashboard(records(s, d), DASHBOARD_VIEW)),
    "filtered_dashboard_rollup": _q_dashboard_rollup(DASHBOARD_VIEW),
    "filtered_dashboard_energy": _q_dashboard_rollup(ENERGY_VIEW),
    "forecast_incremental": _q_forecast_incremental,
    "describe_range": _q_describe_range,
    "upload_analysis_full": lambda s, d: DB.as_long(DB.upload_analysis(records(s, d), key_cols=KEYS)),
    "insight_context_drivers": lambda s, d: (lambda r: CX.insight_context(r, importances=DR.cost_drivers(r, key_cols=KEYS)))(records(s, d)),
    "upload_analysis": lambda s, d: DB.as_long(DB.upload_analysis(records(s, d), with_drivers=False)),
    # sources, sinks, streaming
    "load_csv_quoted": _q_load_csv_quoted,
    "load_workbook_dates": _q_load_workbook_dates,
    "load_workbooks_two_headers": _q_load_workbooks_two_headers,
    "save_dataset_range": _q_save_dataset_range,
    "session_store": _q_session_store,
    "load_csv": _q_load_csv,
    "load_table": _q_load_table,
    "load_workbooks": _q_load_workbooks,
    "save_dataset": _q_save_dataset,
    "export_results": _q_export_results,
    "stream_daily_kpis": _q_stream_daily_kpis,
    "stream_kpis": _q_stream_kpis,
}
