"""Regenerate the README's registered-query table from the registry."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from opexlens.plans.catalog import QUERIES  # noqa: E402
from opexlens.plans.oracle import ORACLE  # noqa: E402

ROWS = {
    "clean": "P11 (+P10)", "encode_shift": "P10", "display_names": "P2 (P3 inverse)",
    "normalize_columns": "P1", "na_tokens": "S4", "coerce_dates": "P4", "drop_bad_dates": "P5",
    "coerce_numeric": "P6", "fill_categoricals": "P7", "derive_totals": "P8, P9",
    "clean_raw": "P11 on a text upload", "kpis_raw": "P11 + A1-A10 on a text upload",
    "kpis": "A1-A10", "kpis_no_revenue": "A6 (no revenue)", "kpis_labelled": "A11",
    "kpis_formatted": "A12", "factory_ranking": "A9, O2", "shift_ranking": "A10",
    "most_expensive": "O3", "filter_values": "A13", "filter_ranges": "A14",
    "filter_dates": "F1", "filter_factory": "F2", "filter_shift": "F3", "filter_energy": "F4-F7",
    "apply_filters": "F8", "filter_preset": "F9", "filtered_kpis": "F10",
    "trend_daily": "V1", "trend_weekly": "V2", "trend_monthly": "V2", "cost_composition": "V3",
    "factory_shift_matrix": "V4", "energy_mix": "V5", "describe": "V6", "correlation": "V7",
    "scale_energy": "W1", "whatif": "W2, W3", "whatif_like_for_like": "W4",
    "daily_grid": "T1", "daily_grid_filtered": "T1 (sparse: one site and shift)",
    "calendar_features": "T2", "forecast_split": "T3", "forecast": "T4, T6", "forecast_90": "T10",
    "forecast_too_short": "T7", "forecast_filtered": "T4 on a sparse grid", "forecast_metrics": "T5",
    "forecast_total": "T8", "future_kpis": "T9", "trend_line": "T11", "forecast_reload": "M9",
    "anomaly_depth": "M6, M7", "anomaly_rate": "M8", "anomaly_rows": "F11, M8", "anomaly_forest": "M5",
    "one_hot": "M4", "cost_drivers": "M1, M2", "cost_driver_metrics": "M3", "top_drivers": "O4",
    "fit_score_regression": "M10, M11, M13", "fit_score_classifier": "M12, M13",
    "sample_rows": "O5", "insight_context": "C1", "insight_context_anomalies": "C1 (+ anomaly line), M8", "chat_context": "C2",
    "load_csv": "S1", "load_table": "S3", "load_workbooks": "S2", "save_dataset": "S5",
    "export_results": "S6", "stream_daily_kpis": "§2.15",
    "null_tokens": "S4 (every text column)", "usable_date": "P5 (first usable of two)", "dropped_rows": "P5 (count of dropped rows)",
    "canonical_names": "P3", "filter_energy_max": "F7", "factory_shift_cells": "V4 (long form)",
    "describe_extra": "V6 (columns beyond the known ones)", "correlation_extra": "V7 (same)",
    "forecast_total_short": "T8 (no forecast)", "future_kpis_short": "T9 (no forecast)",
    "anomaly_missing": "M6, M7 (missing values)", "anomaly_rate_missing": "M8 (missing values)", "anomaly_forest_share": "M5 (exact facts)",
    "one_hot_long": "M4 (long form)", "driver_split": "M3 (holdout)", "driver_features": "M2", "driver_importance_total": "M1 (exact facts)",
    "filtered_dashboard": "F10", "upload_analysis": "§2.1-2.13 as one upload",
    "load_csv_quoted": "S1 (another program's files)", "load_workbook_dates": "S2 (another program's files)",
    "load_workbooks_two_headers": "S2 (differing headers)", "save_dataset_range": "S5 (date range)", "session_store": "S5, M9",
    "driver_tree_splits": "M1 (first splits of a tree grown out)", "filtered_dashboard_rollup": "F10 from stored cells",
    "filtered_dashboard_energy": "F10 with energy bounds (records)", "forecast_incremental": "T4, M9 from blocks of two uploads",
    "describe_range": "V6 of a range of days, from stored bins", "upload_analysis_full": "§2.1-2.13 as one upload, drivers included",
    "insight_context_drivers": "C1 (+ driver line), O4", "stream_kpis": "§2.15, A1-A10 per dataset",
    "kpis_missing_columns": "P12, A1-A10 (columns missing)", "case_blind": "P13, A9",
}


def main() -> None:
    missing = [k for k in QUERIES if k not in ROWS]
    if missing:
        raise SystemExit(f"no inventory row for {missing}")
    n_oracle = sum(k in ORACLE for k in QUERIES)
    table = "\n".join(["| key | inventory rows | check |", "| --- | --- | --- |"] + [
        f"| `{k}` | {ROWS[k]} | {'DuckDB SQL' if k in ORACLE else 'rows + properties (tests)'} |"
        for k in QUERIES])
    section = (f"## Registered queries\n\n`__spark_entry__.queries()` holds {len(QUERIES)} keys; "
               f"{n_oracle} have an exact DuckDB oracle in `oracle_sql()`, and all of those "
               "agree (values and column types) at sf0.001 and sf0.01 "
               "(`tools/check_oracle.py`).  The rest rest on the driver forest of 100 trees grown out, "
               "whose growth `tests/test_trees.py` holds against plain recursion and whose first splits "
               "`driver_tree_splits` holds against SQL.  Every key reads "
               f"the driver tables in full.\n\n{table}\n\n")
    path = os.path.join(ROOT, "README.md")
    s = open(path).read()
    a = s.index("## Registered queries")
    b = s.index("\n## ", a + 1) + 1
    s = s[:a] + section + s[b:]
    open(path, "w").write(s)
    print(len(QUERIES), n_oracle)


if __name__ == "__main__":
    main()
