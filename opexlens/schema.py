"""Column names, labels and tokens of the cost-record data model.

Everything in the FIXED VALUES block must stay equal to the behaviour we
reproduce (names the reference's users see, KPI labels, null tokens), so it
is written out plainly and in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; do not reorder)
# ---------------------------------------------------------------------------

# Numeric columns coerced to double, bad or missing values becoming 0.
NUMERIC_COLUMNS = [
    "energy_type_1", "energy_type_2", "hr_cost", "operation_cost",
    "admin_cost", "other_cost", "revenue", "profit",
]

# Components summed into total_opex (energy is not part of it).
COST_COMPONENTS = ["hr_cost", "operation_cost", "admin_cost", "other_cost"]

# Energy columns summed into total_energy.
ENERGY_COLUMNS = ["energy_type_1", "energy_type_2"]

# Categorical columns whose missing values become UNKNOWN.
CATEGORICAL_COLUMNS = ["factory", "shift"]
UNKNOWN = "unknown"
NOT_AVAILABLE = "N/A"

# Display names used by the dashboard (canonical -> display).
DISPLAY_NAMES = {
    "date": "Date",
    "total_opex": "Total_OpEx",
    "total_energy": "Total_Energy",
    "hr_cost": "HR_Cost",
    "operation_cost": "Operation_Cost",
    "admin_cost": "Admin_Cost",
    "other_cost": "Other_Cost",
    "energy_type_1": "Energy_Type_1",
    "energy_type_2": "Energy_Type_2",
    "factory": "Factory",
    "shift": "Shift",
    "shift_code": "Shift_Code",
    "anomaly": "Anomaly",
}

# KPI keys in bundle order, and their dashboard labels.
KPI_LABELS = {
    "total_opex": "Total OpEx",
    "total_energy": "Total Energy",
    "total_revenue": "Total Revenue",
    "profit": "Profit",
    "profit_margin": "Profit Margin (%)",
    "energy_efficiency": "Energy Efficiency",
    "hr_percent": "HR Cost %",
    "admin_percent": "Admin Overhead %",
    "top_factory": "Top Factory",
    "bottom_factory": "Bottom Factory",
    "most_expensive_shift": "Most Expensive Shift",
    "cheapest_shift": "Cheapest Shift",
}

# Text read as missing by the reference's file reader (pandas defaults).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Forecast features, in model order: weekday (Monday = 0), month, day of
# month, days since the first date.
FORECAST_FEATURES = ["dayofweek", "month", "day", "days_since_start"]
DEFAULT_HORIZON = 30
# Fields of the future-KPI card.
FUTURE_KPI_SCHEMA = ("next_month_total_cost double, estimated_energy_demand double, budget_overrun_prob int, "
                     "most_expensive_factory string, most_expensive_shift string, avg_daily_cost_next_month double")

# Cost-driver model: numeric features (operation_cost is left out), trees, seed.
DRIVER_FEATURES = ["energy_type_1", "energy_type_2", "hr_cost", "admin_cost", "other_cost"]
DRIVER_TREES = 100
SEED = 42

# Anomaly model: share of rows flagged, trees, sample size cap.
CONTAMINATION = 0.1
ISOLATION_TREES = 100
ISOLATION_MAX_SAMPLES = 256

# Placeholder the future-KPI card shows as "budget overrun probability".
BUDGET_OVERRUN_PLACEHOLDER = 30

# What-if default energy price increase, percent.
WHATIF_DEFAULT_PCT = 10.0

# Relative date presets of the dashboard filter.
PRESETS = ["1D", "1W", "1M", "1Y", "ALL", "CUSTOM"]

# Insight context lines: (kpi key, line label, number format).  Format
# "money" = thousands separator and 2 decimals, "pct1" = 1 decimal and a
# percent sign, "num2" = 2 decimals, "text" = as is.
INSIGHT_LINES = [
    ("total_opex", "Total Operational Expenditure", "money"),
    ("total_energy", "Total Energy Consumption", "money"),
    ("hr_percent", "HR Cost %", "pct1"),
    ("admin_percent", "Admin Overhead %", "pct1"),
    ("top_factory", "Most expensive factory", "text"),
    ("bottom_factory", "Least expensive factory", "text"),
    ("most_expensive_shift", "Most expensive shift", "text"),
    ("energy_efficiency", "Energy Efficiency", "num2"),
]
INSIGHT_DRIVERS_LABEL = "Top cost drivers"
# What "Energy Efficiency" divides, by basis (the label names it).
EFFICIENCY_BASIS_TEXT = {"revenue": "Revenue/Energy", "opex": "OpEx/Energy"}

# KPI display rules: labels containing one of these words are money ($
# prefix); labels containing the utilisation word are shown x100 with "%".
MONEY_LABEL_WORDS = ["Revenue", "Cost", "Profit"]
UTILIZATION_LABEL_WORD = "Utilization"

# Names of the two energy-mix slices.
ENERGY_MIX_NAMES = ["Energy Type 1", "Energy Type 2"]
INSIGHT_ANOMALY_TEXT = "Anomalies detected: {n} unusual cost spikes."

# Sections of the two dashboard replies.
FILTERED_SECTIONS = ["kpis", "line_chart", "stacked_bar", "heatmap", "pie_energy"]
UPLOAD_SECTIONS = ["kpis", "trend", "forecast", "forecast_metrics", "future_kpis", "anomaly_rate", "anomalies",
                   "driver_importance", "driver_metrics"]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

KPI_NUMERIC = [
    "total_opex", "total_energy", "total_revenue", "profit", "profit_margin",
    "energy_efficiency", "hr_percent", "admin_percent",
]
KPI_TEXT = ["top_factory", "bottom_factory", "most_expensive_shift", "cheapest_shift"]
