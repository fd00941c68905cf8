"""Operators: DataFrame -> DataFrame steps (cleaning, filters, KPIs, chart
tables, forecast, anomalies, drivers, what-if, context tables)."""
