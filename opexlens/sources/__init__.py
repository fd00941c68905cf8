"""Sources and sinks: driver-table views, CSV / workbook / Parquet readers,
dataset and session stores, JSON export."""
