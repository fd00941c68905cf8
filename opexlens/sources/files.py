"""File sources and sinks.

Uploads are read as text (no schema-inference pass over the data); the
cleaning operators then turn null tokens, numbers and dates into typed
columns, row by row, on the executors.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_dates
from ..session import small_frame
from . import csv_records

MONTH = "_month"  # partition folder of saved datasets

class LoadError(ValueError):
    """Any failure to read an upload, reported as one error."""


def load_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Comma-separated file(s) with a header; every cell read as text, blank
    lines skipped, quotes doubled inside quoted cells.  Null tokens are
    handled by the cleaning step (a CSV reader takes only one null marker).

    Files of a folder may have different headers: files are grouped by their
    header and the groups united by column name.  Quoted cells may hold line
    feeds, and a large file is read by many tasks all the same
    (``csv_records``).  Without ``multi_line`` every line is a record, which
    saves finding them."""
    if multi_line:
        found = csv_records.read_csv(spark, path)
        if found is not None:
            return found
    reader = spark.read.options(header="true", inferSchema="false", mode="PERMISSIVE", escape='"')
    groups: dict[tuple, list[str]] = {}
    for f in _csv_files(spark, path):
        groups.setdefault(_first_record(spark, f), []).append(f)
    if len(groups) < 2:
        return reader.csv(path)
    parts = [reader.csv(files) for _, files in sorted(groups.items(), key=lambda g: g[1][0])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a folder (metadata only), in name order."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath) or not fs.getFileStatus(hpath).isDirectory():
        return []
    return sorted(str(st.getPath().toString()) for st in fs.listStatus(hpath)
                  if st.isFile() and st.getLen() and not st.getPath().getName().startswith(("_", ".")))


def _first_record(spark: SparkSession, file: str) -> tuple:
    """Column names of a CSV file as Spark's reader sees them (it reads the
    start of the file only)."""
    return tuple(spark.read.options(header="true", escape='"', multiLine="false").csv(file).columns)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader from the (case-insensitive) suffix: ``.csv`` is
    CSV, ``.parquet`` Parquet, anything else is a workbook.  Folders are
    dispatched on the files they hold.  Errors become one ``LoadError``."""
    from .workbook import load_workbooks
    try:
        name = path.rstrip("/").lower()
        is_dir, names = _listing(spark, path)
        if is_dir:
            suffixes = {os.path.splitext(f)[1].lower() for f in names if not f.startswith((".", "_"))}
            if suffixes and suffixes <= {".csv"}:
                return load_csv(spark, path)
            if suffixes and suffixes <= {".parquet"}:
                return spark.read.parquet(path)
            return load_workbooks(spark, path)
        if name.endswith(".csv"):
            return load_csv(spark, path)
        if name.endswith(".parquet"):
            return spark.read.parquet(path)
        return load_workbooks(spark, path)
    except Exception as e:  # noqa: BLE001 - one error type for the caller
        raise LoadError(f"Error loading file: {e}") from e


def _listing(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """(is a folder, file names in it) through Hadoop's filesystem API, so
    local, HDFS and object-store paths behave alike (metadata only)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath) or not fs.getFileStatus(hpath).isDirectory():
        return False, []
    names = [st.getPath().getName() for st in fs.listStatus(hpath)]
    # Spark writers put part files with codec suffixes (.csv, .snappy.parquet).
    return True, [n.replace(".snappy", "").replace(".gz", "") for n in names]


def write_csv(df: DataFrame, path: str) -> str:
    """Write records as CSV text with a header (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_dataset(df: DataFrame, path: str, partition_by_month: bool = True,
                 max_records_per_file: int = 5_000_000) -> str:
    """Persist cleaned records as Parquet (S5), partitioned by month so date
    filters prune whole folders.

    Rows are rebalanced by month: each month goes to one writer task, and a
    month far larger than the advisory partition size is split over as many
    as it needs.  Files are capped at ``max_records_per_file`` rows."""
    options = {"maxRecordsPerFile": str(max_records_per_file)}
    if partition_by_month and "date" in df.columns:
        out = df.withColumn(MONTH, F.date_format("date", "yyyy-MM")).hint("rebalance", MONTH)
        out.write.mode("overwrite").options(**options).partitionBy(MONTH).parquet(path)
    else:
        df.write.mode("overwrite").options(**options).parquet(path)
    return path


def load_dataset(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Read a saved dataset; with a date range (both ends included) only its
    rows, and months outside it are pruned before any file is opened."""
    df = spark.read.parquet(path)
    if MONTH not in df.columns:
        return df if start is None or end is None else filter_dates(df, start, end)
    if start is not None and end is not None:
        df = filter_dates(df.where(F.col(MONTH).between(str(start)[:7], str(end)[:7])), start, end)
    return df.drop(MONTH)


def save_rollups(df: DataFrame, path: str) -> str:
    """Partial results beside a dataset: dashboard cells, forecast blocks and
    value bins with their edges (``operators.rollup``)."""
    from ..operators import rollup
    edges = rollup.bin_edges(df)
    rollup.cells(df).write.mode("overwrite").parquet(f"{path}/cells")
    rollup.forecast_blocks(df).write.mode("overwrite").parquet(f"{path}/forecast_blocks")
    rollup.value_bins(df, edges).write.mode("overwrite").parquet(f"{path}/value_bins")
    small_frame(df.sparkSession, list(edges.items()), "column string, edges array<double>").write.mode("overwrite").parquet(f"{path}/bin_edges")
    return path


def load_rollups(spark: SparkSession, path: str) -> dict:
    """``cells``, ``forecast_blocks``, ``value_bins`` (DataFrames) and
    ``bin_edges`` (per column, at most a few hundred numbers)."""
    out: dict = {n: spark.read.parquet(f"{path}/{n}") for n in ("cells", "forecast_blocks", "value_bins")}
    return out | {"bin_edges": {r["column"]: list(r["edges"]) for r in spark.read.parquet(f"{path}/bin_edges").collect()}}


def export_results(df: DataFrame, path: str) -> str:
    """Result tables as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path



class DatasetNotFound(KeyError):
    """No stored dataset under the given id (the registry's 'not found')."""


READY = "_READY"  # marker of a complete version
KEPT_VERSIONS = 2   # the current one and the one that readers may still hold


def _versions(spark: SparkSession, base: str) -> list[str]:
    """Names of the complete versions of a dataset, oldest first."""
    is_dir, names = _listing(spark, base)
    found = sorted(n for n in names if n.startswith("v-")) if is_dir else []
    return [n for n in found if READY in _listing(spark, f"{base}/{n}")[1]]


def save_session(root: str, records: DataFrame, results: dict[str, DataFrame] | None = None,
                 forecast_model=None, dataset_id: str | None = None) -> str:
    """Store an analysed upload under ``root/<id>``: the cleaned records
    (partitioned by month), result tables as Parquet and the fitted forecast
    model (S5).  Returns the id.

    Everything goes into a new version folder, which counts once its marker is
    written, last: a reader sees the old upload or the new one as a whole, and
    a writer that fails leaves the old one in place.  Versions before the last
    ``KEPT_VERSIONS`` are deleted."""
    import time
    import uuid
    spark = records.sparkSession
    dataset_id = dataset_id or uuid.uuid4().hex
    top = f"{root.rstrip('/')}/{dataset_id}"
    base = f"{top}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    save_dataset(records, f"{base}/records")
    for name, df in (results or {}).items():
        df.write.mode("overwrite").parquet(f"{base}/results/{name}")
    if forecast_model is not None:
        forecast_model.write().overwrite().save(f"{base}/models/forecast")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(conf)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/{READY}")).close()
    for old in _versions(spark, top)[:-KEPT_VERSIONS]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{top}/{old}"), True)
    return dataset_id


def load_session(spark: SparkSession, root: str, dataset_id: str) -> dict:
    """Open the newest complete version of a stored upload: ``records``, each
    result table, and the forecast model when one was stored.  Unknown ids raise
    DatasetNotFound."""
    top = f"{root.rstrip('/')}/{dataset_id}"
    versions = _versions(spark, top)
    if not versions:
        raise DatasetNotFound(dataset_id)
    base = f"{top}/{versions[-1]}"
    out: dict = {"records": load_dataset(spark, f"{base}/records")}
    has_results, names = _listing(spark, f"{base}/results")
    for name in (names if has_results else []):
        if not name.startswith(("_", ".")):
            out[name] = spark.read.parquet(f"{base}/results/{name}")
    has_model, _ = _listing(spark, f"{base}/models/forecast")
    if has_model:
        from pyspark.ml.regression import LinearRegressionModel
        out["forecast_model"] = LinearRegressionModel.load(f"{base}/models/forecast")
    return out
