"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of the library relies on.  AQE re-plans joins at
# runtime (broadcasting only sides whose measured size is under the
# threshold) and splits skewed shuffle partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "opexlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    On a cluster ``master`` stays None and the launcher's settings win; the
    shuffle partition count should then be sized to the data (about
    128-256 MB of shuffle input per partition)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame from a few driver-side rows (model outputs, quantile
    targets).  Goes through Arrow from pandas, which needs no Python worker
    on the executors (a plain ``createDataFrame(list)`` is a Python RDD)."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    pdf = pd.DataFrame(rows, columns=[f.name for f in st.fields]) if rows else \
        pd.DataFrame({f.name: pd.Series([], dtype=object) for f in st.fields})
    prev = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        return spark.createDataFrame(pdf, schema=st)
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", prev)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present.  Only a local session
    (one machine, as in tests) gets a folder of its own when it is unset; on
    a cluster a machine-local folder would lose data, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="opexlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Open scopes, innermost last; the outermost collects what is written
# outside any ``stage_scope``.
_SCOPES: list[list[str]] = [[]]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder, for written tables
    that cut lineage (survives executor loss, unlike local checkpoints).  It
    belongs to the innermost open ``stage_scope``."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _SCOPES[-1].append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and continue from it (never a local checkpoint).  One pass: unlike
    ``DataFrame.checkpoint`` the input is not computed a second time for
    the write, and a lost executor only costs re-reading the files."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**({"compression": codec} if codec else {})).parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_tables(df: DataFrame) -> int:
    """Delete the tables of ``cut_lineage`` that ``df`` reads before their
    scope ends, once nothing else will read them."""
    names = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    gone = [p for scope in _SCOPES for p in scope if os.path.basename(p) in names]
    for scope in _SCOPES:
        scope[:] = [p for p in scope if p not in gone]
    return _delete(df.sparkSession, gone)


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of a query inside the block are deleted as the query
    ends, not whenever the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete through the Hadoop FileSystem API (local, HDFS and object
    stores alike); returns how many existed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p) and fs.delete(p, True):
            removed += 1
    return removed


@contextmanager
def stage_scope(spark: SparkSession):
    """Everything written to the shared folder inside the block (stage
    tables, CSV, workbooks, datasets, stream folders) is deleted at its end.
    Collect or write the block's results inside it; tables of other scopes
    are left alone."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        # By identity: equal (empty) scopes are still different ones.
        del _SCOPES[next(i for i in range(len(_SCOPES) - 1, -1, -1) if _SCOPES[i] is paths)]
        _delete(spark, paths)


def release_stage_tables(spark: SparkSession) -> int:
    """Delete what was written outside any open ``stage_scope``.  Call it
    only after every DataFrame built on it has been collected or written.
    Returns the number of paths removed."""
    return _delete(spark, _SCOPES[0])
