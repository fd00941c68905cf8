"""Cost-record views over the driver's TPC-H-like tables.

The driver tables carry no cost data, so a deterministic view maps each
``lineitem`` row onto one (date, factory, shift) cost record.  Every
measure is a whole-number double, so sums are exact in any order and any
engine.  The same view is written in DuckDB SQL in ``plans/oracle.py``.

The row key ``(l_orderkey, l_linenumber, l_partkey, l_suppkey)`` is kept
beside the record columns (it is unique per row).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Columns of lineitem the views read (everything else is pruned at the scan).
_LINEITEM_COLUMNS = KEY_COLUMNS + [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _measures() -> dict:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return {
        "energy_type_1": q.cast("double"),
        "energy_type_2": F.floor(q * (F.lit(1.0) + F.lit(10.0) * F.col("l_tax"))).cast("double"),
        "hr_cost": F.floor(p * F.col("l_discount")).cast("double"),
        "operation_cost": F.floor(p * F.lit(0.5)).cast("double"),
        "admin_cost": F.floor(p * F.col("l_tax")).cast("double"),
        "other_cost": (F.col("l_linenumber") * F.lit(10)).cast("double"),
        "revenue": F.floor(p).cast("double"),
    }


def _factory() -> F.Column:
    return F.concat(F.lit("F"), F.lpad((F.col("l_suppkey") % F.lit(7)).cast("string"), 2, "0"))


def cost_records(spark: SparkSession, sf_dir: str, revenue: bool = True) -> DataFrame:
    """Typed cost records: date, factory, shift, six measures (+ revenue)."""
    li = table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLUMNS)
    m = _measures()
    if not revenue:
        m.pop("revenue")
    return li.select(
        *KEY_COLUMNS,
        F.col("l_shipdate").cast("date").alias("date"),
        _factory().alias("factory"),
        F.concat(F.lit("S_"), F.col("l_returnflag")).alias("shift"),
        *[c.alias(n) for n, c in m.items()],
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as an untyped upload: text cells under display
    headers with spaces and mixed case, three date spellings, null tokens,
    padded numbers and a few unreadable cells, all chosen by row values.

    Rows with line number 7 and status 'O' carry an unreadable date and are
    dropped by cleaning; every other row survives."""
    li = table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLUMNS, "l_linestatus")
    m = _measures()
    d = F.col("l_shipdate").cast("date")
    ln = F.col("l_linenumber")
    date_text = (
        F.when((ln == 7) & (F.col("l_linestatus") == "O"), F.lit("not a date"))
        .when(F.col("l_returnflag") == "A", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("l_returnflag") == "N", F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "dd MMM yyyy"))
    )

    def num_text(c: F.Column, bad_line: int, pad_line: int) -> F.Column:
        t = c.cast("bigint").cast("string")
        return (F.when(ln == bad_line, F.lit("n/a"))
                .when(ln == pad_line, F.concat(F.lit(" "), t, F.lit(" ")))
                .otherwise(t))

    return li.select(
        *KEY_COLUMNS,
        date_text.alias(" Date "),
        F.when(ln == 7, F.lit("NA")).otherwise(_factory()).alias("Factory"),
        F.when(ln == 6, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S_"), F.col("l_returnflag"))).alias("Shift"),
        num_text(m["energy_type_1"], 1, 2).alias("Energy Type 1"),
        num_text(m["energy_type_2"], 2, 3).alias("Energy Type 2"),
        num_text(m["hr_cost"], 3, 4).alias("HR Cost"),
        num_text(m["operation_cost"], 4, 5).alias("Operation Cost"),
        num_text(m["admin_cost"], 5, 6).alias("Admin Cost"),
        num_text(m["other_cost"], 6, 1).alias("Other Cost"),
        num_text(m["revenue"], 7, 3).alias("Revenue"),
    )
