"""Cleaning: names, dates, numbers, categories, derived totals, shift codes.

Each operator is ``DataFrame -> DataFrame`` and chains with
``df.transform``.  All are narrow projections except ``drop_bad_dates``
(an EXISTS probe that stops at the first good date; no shuffle of the
rows) and ``encode_shift`` (a join against the ranked distinct shifts, read
from a small written table, so the planner broadcasts it by its measured
size).
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.date_shapes import parse_dates
from ..functions.values import (
    is_temporal_type, normalized_names, null_token, to_category, to_number,
)
from ..plans.ranking import dense_rank_distinct
from ..schema import (
    CATEGORICAL_COLUMNS, COST_COMPONENTS, DISPLAY_NAMES, ENERGY_COLUMNS, NUMERIC_COLUMNS,
)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim, lowercase and underscore every column name."""
    return df.toDF(*normalized_names(df.columns))


def date_columns(df: DataFrame) -> list[str]:
    """Columns treated as dates: the name contains 'date' and the type is
    text, date or timestamp (numbers are never read as dates)."""
    out = []
    for f in df.schema.fields:
        if "date" in f.name and (is_temporal_type(f.dataType) or f.dataType.typeName() == "string"):
            out.append(f.name)
    return out


def coerce_dates(df: DataFrame) -> DataFrame:
    """Parse every date column; unreadable values become null (P4).  Text
    columns are read by the shapes of their values (one aggregate over them
    runs here); dates and timestamps pass through."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return parse_dates(df, [c for c in date_columns(df) if not is_temporal_type(types[c])])


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """Drop rows whose date is null, for each date column that has at least
    one good value; the first usable date column is renamed ``date`` (P5).

    "Has a good value" is an EXISTS probe (a scalar sub-query over
    ``limit(1)``): Spark stops at the first non-null date instead of
    parsing the whole column a second time.  Columns are checked in order,
    each on the rows the earlier ones kept.  Only with several candidates
    and no ``date`` among them, one aggregate finds the first usable one."""
    cols = date_columns(df)
    if not cols:
        return df
    out = df
    for c in cols:
        has_good = F.coalesce(
            out.where(F.col(c).isNotNull()).select(F.lit(True).alias("g")).limit(1).scalar(),
            F.lit(False))
        out = out.where(F.col(c).isNotNull() | ~has_good)
    if "date" not in df.columns:
        first = cols[0]
        if len(cols) > 1:
            good = df.agg(*[F.count(c).alias(c) for c in cols]).first()
            first = next((c for c in cols if good[c]), first)
        out = out.withColumnRenamed(first, "date")
    return out


def dropped_rows(df: DataFrame) -> DataFrame:
    """How many rows cleaning drops for an unreadable date: ``(rows,
    dropped)`` of an upload before cleaning."""
    typed = coerce_dates(normalize_columns(df))
    cols = date_columns(typed)
    counts = typed.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"good_{c}") for c in cols],
                       F.count(F.when(reduce(and_, [F.col(c).isNotNull() for c in cols]), 1)).alias("all_good")) if cols else None
    if len(cols) <= 1:
        if not cols:
            return df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("dropped"))
        return counts.select("rows", F.when(F.col("all_good") > 0, F.col("rows") - F.col("all_good")).otherwise(0).cast("long").alias("dropped"))
    kept = drop_bad_dates(typed).agg(F.count("*").alias("kept")).scalar()
    return counts.select("rows", (F.col("rows") - kept).cast("long").alias("dropped"))


def null_tokens(df: DataFrame) -> DataFrame:
    """Text that a file reader treats as missing becomes null, in every text
    column (S4)."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: null_token(F.col(f"`{c}`")) for c in texts}) if texts else df


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Known measure columns to double; unreadable or missing -> 0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in NUMERIC_COLUMNS if c in types]
    if not present:
        return df
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in present})


def fill_categoricals(df: DataFrame) -> DataFrame:
    """Missing factory / shift -> 'unknown', as text."""
    present = [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    if not present:
        return df
    return df.withColumns({c: to_category(F.col(c)) for c in present})


def derive_totals(df: DataFrame) -> DataFrame:
    """total_opex = sum of the cost components present (energy excluded);
    total_energy = energy 1 + energy 2 when both exist (P8, P9).
    Without any component an existing total_opex is coerced to a number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    comps = [c for c in COST_COMPONENTS if c in types]
    new = {}
    if comps:
        new["total_opex"] = reduce(add, [F.col(c) for c in comps])
    elif "total_opex" in types:
        new["total_opex"] = to_number(F.col("total_opex"), types["total_opex"])
    if all(c in types for c in ENERGY_COLUMNS):
        new["total_energy"] = F.col(ENERGY_COLUMNS[0]) + F.col(ENERGY_COLUMNS[1])
    return df.withColumns(new) if new else df


def encode_shift(df: DataFrame) -> DataFrame:
    """shift_code = 0-based position of the shift among the sorted distinct
    shifts (P10).  Distinct shifts are ranked without a global window, then
    joined back; AQE broadcasts the code table when it is small and splits
    skewed partitions otherwise."""
    if "shift" not in df.columns:
        return df
    codes = dense_rank_distinct(df.select("shift"), "shift", "shift_code")
    return df.join(codes, on="shift", how="left").select(*df.columns, "shift_code")


def clean(df: DataFrame, with_shift_code: bool = True) -> DataFrame:
    """Full cleaning pipeline."""
    out = (df.transform(normalize_columns)
             .transform(null_tokens)
             .transform(coerce_dates)
             .transform(drop_bad_dates)
             .transform(coerce_numeric)
             .transform(fill_categoricals)
             .transform(derive_totals))
    if with_shift_code:
        out = out.transform(encode_shift)
    return out


def display_names(df: DataFrame) -> DataFrame:
    """Rename canonical names to the dashboard's display names."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


def canonical_names(df: DataFrame) -> DataFrame:
    """Inverse of display_names: lowercase every name."""
    return df.toDF(*[c.lower() for c in df.columns])
