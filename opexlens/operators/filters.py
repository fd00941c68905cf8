"""Dashboard filters (F1-F10).  Every predicate is a plain ``where`` on the
records, so Catalyst pushes it into the Parquet scan when the records come
straight from files."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRESETS


def _as_date(v) -> Column:
    return v if isinstance(v, Column) else F.to_date(F.lit(str(v)))


def date_predicate(df: DataFrame, start, end) -> Column | None:
    """Inclusive date range; only when both ends are given and a date
    column exists.  On timestamps the end is midnight of the end day."""
    if start is None or end is None or "date" not in df.columns:
        return None
    dt = df.schema["date"].dataType.typeName()
    lo, hi = _as_date(start), _as_date(end)
    if dt != "date":
        lo, hi = lo.cast("timestamp"), hi.cast("timestamp")
    return F.col("date").between(lo, hi)


def predicates(df: DataFrame, filters: dict) -> list[Column]:
    """Predicates for a filter dict with keys ``date_range`` (start, end),
    ``factory``, ``shift``, ``energy1_min``/``max``, ``energy2_min``/``max``."""
    preds: list[Column] = []
    if filters.get("date_range"):
        p = date_predicate(df, *filters["date_range"])
        if p is not None:
            preds.append(p)
    for key in ("factory", "shift"):
        if filters.get(key):
            preds.append(F.col(key) == F.lit(filters[key]))
    bounds = [("energy1_min", "energy_type_1", ">="), ("energy1_max", "energy_type_1", "<="),
              ("energy2_min", "energy_type_2", ">="), ("energy2_max", "energy_type_2", "<=")]
    for key, col, op in bounds:
        if filters.get(key) is not None:
            v = F.lit(float(filters[key]))
            preds.append(F.col(col) >= v if op == ">=" else F.col(col) <= v)
    return preds


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Conjunction of all given predicates, as one ``where`` (F8)."""
    preds = predicates(df, filters)
    return df.where(reduce(and_, preds)) if preds else df


def filter_dates(df: DataFrame, start, end) -> DataFrame:
    return apply_filters(df, {"date_range": (start, end)})


def filter_factory(df: DataFrame, factory: str | None) -> DataFrame:
    return apply_filters(df, {"factory": factory})


def filter_shift(df: DataFrame, shift: str | None) -> DataFrame:
    return apply_filters(df, {"shift": shift})


def filter_energy(df: DataFrame, e1_min=None, e1_max=None, e2_min=None, e2_max=None) -> DataFrame:
    return apply_filters(df, {"energy1_min": e1_min, "energy1_max": e1_max,
                              "energy2_min": e2_min, "energy2_max": e2_max})


def preset_range(preset: str, as_of=None, start=None, end=None) -> tuple | None:
    """Relative presets ending at ``as_of`` (default: today).  Months and
    years step back with ``add_months`` (31 Mar - 1 month = 28/29 Feb)."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; expected one of {PRESETS}")
    if preset == "ALL":
        return None
    if preset == "CUSTOM":
        return (start, end) if start is not None and end is not None else None
    hi = F.current_date() if as_of is None else _as_date(as_of)
    lo = {"1D": F.date_sub(hi, 1), "1W": F.date_sub(hi, 7),
          "1M": F.add_months(hi, -1), "1Y": F.add_months(hi, -12)}[preset]
    return lo, hi


def filter_preset(df: DataFrame, preset: str, as_of=None, start=None, end=None) -> DataFrame:
    rng = preset_range(preset, as_of, start, end)
    return df if rng is None else filter_dates(df, *rng)
