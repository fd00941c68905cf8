"""Energy price what-if (W1-W4): one scan, one aggregate row.

Scaling every energy value by ``f = 1 + pct/100`` and summing equals
``f * sum(energy)``; the factor is applied after the sum, which keeps the
total exact for whole-number inputs and independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio_pct, sum0
from ..schema import COST_COMPONENTS, ENERGY_COLUMNS, WHATIF_DEFAULT_PCT

_REQUIRED = COST_COMPONENTS + ENERGY_COLUMNS


def scale_energy(df: DataFrame, pct: float = WHATIF_DEFAULT_PCT) -> DataFrame:
    """Energy columns scaled by (1 + pct/100), row by row."""
    f = F.lit(1.0 + float(pct) / 100.0)
    return df.withColumns({c: F.col(c) * f for c in ENERGY_COLUMNS if c in df.columns})


def _check(df: DataFrame) -> None:
    missing = [c for c in _REQUIRED + ["total_opex"] if c not in df.columns]
    if missing:
        raise ValueError(f"what-if needs columns {missing}")


def _scenario(df: DataFrame, pct: float, like_for_like: bool) -> DataFrame:
    _check(df)
    f = F.lit(1.0 + float(pct) / 100.0)
    s = df.agg(sum0(F.col("hr_cost") + F.col("operation_cost") + F.col("admin_cost")
                    + F.col("other_cost")).alias("c"),
               sum0(F.col("energy_type_1") + F.col("energy_type_2")).alias("e"),
               sum0("total_opex").alias("o"))
    new = F.col("c") + F.col("e") * f
    original = F.col("o") + F.col("e") if like_for_like else F.col("o")
    inc = new - original
    return s.select(original.alias("original_total_opex"), new.alias("new_total_opex"),
                    inc.alias("absolute_increase"), ratio_pct(inc, original).alias("percent_increase"))


def whatif(df: DataFrame, pct: float = WHATIF_DEFAULT_PCT) -> DataFrame:
    """New total = four cost components + scaled energies; original total =
    stored total_opex, which has no energy in it (W2, W3)."""
    return _scenario(df, pct, like_for_like=False)


def whatif_like_for_like(df: DataFrame, pct: float = WHATIF_DEFAULT_PCT) -> DataFrame:
    """Same, with energy in both totals, so 0 % gives 0 increase."""
    return _scenario(df, pct, like_for_like=True)
