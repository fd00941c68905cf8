"""Column expressions for cleaning values: numbers, dates, categories, names.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none needs Python at run time.  ANSI mode is on in Spark 4, so every
conversion uses the ``try_`` family.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NA_TOKENS, UNKNOWN

# Plain decimal / scientific number text.  Spark would also accept '1d',
# '1f', 'NaN' and 'inf', which a tabular file reader does not read as
# numbers, so text is checked against this pattern before the cast.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Date and timestamp text forms.  Each has one pattern whose groups, in ISO
# order, are cast (``date_shapes`` finds their places by the value's shape).
_TIME = r"( [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"
_NAME = "[A-Za-z]{3,9}"
ISO_DATE = (r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?"
            r"( ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?)?$")
# (pattern, ISO rewrites tried in this order): month-first before day-first
# with slashes, day-first before month-first with dashes and dots; two-digit
# years are 20xx.
NUMERIC_DATES = [
    (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){_TIME}$", ["$3-$1-$2$4", "$3-$2-$1$4"]),
    (rf"^([0-9]{{1,2}})[.-]([0-9]{{1,2}})[.-]([0-9]{{4}}){_TIME}$", ["$3-$2-$1$4", "$3-$1-$2$4"]),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", ["20$3-$1-$2", "20$3-$2-$1"]),
    (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", ["$1-$2-$3"]),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", ["$1-$2-$3"]),
]
# Day, month name, year in either order.
NAMED_DATES = [(rf"^([0-9]{{1,2}})[ -]({_NAME})[ -]([0-9]{{4}}|[0-9]{{2}})$", 1, 2, 3),
               (rf"^({_NAME}) ([0-9]{{1,2}}),? ([0-9]{{4}})$", 2, 1, 3)]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
CLOCK_12 = (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2} [AaPp][Mm]$", "M/d/yyyy h:mm a")

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC_TYPES)


def is_temporal_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def null_token(c: Column) -> Column:
    """Text that a file reader treats as missing becomes null."""
    return F.when(F.trim(c).isin(NA_TOKENS), F.lit(None)).otherwise(c)


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Coerce to double; anything unreadable (text, NaN, missing) is 0."""
    if is_numeric_type(dtype):
        v = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        v = c.cast("int").cast("double")
    else:
        s = F.trim(c.cast("string"))
        # Plain digits, the usual cell, need no pattern.
        plain = (F.translate(s, "0123456789", "") == "") & (s != "")
        v = F.when(plain | s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))


def to_category(c: Column) -> Column:
    """Missing category (null or a null token) becomes 'unknown'."""
    return F.coalesce(null_token(c.cast("string")), F.lit(UNKNOWN))


def normalize_name(name: str) -> str:
    """Trim, lowercase, and turn spaces into underscores."""
    return name.strip().lower().replace(" ", "_")


def normalized_names(names: list[str]) -> list[str]:
    """Normalize all names; later duplicates get a ``_2``, ``_3`` suffix
    (Spark cannot hold two columns of one name)."""
    out: list[str] = []
    seen: set[str] = set()
    for n in names:
        base = normalize_name(n)
        cand, k = base, 1
        while cand in seen:
            k += 1
            cand = f"{base}_{k}"
        seen.add(cand)
        out.append(cand)
    return out


def ratio_pct(num: Column, den: Column) -> Column:
    """num / den * 100, or 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num, den) * F.lit(100.0), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, or 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def sum0(c: Column | str) -> Column:
    """Sum that is 0, not null, over no rows."""
    return F.coalesce(F.sum(c), F.lit(0.0))
