"""Dates of a text column, read by shape.

A value's shape is its text with every digit as ``9`` and every letter as
``a``.  One aggregate counts the shapes of a column; for each shape that can be
a date one parse is chosen, which takes the parts from fixed positions.
Whether ``03/04`` means a day or a month first is settled by the column: a
first number above 12 anywhere (and no such second number) says day first.  A
row that cannot be read in the column's order is tried in the other one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import CLOCK_12, ISO_DATE, MONTHS, NAMED_DATES, NUMERIC_DATES

_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLOCK = r"9{1,2}:9{2}(:9{2}([.]9{1,9})?)?"
# Shapes that a known spelling can have (a finite set, so they may be collected).
DATE_SHAPE = "|".join([
    rf"9{{4}}-9{{1,2}}(-9{{1,2}}([a ]{_CLOCK}( ?(a{{1,3}}|[+-]9{{2}}:?9{{2}}))?)?)?", rf"9{{1,2}}[/.-]9{{1,2}}[/.-]9{{4}}( {_CLOCK}( aa)?)?",
    "9{1,2}/9{1,2}/9{2}", "9{4}/9{1,2}/9{1,2}", "9{8}", "9{4}", "9{1,2}[ -]a{3,9}[ -](9{4}|9{2})", "a{3,9} 9{1,2},? 9{4}"])
# Numeric spellings that name the month first unless the column says otherwise.
_MONTH_FIRST = (0, 2)
_EITHER_WAY = (0, 1, 2)


def shape(value: Column) -> Column:
    return F.translate(value, _DIGITS + _LETTERS, "9" * 10 + "a" * 52)


@dataclass
class ColumnDates:
    """Shapes of one column that are read, by parse: ("iso" | "clock", None),
    ("numeric", pattern number) or ("named", pattern number); and the patterns
    whose order the column turned round."""
    shapes: dict[str, tuple[str, int | None]] = field(default_factory=dict)
    turned: set[int] = field(default_factory=set)


def _choose(example: str) -> tuple[str, int | None] | None:
    if re.fullmatch(ISO_DATE.strip("^$"), example):
        return "iso", None
    for k, (pattern, _) in enumerate(NUMERIC_DATES):
        if re.match(pattern, example):
            return "numeric", k
    for k, (pattern, *_) in enumerate(NAMED_DATES):
        if re.match(pattern, example):
            return "named", k
    return ("clock", None) if re.match(CLOCK_12[0], example) else None


def survey(df: DataFrame, columns: list[str]) -> dict[str, ColumnDates]:
    """Shapes of the text columns, from one grouped aggregate over them."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.trim(F.col(f"`{c}`").cast("string")).alias("s")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("s IS NOT NULL")
    parts = F.split(F.translate("s", ".-", "//"), "/")
    first, second = (F.get(parts, F.lit(i)).try_cast("int") for i in (0, 1))
    found = rows.select("c", "s", shape(F.col("s")).alias("shape")).groupBy("c", "shape") \
        .agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max(first).alias("first"), F.max(second).alias("second")) \
        .where(F.col("shape").rlike(f"^({DATE_SHAPE})$")).collect()
    out, seen = {c: ColumnDates() for c in columns}, {}
    for r in found:
        # Letters of one shape may differ (a T or a zone): either end may show a date.
        parse = _choose(r["low"]) or _choose(r["high"]) or (("iso", None) if re.match("9{4}-", r["shape"]) else None)
        if parse is None:
            continue
        out[r["c"]].shapes[r["shape"]] = parse
        if parse[0] == "numeric" and parse[1] in _EITHER_WAY:
            a, b = seen.get((r["c"], parse[1]), (False, False))
            seen[r["c"], parse[1]] = (a or (r["first"] or 0) > 12, b or (r["second"] or 0) > 12)
    for (c, k), (large_first, large_second) in seen.items():
        contrary, usual = (large_first, large_second) if k in _MONTH_FIRST else (large_second, large_first)
        if contrary and not usual:
            out[c].turned.add(k)
    return out


def _pieces(s: Column, text: str, pattern: str) -> list[Column]:
    """The pattern's groups, from their places in this shape."""
    # The shape itself matches the pattern: 9 is a digit, a is a letter.
    m = re.match(pattern, text)
    return [F.substring(s, a + 1, b - a) if b > a else F.lit("") for a, b in (m.span(g) for g in range(1, (m.re.groups or 0) + 1))]


def _read(s: Column, text: str, parse: tuple[str, int | None], turned: set[int]) -> Column:
    kind, k = parse
    if kind == "iso":
        plain = "a" not in text
        return s.try_cast("timestamp") if plain else F.when(s.rlike(ISO_DATE), s.try_cast("timestamp"))
    if kind == "clock":
        return F.when(s.rlike(CLOCK_12[0]), F.try_to_timestamp(F.upper(s), F.lit(CLOCK_12[1])))
    if kind == "numeric":
        pattern, rewrites = NUMERIC_DATES[k]
        groups = _pieces(s, text, pattern)
        tries = []
        for rewrite in (reversed(rewrites) if k in turned else rewrites):
            parts = [groups[int(p[1]) - 1] if p.startswith("$") else F.lit(p) for p in re.findall(r"\$[0-9]|[^$]+", rewrite)]
            tries.append(F.concat(*parts).try_cast("timestamp"))
        return F.coalesce(*tries)
    pattern, day, name, year = NAMED_DATES[k]
    groups = _pieces(s, text, pattern)
    numbers = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS) for n in dict.fromkeys([m, m[:3]]) for v in (n, str(i + 1))])
    century = "20" if len(re.match(pattern, text)[year]) == 2 else ""
    return F.concat(F.lit(century), groups[year - 1], F.lit("-"), F.try_element_at(numbers, F.lower(groups[name - 1])), F.lit("-"), groups[day - 1]).try_cast("timestamp")


def parse_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the text columns as timestamps; what has no known shape, or
    does not name a day, becomes null.  Values keep their row; a column without
    dates becomes null throughout."""
    if not columns:
        return df
    plans = survey(df, columns)
    marks = {c: f"__shape_{i}" for i, c in enumerate(columns)}
    # A column of its own: the shape is made once a row.
    out = df.withColumns({m: F.try_element_at(_numbers(plans[c]), shape(F.trim(F.col(f"`{c}`").cast("string")))) if plans[c].shapes else F.lit(None).cast("int")
                          for c, m in marks.items()})
    parsed = {}
    for c, m in marks.items():
        s, branches = F.trim(F.col(f"`{c}`").cast("string")), None
        for i, (text, parse) in enumerate(sorted(plans[c].shapes.items())):
            value = _read(s, text, parse, plans[c].turned)
            branches = F.when(F.col(m) == i, value) if branches is None else branches.when(F.col(m) == i, value)
        parsed[c] = F.lit(None).cast("timestamp") if branches is None else branches
    return out.withColumns(parsed).drop(*marks.values())


def _numbers(plan: ColumnDates) -> Column:
    return F.create_map(*[F.lit(v) for i, t in enumerate(sorted(plan.shapes)) for v in (t, i)])
