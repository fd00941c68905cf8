"""DuckDB SQL equal in meaning to each registered query (the correctness
oracle).  Tables ``lineitem``, ``events`` ... are views over the same
parquet files.  Every output column is aliased and cast to the type the
Spark query returns."""

from __future__ import annotations

from ..schema import KPI_LABELS
from .oracle_trees import gini_accuracy, isolation_scores, tree_splits

# The oracle's own statement of what a number looks like and of the texts a
# file reader takes for missing (not the constants of the code under test).
NUMBER_TEXT = "^[-+]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][-+]?\\d+)?$"
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Cost-record view over lineitem (same rule as sources.fixtures).
REC_COLUMNS = """
  l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_shipdate AS DATE) AS date,
  concat('F', lpad(CAST(l_suppkey % 7 AS VARCHAR), 2, '0')) AS factory,
  concat('S_', l_returnflag) AS shift,
  CAST(l_quantity AS DOUBLE) AS energy_type_1,
  CAST(floor(l_quantity * (1 + 10 * l_tax)) AS DOUBLE) AS energy_type_2,
  CAST(floor(l_extendedprice * l_discount) AS DOUBLE) AS hr_cost,
  CAST(floor(l_extendedprice * 0.5) AS DOUBLE) AS operation_cost,
  CAST(floor(l_extendedprice * l_tax) AS DOUBLE) AS admin_cost,
  CAST(l_linenumber * 10 AS DOUBLE) AS other_cost"""

REC = f"SELECT {REC_COLUMNS}, CAST(floor(l_extendedprice) AS DOUBLE) AS revenue FROM lineitem"
REC_NO_REVENUE = f"SELECT {REC_COLUMNS} FROM lineitem"


def cleaned(src: str = REC) -> str:
    return f"""SELECT *, hr_cost + operation_cost + admin_cost + other_cost AS total_opex,
                      energy_type_1 + energy_type_2 AS total_energy
               FROM ({src})"""


def with_ctes(body: str, src: str = REC, extra: str = "") -> str:
    return f"WITH r AS ({cleaned(src)}){extra}\n{body}"


def _kpis(src: str, revenue: bool) -> str:
    fac = """, fc AS (SELECT factory, sum(total_opex) AS c FROM r GROUP BY factory),
               sc AS (SELECT shift, avg(total_opex) AS c FROM r GROUP BY shift),
               s AS (SELECT coalesce(sum(total_opex), 0) AS o, coalesce(sum(total_energy), 0) AS e,
                            coalesce(sum(hr_cost), 0) AS h, coalesce(sum(admin_cost), 0) AS a"""
    fac += (", coalesce(sum(revenue), 0) AS v" if revenue else "") + " FROM r)"
    eff = ("CASE WHEN e = 0 THEN 0.0 ELSE v / e END AS energy_efficiency, 'revenue' AS efficiency_basis"
           if revenue else
           "CASE WHEN e = 0 THEN 0.0 ELSE o / e END AS energy_efficiency, 'opex' AS efficiency_basis")
    rev = ("v AS total_revenue, v - o AS profit, "
           "CASE WHEN v = 0 THEN 0.0 ELSE (v - o) / v * 100 END AS profit_margin, ") if revenue else ""
    body = f"""SELECT o AS total_opex, e AS total_energy, {rev} {eff},
      coalesce((SELECT factory FROM fc ORDER BY c DESC, factory ASC LIMIT 1), 'N/A') AS top_factory,
      coalesce((SELECT factory FROM fc ORDER BY c ASC, factory DESC LIMIT 1), 'N/A') AS bottom_factory,
      coalesce((SELECT shift FROM sc ORDER BY c DESC, shift ASC LIMIT 1), 'N/A') AS most_expensive_shift,
      coalesce((SELECT shift FROM sc ORDER BY c ASC, shift DESC LIMIT 1), 'N/A') AS cheapest_shift,
      CASE WHEN o = 0 THEN 0.0 ELSE h / o * 100 END AS hr_percent,
      CASE WHEN o = 0 THEN 0.0 ELSE a / o * 100 END AS admin_percent
    FROM s"""
    return with_ctes(body, src, fac)


ORACLE: dict[str, str] = {
    "clean": with_ctes("SELECT *, CAST(dense_rank() OVER (ORDER BY shift) - 1 AS INTEGER) AS shift_code FROM r"),
    "kpis": _kpis(REC, True),
    "kpis_no_revenue": _kpis(REC_NO_REVENUE, False),
}


def _records_where(cond: str) -> str:
    return with_ctes(f"SELECT * FROM r WHERE {cond}")


def _ranking(name: str, measure_sql: str, out: str) -> str:
    return with_ctes(f"""SELECT {name}, {out}, CAST(row_number() OVER (ORDER BY {out} DESC, {name} ASC) AS INTEGER) AS rank
        FROM (SELECT {name}, {measure_sql} AS {out} FROM r GROUP BY {name})""")


_KPI_ORDER = ["total_opex", "total_energy", "total_revenue", "profit", "profit_margin",
              "energy_efficiency", "hr_percent", "admin_percent", "top_factory", "bottom_factory",
              "most_expensive_shift", "cheapest_shift"]
_KPI_TEXT = {"top_factory", "bottom_factory", "most_expensive_shift", "cheapest_shift"}


def _kpis_long(src: str = REC) -> str:
    parts = []
    for i, k in enumerate(_KPI_ORDER):
        v = "CAST(NULL AS DOUBLE)" if k in _KPI_TEXT else k
        t = k if k in _KPI_TEXT else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {i} AS position, '{k}' AS kpi, '{KPI_LABELS[k]}' AS label, "
                     f"{v} AS value, {t} AS text FROM kb")
    return f"WITH kb AS ({_kpis(src, True)})\n" + "\nUNION ALL\n".join(parts)


def _kpis_formatted() -> str:
    return f"""WITH l AS ({_kpis_long()})
    SELECT position, kpi, label,
      CASE WHEN value IS NULL THEN text
           WHEN label LIKE '%Utilization%' THEN printf('%.1f', value * 100) || '%'
           WHEN label LIKE '%\\%%' ESCAPE '\\' THEN printf('%.2f', value) || '%'
           WHEN label LIKE '%Revenue%' OR label LIKE '%Cost%' OR label LIKE '%Profit%' THEN '$' || printf('%.2f', value)
           ELSE printf('%.2f', value) END AS display
    FROM l"""


MEASURES = ["energy_type_1", "energy_type_2", "hr_cost", "operation_cost", "admin_cost",
            "other_cost", "revenue", "total_opex", "total_energy"]


EXTRA_SRC = f"SELECT *, CAST(l_partkey % 50 AS DOUBLE) AS water_use, CAST(l_suppkey % 9 AS INTEGER) AS headcount FROM ({REC})"
# Columns in the order the records have them (pairs of the correlation).
EXTRA_MEASURES = [*MEASURES, "water_use", "headcount"]


def _describe(measures=MEASURES, src=REC) -> str:
    vals = [f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM r" for c in measures]
    vals.append("SELECT 'date' AS col, CAST(datediff('day', DATE '1970-01-01', date) AS DOUBLE) AS v FROM r")
    stats = [("count", "CAST(count(v) AS DOUBLE)"), ("mean", "avg(v)"), ("min", "min(v)"),
             ("max", "max(v)"), ("std", "stddev_samp(v)"), ("25%", "quantile_cont(v, 0.25)"),
             ("50%", "quantile_cont(v, 0.5)"), ("75%", "quantile_cont(v, 0.75)")]
    sel = "\nUNION ALL\n".join(
        f"SELECT col AS \"column\", '{s}' AS statistic, round({e}, 6) AS value FROM vals "
        + ("WHERE col <> 'date' " if s == "std" else "") + "GROUP BY col" for s, e in stats)
    return with_ctes(sel, src=src, extra=", vals AS (" + "\nUNION ALL\n".join(vals) + ")")


def _correlation(measures=MEASURES, src=REC) -> str:
    parts = []
    for i, a in enumerate(measures):
        for b in measures[i + 1:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 8) AS corr FROM r")
    return with_ctes("\nUNION ALL\n".join(parts), src=src)


def _whatif(like: bool) -> str:
    orig = "o + e" if like else "o"
    return with_ctes(f"""SELECT {orig} AS original_total_opex, c + e * (1 + 10.0 / 100) AS new_total_opex,
        c + e * (1 + 10.0 / 100) - ({orig}) AS absolute_increase,
        CASE WHEN ({orig}) = 0 THEN 0.0 ELSE (c + e * (1 + 10.0 / 100) - ({orig})) / ({orig}) * 100 END AS percent_increase
      FROM (SELECT coalesce(sum(hr_cost + operation_cost + admin_cost + other_cost), 0) AS c,
                   coalesce(sum(energy_type_1 + energy_type_2), 0) AS e,
                   coalesce(sum(total_opex), 0) AS o FROM r)""")


# Daily grid with calendar features, over cleaned records r.
GRID = """, daily AS (SELECT date, sum(total_opex) AS total_opex, sum(total_energy) AS total_energy FROM r GROUP BY date),
  b AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
  cal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
  grid AS (SELECT cal.date, coalesce(daily.total_opex, 0) AS total_opex, coalesce(daily.total_energy, 0) AS total_energy,
                  CAST(isodow(cal.date) - 1 AS INTEGER) AS dayofweek, CAST(month(cal.date) AS INTEGER) AS month,
                  CAST(day(cal.date) AS INTEGER) AS day,
                  CAST(datediff('day', (SELECT lo FROM b), cal.date) AS INTEGER) AS days_since_start
           FROM cal LEFT JOIN daily ON cal.date = daily.date)"""

# Ordinary least squares of total_opex on the four features over training
# days, by sequential orthogonalisation (centre; residualise each feature on
# the earlier ones; project y), then applied to any feature table.
OLS = """, tr AS (SELECT * FROM grid WHERE days_since_start % 5 <> 4),
  m AS (SELECT avg(dayofweek) AS m1, avg(month) AS m2, avg(day) AS m3, avg(days_since_start) AS m4, avg(total_opex) AS my FROM tr),
  c AS (SELECT dayofweek - m1 AS c1, month - m2 AS c2, day - m3 AS c3, days_since_start - m4 AS c4, total_opex - my AS cy FROM tr, m),
  k2 AS (SELECT sum(c2 * c1) / sum(c1 * c1) AS b21 FROM c),
  z2 AS (SELECT c.*, c1 AS z1, c2 - b21 * c1 AS z2 FROM c, k2),
  k3 AS (SELECT sum(c3 * z1) / sum(z1 * z1) AS b31, sum(c3 * z2) / sum(z2 * z2) AS b32 FROM z2),
  z3 AS (SELECT z2.*, c3 - b31 * z1 - b32 * z2 AS z3 FROM z2, k3),
  k4 AS (SELECT sum(c4 * z1) / sum(z1 * z1) AS b41, sum(c4 * z2) / sum(z2 * z2) AS b42, sum(c4 * z3) / sum(z3 * z3) AS b43 FROM z3),
  z4 AS (SELECT z3.*, c4 - b41 * z1 - b42 * z2 - b43 * z3 AS z4 FROM z3, k4),
  g AS (SELECT sum(cy * z1) / sum(z1 * z1) AS g1, sum(cy * z2) / sum(z2 * z2) AS g2,
               sum(cy * z3) / sum(z3 * z3) AS g3, sum(cy * z4) / sum(z4 * z4) AS g4 FROM z4)"""


def _score(feats: str) -> str:
    """Predictions for a feature table (needs m, k2..k4, g)."""
    return f"""SELECT f.*, my + g1 * z1 + g2 * z2 + g3 * z3 + g4 * z4 AS prediction FROM (
      SELECT f.*, z1, z2, z3, c4 - b41 * z1 - b42 * z2 - b43 * z3 AS z4 FROM (
        SELECT f.*, z1, z2, c3 - b31 * z1 - b32 * z2 AS z3 FROM (
          SELECT f.*, c1 AS z1, c2 - b21 * c1 AS z2 FROM (
            SELECT f.*, dayofweek - m1 AS c1, month - m2 AS c2, day - m3 AS c3, days_since_start - m4 AS c4
            FROM ({feats}) f, m) f, k2) f, k3) f, k4) f, m, g"""


def _future(h: int) -> str:
    return f""", fut AS (SELECT CAST(i AS INTEGER) AS day_index, CAST(hi + CAST(i AS INTEGER) AS DATE) AS date
                  FROM b, range(1, {h} + 1) t(i)),
  futf AS (SELECT day_index, date, CAST(isodow(date) - 1 AS INTEGER) AS dayofweek, CAST(month(date) AS INTEGER) AS month,
                  CAST(day(date) AS INTEGER) AS day, CAST(datediff('day', (SELECT lo FROM b), date) AS INTEGER) AS days_since_start
           FROM fut),
  pred AS ({_score("SELECT * FROM futf")})"""


def _forecast(h: int, src: str = REC) -> str:
    return with_ctes("""SELECT day_index, date, round(prediction, 2) AS prediction FROM pred
                        WHERE (SELECT count(*) FROM grid) >= 10""",
                     src=src, extra=GRID + OLS + _future(h))


def _forecast_metrics() -> str:
    body = """SELECT round(1 - sum((total_opex - prediction) ^ 2) / sum((total_opex - ybar) ^ 2), 6) AS r2,
                     round(avg(abs(total_opex - prediction)), 6) AS mae,
                     round(sqrt(avg((total_opex - prediction) ^ 2)), 6) AS rmse
              FROM tp, (SELECT avg(total_opex) AS ybar FROM tp)"""
    return with_ctes(body, extra=GRID + OLS + f", tp AS ({_score('SELECT * FROM grid WHERE days_since_start % 5 = 4')})")


def _forecast_total(h: int) -> str:
    return with_ctes("""SELECT round(coalesce(sum(round(prediction, 12)), 0), 2) AS total_forecast,
        round(avg(round(prediction, 12)), 2) AS avg_daily_forecast, CAST(count(*) AS BIGINT) AS days FROM pred""",
                     extra=GRID + OLS + _future(h))


def _future_kpis(h: int) -> str:
    return with_ctes("""SELECT round(t, 2) AS next_month_total_cost,
        round(t * (SELECT CASE WHEN sum(total_opex) = 0 THEN 0.0 ELSE sum(total_energy) / sum(total_opex) END FROM r), 2)
          AS estimated_energy_demand,
        CAST(30 AS INTEGER) AS budget_overrun_prob,
        (SELECT factory FROM (SELECT factory, sum(total_opex) AS c FROM r GROUP BY factory) ORDER BY c DESC, factory LIMIT 1)
          AS most_expensive_factory,
        (SELECT shift FROM (SELECT shift, avg(total_opex) AS c FROM r GROUP BY shift) ORDER BY c DESC, shift LIMIT 1)
          AS most_expensive_shift,
        round(a, 2) AS avg_daily_cost_next_month
      FROM (SELECT coalesce(sum(round(prediction, 12)), 0) AS t, avg(round(prediction, 12)) AS a FROM pred)""",
                     extra=GRID + OLS + _future(h))


ORACLE.update({
    "filter_dates": _records_where("date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "filter_factory": _records_where("factory = 'F03'"),
    "filter_shift": _records_where("shift = 'S_N'"),
    "filter_energy": _records_where("energy_type_1 >= 10.0 AND energy_type_1 <= 40.0 AND energy_type_2 >= 20.0"),
    "apply_filters": _records_where(
        "date BETWEEN DATE '1995-06-01' AND DATE '1998-06-30' AND factory = 'F03' AND shift = 'S_R' "
        "AND energy_type_1 >= 5.0 AND energy_type_1 <= 45.0 AND energy_type_2 >= 10.0"),
    "filter_preset": _records_where(
        "date BETWEEN CAST((SELECT max(date) FROM r) - INTERVAL 12 MONTH AS DATE) AND (SELECT max(date) FROM r)"),
    "filtered_kpis": _kpis(f"SELECT * FROM ({REC}) WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' "
                           "AND factory = 'F02'", True),
    "factory_ranking": _ranking("factory", "coalesce(sum(total_opex), 0)", "total_opex"),
    "shift_ranking": _ranking("shift", "avg(total_opex)", "avg_opex"),
    "most_expensive": with_ctes("""SELECT
        (SELECT factory FROM (SELECT factory, sum(total_opex) AS c FROM r GROUP BY factory) ORDER BY c DESC, factory LIMIT 1)
          AS most_expensive_factory,
        (SELECT shift FROM (SELECT shift, avg(total_opex) AS c FROM r GROUP BY shift) ORDER BY c DESC, shift LIMIT 1)
          AS most_expensive_shift"""),
    "kpis_labelled": _kpis_long(),
    "kpis_formatted": _kpis_formatted(),
    "filter_values": with_ctes("""SELECT DISTINCT 'factory' AS dimension, factory AS value FROM r
        UNION ALL SELECT DISTINCT 'shift' AS dimension, shift AS value FROM r"""),
    "filter_ranges": with_ctes("""SELECT min(energy_type_1) AS energy1_min, max(energy_type_1) AS energy1_max,
        min(energy_type_2) AS energy2_min, max(energy_type_2) AS energy2_max FROM r"""),
    "trend_daily": with_ctes("SELECT date AS period, coalesce(sum(total_opex), 0) AS value FROM r GROUP BY 1"),
    "trend_weekly": with_ctes(
        "SELECT CAST(date_trunc('week', date) AS DATE) AS period, coalesce(sum(total_opex), 0) AS value FROM r GROUP BY 1"),
    "trend_monthly": with_ctes(
        "SELECT CAST(date_trunc('month', date) AS DATE) AS period, coalesce(sum(total_opex), 0) AS value FROM r GROUP BY 1"),
    "cost_composition": with_ctes(" UNION ALL ".join(
        f"SELECT factory, '{c}' AS component, coalesce(sum({c}), 0) AS cost FROM r GROUP BY factory"
        for c in ["hr_cost", "operation_cost", "admin_cost", "other_cost"])),
    "factory_shift_matrix": with_ctes("SELECT factory, " + ", ".join(
        f"coalesce(sum(CASE WHEN shift = '{s}' THEN total_opex END), 0) AS {s}" for s in ["S_A", "S_N", "S_R"])
        + " FROM r GROUP BY factory"),
    "energy_mix": with_ctes("""SELECT energy_type, total, total / (t1 + t2) * 100 AS share FROM (
        SELECT 'Energy Type 1' AS energy_type, t1 AS total, t1, t2 FROM s
        UNION ALL SELECT 'Energy Type 2', t2, t1, t2 FROM s) WHERE t1 + t2 <> 0""",
        extra=", s AS (SELECT coalesce(sum(energy_type_1), 0) AS t1, coalesce(sum(energy_type_2), 0) AS t2 FROM r)"),
    "describe": _describe(),
    "correlation": _correlation(),
    "whatif": _whatif(False),
    "whatif_like_for_like": _whatif(True),
    "daily_grid": with_ctes("SELECT date, total_opex, total_energy FROM grid", extra=GRID),
    "calendar_features": with_ctes(
        "SELECT date, total_opex, dayofweek, month, day, days_since_start FROM grid", extra=GRID),
    "forecast_split": with_ctes("""SELECT date, total_opex, dayofweek, month, day, days_since_start,
        days_since_start % 5 = 4 AS is_test FROM grid""", extra=GRID),
    "forecast": _forecast(30),
    "forecast_metrics": _forecast_metrics(),
    "forecast_total": _forecast_total(30),
    "future_kpis": _future_kpis(30),
    "trend_line": with_ctes("""SELECT round(regr_slope(total_opex, days_since_start), 6) AS slope,
        round(regr_intercept(total_opex, days_since_start), 6) AS intercept,
        round(regr_r2(total_opex, days_since_start), 6) AS r2, CAST(count(*) AS BIGINT) AS days FROM grid""",
        extra=GRID),
})


# Expected isolation depth: points = distinct interpolated quantiles k/255
# (position p * (n - 1), linear between neighbours), depth per distinct value
# via a join against the points with lag / lead neighbours.
DEPTH = """, srt AS (SELECT total_opex AS v, row_number() OVER (ORDER BY total_opex) - 1 AS rk FROM r),
  cnt AS (SELECT count(*) AS n FROM r),
  tg AS (SELECT k, (k / 255.0) * (n - 1) AS pos, CAST(floor((k / 255.0) * (n - 1)) AS BIGINT) AS lo,
                CAST(ceil((k / 255.0) * (n - 1)) AS BIGINT) AS hi FROM cnt, range(0, 256) t(k)),
  qv AS (SELECT CASE WHEN lo = hi THEN a.v ELSE (hi - pos) * a.v + (pos - lo) * b.v END AS p
         FROM tg JOIN srt a ON a.rk = tg.lo JOIN srt b ON b.rk = tg.hi),
  pts AS (SELECT p, lag(p) OVER (ORDER BY p) AS prv, lead(p) OVER (ORDER BY p) AS nxt FROM (SELECT DISTINCT p FROM qv)),
  dv AS (SELECT v, round(sum(CASE WHEN p > v THEN (p - greatest(coalesce(prv, v), v)) / (p - v)
                                  WHEN p < v THEN (least(coalesce(nxt, v), v) - p) / (v - p) ELSE 0.0 END), 6) AS d
         FROM (SELECT DISTINCT total_opex AS v FROM r), pts GROUP BY v),
  thr AS (SELECT quantile_cont(d, 0.1) AS t FROM r JOIN dv ON r.total_opex = dv.v),
  flagged AS (SELECT r.*, dv.d AS anomaly_depth, dv.d < (SELECT t FROM thr) AS anomaly
              FROM r JOIN dv ON r.total_opex = dv.v)"""

ORACLE.update({
    "anomaly_depth": with_ctes("SELECT * FROM flagged", extra=DEPTH),
    "anomaly_rate": with_ctes("""SELECT coalesce(avg(CAST(anomaly AS DOUBLE)) * 100, 0.0) AS anomaly_rate,
        CAST(coalesce(sum(CAST(anomaly AS BIGINT)), 0) AS BIGINT) AS anomalies, CAST(count(*) AS BIGINT) AS rows
        FROM flagged""", extra=DEPTH),
    "anomaly_rows": with_ctes("SELECT date, total_opex FROM flagged WHERE anomaly", extra=DEPTH),
})


# --- raw upload cleaning -----------------------------------------------------


def _num_text(expr: str, bad: int, pad: int) -> str:
    t = f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"
    return (f"CASE WHEN l_linenumber = {bad} THEN 'n/a' WHEN l_linenumber = {pad} THEN ' ' || {t} || ' ' "
            f"ELSE {t} END")


_D = "CAST(l_shipdate AS DATE)"
RAW = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 'not a date'
       WHEN l_returnflag = 'A' THEN strftime({_D}, '%Y-%m-%d')
       WHEN l_returnflag = 'N' THEN strftime({_D}, '%m/%d/%Y')
       ELSE strftime({_D}, '%d %b %Y') END AS " Date ",
  CASE WHEN l_linenumber = 7 THEN 'NA' ELSE concat('F', lpad(CAST(l_suppkey % 7 AS VARCHAR), 2, '0')) END AS "Factory",
  CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('S_', l_returnflag) END AS "Shift",
  {_num_text("l_quantity", 1, 2)} AS "Energy Type 1",
  {_num_text("floor(l_quantity * (1 + 10 * l_tax))", 2, 3)} AS "Energy Type 2",
  {_num_text("floor(l_extendedprice * l_discount)", 3, 4)} AS "HR Cost",
  {_num_text("floor(l_extendedprice * 0.5)", 4, 5)} AS "Operation Cost",
  {_num_text("floor(l_extendedprice * l_tax)", 5, 6)} AS "Admin Cost",
  {_num_text("l_linenumber * 10", 6, 1)} AS "Other Cost",
  {_num_text("floor(l_extendedprice)", 7, 3)} AS "Revenue"
FROM lineitem"""

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TEXTS)


def _num(c: str) -> str:
    return (f"coalesce(CASE WHEN regexp_full_match(trim({c}), '{NUMBER_TEXT}') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END, 0.0)")


def _cat(c: str) -> str:
    return f"coalesce(CASE WHEN trim({c}) IN ({_TOKENS}) THEN NULL ELSE {c} END, 'unknown')"


_PARSED = """coalesce(try_strptime(trim(" Date "), '%Y-%m-%d'), try_strptime(trim(" Date "), '%m/%d/%Y'),
                      try_strptime(trim(" Date "), '%d %b %Y'))"""

RAW_NORMALIZED = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " Date " AS date, "Factory" AS factory,
  "Shift" AS shift, "Energy Type 1" AS energy_type_1, "Energy Type 2" AS energy_type_2, "HR Cost" AS hr_cost,
  "Operation Cost" AS operation_cost, "Admin Cost" AS admin_cost, "Other Cost" AS other_cost, "Revenue" AS revenue
FROM ({RAW})"""

RAW_CLEAN = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, factory, shift,
    energy_type_1, energy_type_2, hr_cost, operation_cost, admin_cost, other_cost, revenue,
    hr_cost + operation_cost + admin_cost + other_cost AS total_opex, energy_type_1 + energy_type_2 AS total_energy
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PARSED} AS date,
          {_cat('"Factory"')} AS factory, {_cat('"Shift"')} AS shift,
          {_num('"Energy Type 1"')} AS energy_type_1, {_num('"Energy Type 2"')} AS energy_type_2,
          {_num('"HR Cost"')} AS hr_cost, {_num('"Operation Cost"')} AS operation_cost,
          {_num('"Admin Cost"')} AS admin_cost, {_num('"Other Cost"')} AS other_cost, {_num('"Revenue"')} AS revenue
        FROM ({RAW}))
  WHERE date IS NOT NULL"""

ORACLE.update({
    "normalize_columns": RAW_NORMALIZED,
    "na_tokens": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN trim(factory) IN ({_TOKENS}) THEN NULL ELSE factory END AS factory,
        CASE WHEN trim(shift) IN ({_TOKENS}) THEN NULL ELSE shift END AS shift FROM ({RAW_NORMALIZED})""",
    "coerce_dates": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PARSED} AS date FROM ({RAW})""",
    "drop_bad_dates": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date FROM (
        SELECT *, {_PARSED} AS date FROM ({RAW})) WHERE date IS NOT NULL""",
    "coerce_numeric": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {_num('"Energy Type 1"')} AS energy_type_1, {_num('"Energy Type 2"')} AS energy_type_2,
        {_num('"HR Cost"')} AS hr_cost, {_num('"Operation Cost"')} AS operation_cost,
        {_num('"Admin Cost"')} AS admin_cost, {_num('"Other Cost"')} AS other_cost, {_num('"Revenue"')} AS revenue
        FROM ({RAW})""",
    "fill_categoricals": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {_cat('"Factory"')} AS factory, {_cat('"Shift"')} AS shift FROM ({RAW})""",
    "derive_totals": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_opex, total_energy
        FROM ({RAW_CLEAN})""",
    "clean_raw": f"""SELECT *, CAST(dense_rank() OVER (ORDER BY shift) - 1 AS INTEGER) AS shift_code FROM ({RAW_CLEAN})""",
    "kpis_raw": _kpis(f"SELECT * EXCLUDE (total_opex, total_energy) FROM ({RAW_CLEAN})", True),
    "encode_shift": with_ctes("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, shift,
        CAST(dense_rank() OVER (ORDER BY shift) - 1 AS INTEGER) AS shift_code FROM r"""),
    "display_names": with_ctes("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date AS "Date",
        factory AS "Factory", shift AS "Shift", energy_type_1 AS "Energy_Type_1", energy_type_2 AS "Energy_Type_2",
        hr_cost AS "HR_Cost", operation_cost AS "Operation_Cost", admin_cost AS "Admin_Cost",
        other_cost AS "Other_Cost", revenue, total_opex AS "Total_OpEx", total_energy AS "Total_Energy" FROM r"""),
    "one_hot": with_ctes("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, factory, shift, "
                         + ", ".join([f"CAST(CASE WHEN factory = 'F0{i}' THEN 1 ELSE 0 END AS INTEGER) AS factory_F0{i}"
                                      for i in range(7)]
                                     + [f"CAST(CASE WHEN shift = '{s}' THEN 1 ELSE 0 END AS INTEGER) AS shift_{s}"
                                        for s in ["S_A", "S_N", "S_R"]]) + " FROM r"),
    "sample_rows": with_ctes("SELECT * FROM r ORDER BY date, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10"),
    "insight_context": f"WITH kb AS ({_kpis(REC, True)})\n" + """SELECT line_no, label, text FROM (
        SELECT 1 AS line_no, 'Total Operational Expenditure' AS label, 'Total Operational Expenditure: ' || format('{:,.2f}', total_opex) AS text FROM kb
        UNION ALL SELECT 2, 'Total Energy Consumption', 'Total Energy Consumption: ' || format('{:,.2f}', total_energy) FROM kb
        UNION ALL SELECT 3, 'HR Cost %', 'HR Cost %: ' || printf('%.1f', hr_percent) || '%' FROM kb
        UNION ALL SELECT 4, 'Admin Overhead %', 'Admin Overhead %: ' || printf('%.1f', admin_percent) || '%' FROM kb
        UNION ALL SELECT 5, 'Most expensive factory', 'Most expensive factory: ' || top_factory FROM kb
        UNION ALL SELECT 6, 'Least expensive factory', 'Least expensive factory: ' || bottom_factory FROM kb
        UNION ALL SELECT 7, 'Most expensive shift', 'Most expensive shift: ' || most_expensive_shift FROM kb
        UNION ALL SELECT 8, 'Energy Efficiency (Revenue/Energy)', 'Energy Efficiency (Revenue/Energy): ' || printf('%.2f', energy_efficiency) FROM kb)""",
})


ORACLE.update({
    "load_csv": ORACLE["kpis_raw"],
    "load_table": ORACLE["kpis_raw"],
    "load_workbooks": ORACLE["kpis_raw"],
    "save_dataset": with_ctes("SELECT * FROM r"),
    "save_dataset_range": _records_where("date BETWEEN DATE '1996-01-17' AND DATE '1996-12-05'"),
    "session_store": ORACLE["forecast"],
    "export_results": ORACLE["kpis_labelled"],
    "forecast_reload": ORACLE["forecast"],
    "stream_daily_kpis": """SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, factory,
        sum(total_opex) AS total_opex, CAST(count(*) AS BIGINT) AS events
      FROM (SELECT date_trunc('day', ts) AS window_start, event_type AS factory,
                   CAST(floor(value * 100.0) AS DOUBLE) AS total_opex FROM events)
      GROUP BY window_start, factory""",
})


SPARSE_SRC = f"SELECT * FROM ({REC}) WHERE factory = 'F03' AND shift = 'S_A'"
SHORT_SRC = f"SELECT * FROM ({REC}) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-09'"

ORACLE.update({
    "forecast_90": _forecast(90),
    "forecast_too_short": _forecast(30, SHORT_SRC),
    "daily_grid_filtered": with_ctes("SELECT date, total_opex, total_energy FROM grid", src=SPARSE_SRC, extra=GRID),
    "forecast_filtered": _forecast(30, SPARSE_SRC),
    "scale_energy": with_ctes("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        energy_type_1 * (1 + 10.0 / 100) AS energy_type_1, energy_type_2 * (1 + 10.0 / 100) AS energy_type_2 FROM r"""),
})


_SAMPLE_COLS = [("l_orderkey", "x"), ("l_linenumber", "x"), ("l_partkey", "x"), ("l_suppkey", "x"),
                ("date", "x"), ("factory", "x"), ("shift", "x"), ("energy_type_1", "d"),
                ("energy_type_2", "d"), ("hr_cost", "d"), ("operation_cost", "d"), ("admin_cost", "d"),
                ("other_cost", "d"), ("revenue", "d"), ("total_opex", "d"), ("total_energy", "d")]


def _chat_context() -> str:
    def cell(c: str, kind: str) -> str:
        v = f"printf('%.6f', {c})" if kind == "d" else f"CAST({c} AS VARCHAR)"
        return f"'{c}=' || coalesce({v}, '')"
    row_text = " || ' | ' || ".join(cell(c, k) for c, k in _SAMPLE_COLS)
    order = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return f"""WITH kl AS ({_kpis_long()}),
      ds AS ({_describe()}),
      sm AS ({with_ctes(f"SELECT * FROM r ORDER BY {order} LIMIT 10")})
    SELECT 'kpis' AS section, position AS line_no, kpi AS name,
           coalesce(printf('%.6f', value), text) AS text FROM kl
    UNION ALL
    SELECT 'sample', CAST(row_number() OVER (ORDER BY {order}) AS INTEGER), 'row', {row_text} FROM sm
    UNION ALL
    SELECT 'statistics', 0, "column" || '.' || statistic, printf('%.6f', value) FROM ds"""


ORACLE["chat_context"] = _chat_context()



def _ols(train: str, feats: list[str], label: str) -> str:
    """CTEs fitting OLS of ``label`` on ``feats`` over the table ``train`` by
    sequential orthogonalisation; defines om (means), ob (residualisation
    coefficients) and og (coefficients on the orthogonal parts)."""
    k = len(feats)
    means = ", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(feats)) + f", avg({label}) AS my"
    centred = ", ".join(f"{f} - m{i} AS c{i}" for i, f in enumerate(feats)) + f", {label} - my AS cy"
    ctes = [f", om AS (SELECT {means} FROM {train})",
            f"oc AS (SELECT {centred} FROM {train}, om)"]
    prev = "oc"
    for j in range(k):
        z = f"c{j}" + "".join(f" - b{j}_{i} * z{i}" for i in range(j))
        if j:
            coef = ", ".join(f"sum(c{j} * z{i}) / sum(z{i} * z{i}) AS b{j}_{i}" for i in range(j))
            ctes.append(f"ob{j} AS (SELECT {coef} FROM {prev})")
            ctes.append(f"oz{j} AS (SELECT {prev}.*, {z} AS z{j} FROM {prev}, ob{j})")
        else:
            ctes.append(f"oz0 AS (SELECT oc.*, c0 AS z0 FROM oc)")
        prev = f"oz{j}"
    gam = ", ".join(f"sum(cy * z{i}) / sum(z{i} * z{i}) AS g{i}" for i in range(k))
    ctes.append(f"og AS (SELECT {gam} FROM {prev})")
    return ",\n  ".join(ctes)


def _ols_predict(table: str, feats: list[str], label: str) -> str:
    """Predictions for ``table`` (needs om, ob1.., og)."""
    k = len(feats)
    cs = ", ".join(f"{f} - m{i} AS c{i}" for i, f in enumerate(feats))
    sql = f"SELECT t.*, {cs} FROM {table} t, om"
    for j in range(k):
        z = f"c{j}" + "".join(f" - b{j}_{i} * z{i}" for i in range(j))
        src = f"({sql}) s" + (f", ob{j}" if j else "")
        sql = f"SELECT s.*, {z} AS z{j} FROM {src}"
    pred = "my" + "".join(f" + g{i} * z{i}" for i in range(k))
    return f"SELECT s.*, {pred} AS prediction FROM ({sql}) s, om, og"


# One row key in five is held out, by the key's MD5.
FOLD = "(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8))::BIGINT % 5)"


def _fit_score_regression(feats: list[str], label: str) -> str:
    fold = FOLD
    body = f"""SELECT round(1 - sum(({label} - prediction) ^ 2) / sum(({label} - ybar) ^ 2), 6) AS r2,
        round(avg(abs({label} - prediction)), 4) AS mae,
        round(sqrt(avg(({label} - prediction) ^ 2)), 4) AS rmse
      FROM tp, (SELECT avg({label}) AS ybar FROM tp)"""
    extra = (f", trn AS (SELECT * FROM r WHERE {fold} <> 4), tst AS (SELECT * FROM r WHERE {fold} = 4)"
             + _ols("trn", feats, label) + f", tp AS ({_ols_predict('tst', feats, label)})")
    return with_ctes(body, extra=extra)


ORACLE["fit_score_regression"] = _fit_score_regression(["energy_type_1", "energy_type_2", "total_opex"], "revenue")


ORACLE["insight_context_anomalies"] = ORACLE["insight_context"] + f"""
UNION ALL
SELECT 9 AS line_no, 'Anomalies' AS label, 'Anomalies detected: ' || CAST(n AS VARCHAR) || ' unusual cost spikes.' AS text
FROM ({with_ctes("SELECT count(*) AS n FROM flagged WHERE anomaly", extra=DEPTH)}) WHERE n > 0"""


# --- wider inputs, missing values, dashboards, files of other programs -------

GAPS = """, full_r AS (SELECT * FROM r0), r AS (SELECT * FROM r0 WHERE l_linenumber <> 7)"""


def _with_gaps(body: str) -> str:
    return f"WITH r0 AS ({cleaned()}){GAPS}{DEPTH}\n{body}"


ORACLE.update({
    "describe_extra": _describe(EXTRA_MEASURES, EXTRA_SRC),
    # The records hold the extra columns after the derived totals.
    "correlation_extra": _correlation(EXTRA_MEASURES, EXTRA_SRC),
    "factory_shift_cells": with_ctes("SELECT factory, shift, coalesce(sum(total_opex), 0) AS total_opex FROM r GROUP BY factory, shift"),
    "filter_energy_max": _records_where("energy_type_2 <= 30.0"),
    "canonical_names": with_ctes("SELECT * FROM r"),
    "null_tokens": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN trim("Factory") IN ({_TOKENS}) THEN NULL ELSE "Factory" END AS factory,
        CASE WHEN trim("Shift") IN ({_TOKENS}) THEN NULL ELSE "Shift" END AS shift,
        CASE WHEN trim("HR Cost") IN ({_TOKENS}) THEN NULL ELSE "HR Cost" END AS hr_cost,
        CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE 'ok' END AS remark FROM ({RAW})""",
    "usable_date": ORACLE["drop_bad_dates"],
    "dropped_rows": """SELECT count(*) AS rows, CAST(count(*) FILTER (l_linenumber = 7 AND l_linestatus = 'O') AS BIGINT) AS dropped
        FROM lineitem""",
    "forecast_total_short": "SELECT CAST(0 AS DOUBLE) AS total_forecast, CAST(0 AS DOUBLE) AS avg_daily_forecast, CAST(0 AS BIGINT) AS days WHERE false",
    "future_kpis_short": """SELECT CAST(0 AS DOUBLE) AS next_month_total_cost, CAST(0 AS DOUBLE) AS estimated_energy_demand,
        CAST(0 AS INTEGER) AS budget_overrun_prob, '' AS most_expensive_factory, '' AS most_expensive_shift,
        CAST(0 AS DOUBLE) AS avg_daily_cost_next_month WHERE false""",
    "anomaly_missing": _with_gaps("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_opex, anomaly_depth, anomaly FROM flagged
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NULL, NULL, false FROM full_r WHERE l_linenumber = 7"""),
    "anomaly_rate_missing": _with_gaps("""SELECT a * 100.0 / n AS anomaly_rate, CAST(a AS BIGINT) AS anomalies, CAST(n AS BIGINT) AS rows
        FROM (SELECT count(*) AS a FROM flagged WHERE anomaly), (SELECT count(*) AS n FROM full_r)"""),
    "anomaly_forest_share": "SELECT count(*) AS rows, count(*) AS scored, true AS within_share, true AS scores_ok FROM lineitem",
    "one_hot_long": with_ctes("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'factory_' || factory AS feature FROM r
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'shift_' || shift FROM r"""),
    "driver_split": f"SELECT {FOLD} = 4 AS is_test, count(*) AS rows FROM lineitem GROUP BY 1",
    "driver_features": with_ctes("""SELECT unnest(['energy_type_1', 'energy_type_2', 'hr_cost', 'admin_cost', 'other_cost']) AS feature
        UNION ALL SELECT DISTINCT 'factory_' || factory FROM r UNION ALL SELECT DISTINCT 'shift_' || shift FROM r"""),
    "driver_importance_total": "SELECT CAST(1 AS DOUBLE) AS total, true AS none_negative",
})


def _section(name: str, sql: str, item: str, values: list[str], texts: list[str] = ()) -> list[str]:
    """Long rows of one section: numbers, then names."""
    return [f"SELECT '{name}' AS section, {item} AS item, '{v}' AS measure, CAST({v} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM ({sql})"
            for v in values] + [f"SELECT '{name}', {item}, '{t}', NULL, {t} FROM ({sql})" for t in texts]


VIEW = f"SELECT * FROM ({REC}) WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND factory = 'F02'"


def _charts(src: str, trend: str) -> list[str]:
    return _section("kpis", _kpis_long(src), "kpi", ["value"], ["text"]) + _section(
        trend, with_ctes("SELECT date AS period, coalesce(sum(total_opex), 0) AS value FROM r GROUP BY 1", src), "CAST(period AS VARCHAR)", ["value"])


def _filtered_dashboard(view: str = VIEW) -> str:
    composition = " UNION ALL ".join(f"SELECT factory, '{c}' AS component, coalesce(sum({c}), 0) AS cost FROM r GROUP BY factory"
                                     for c in ["hr_cost", "operation_cost", "admin_cost", "other_cost"])
    mix = """SELECT energy_type, total, total / (t1 + t2) * 100 AS share FROM (
        SELECT 'Energy Type 1' AS energy_type, t1 AS total, t1, t2 FROM s UNION ALL SELECT 'Energy Type 2', t2, t1, t2 FROM s) WHERE t1 + t2 <> 0"""
    parts = _charts(view, "line_chart")
    parts += _section("stacked_bar", with_ctes(composition, view), "factory || '|' || component", ["cost"])
    parts += _section("heatmap", with_ctes("SELECT factory, shift, coalesce(sum(total_opex), 0) AS total_opex FROM r GROUP BY factory, shift", view),
                      "factory || '|' || shift", ["total_opex"])
    parts += _section("pie_energy", with_ctes(mix, view, ", s AS (SELECT coalesce(sum(energy_type_1), 0) AS t1, coalesce(sum(energy_type_2), 0) AS t2 FROM r)"),
                      "energy_type", ["total", "share"])
    return "\nUNION ALL\n".join(parts)


def _upload_analysis() -> str:
    parts = _charts(REC, "trend")
    parts += _section("forecast", ORACLE["forecast"], "day_index || '|' || CAST(date AS VARCHAR)", ["prediction"])
    parts += _section("forecast_metrics", ORACLE["forecast_metrics"], "''", ["r2", "mae", "rmse"])
    parts += _section("future_kpis", ORACLE["future_kpis"], "''", ["next_month_total_cost", "estimated_energy_demand", "budget_overrun_prob", "avg_daily_cost_next_month"],
                      ["most_expensive_factory", "most_expensive_shift"])
    parts += _section("anomaly_rate", ORACLE["anomaly_rate"], "''", ["anomaly_rate", "anomalies", "rows"])
    parts += _section("anomalies", ORACLE["anomaly_rows"], "CAST(date AS VARCHAR)", ["total_opex"])
    return "\nUNION ALL\n".join(parts)


ORACLE.update({
    "filtered_dashboard": _filtered_dashboard(),
    "upload_analysis": _upload_analysis(),
    "load_csv_quoted": f"""WITH k AS ({_kpis(REC, True)}),
      t AS (SELECT 'say "' || factory || '",' || chr(10) || ' then ' || CAST(l_linenumber AS VARCHAR) AS remark FROM ({REC}))
    SELECT total_opex, total_energy, total_revenue, top_factory, (SELECT count(*) FROM t) AS rows,
      (SELECT count(DISTINCT remark) FROM t) AS remarks, (SELECT CAST(sum(length(remark)) AS BIGINT) FROM t) AS remark_chars FROM k""",
    "load_workbook_dates": ORACLE["trend_monthly"],
    "load_workbooks_two_headers": f"""SELECT factory, count(*) AS rows,
        CAST(sum(hr_cost + operation_cost + CASE WHEN factory = 'F00' THEN 0 ELSE admin_cost + other_cost END) AS DOUBLE) AS total_opex,
        CAST(sum(CASE WHEN factory = 'F00' THEN revenue ELSE 0 END) AS DOUBLE) AS revenue, count(CASE WHEN factory = 'F00' THEN 1 END) AS notes,
        CAST(sum(CASE WHEN factory = 'F00' THEN 1 ELSE 0 END) AS BIGINT) AS no_shift FROM ({REC}) GROUP BY factory""",
})


# --- tree models ------------------------------------------------------------------

_KEY_LIST = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_DRIVERS = ["energy_type_1", "energy_type_2", "hr_cost", "admin_cost", "other_cost"]
_LEVELS = [("factory_" + f"F0{i}", f"factory = 'F0{i}'") for i in range(7)] + [(f"shift_S_{c}", f"shift = 'S_{c}'") for c in "ANR"]
ORACLE.update({
    "driver_tree_splits": tree_splits(f"SELECT * FROM ({cleaned()}) WHERE {FOLD} <> 4", [(c, c) for c in _DRIVERS] + [(n, f"({e})::INTEGER") for n, e in _LEVELS], "total_opex", 2),
    "fit_score_classifier": gini_accuracy(f"SELECT *, {FOLD} = 4 AS is_test FROM ({cleaned()})", _DRIVERS, "shift", ["S_A", "S_N", "S_R"], 50, 5, 32),
    "anomaly_forest": isolation_scores(cleaned(), "total_opex", _KEY_LIST, 100, 256, 0.1),
})


# --- stored partial results, streams -------------------------------------------------

_EVENTS = """SELECT concat('D', user_id % 4) AS dataset, event_type AS factory, concat('S', user_id % 3) AS shift, floor(value * 100) AS total_opex,
    CAST(event_id % 50 AS DOUBLE) AS total_energy, floor(value * 130) AS revenue, floor(value * 30) AS hr_cost, floor(value * 10) AS admin_cost FROM events"""


def _stream_kpis() -> str:
    return f"""WITH r AS ({_EVENTS}),
      f AS (SELECT dataset, factory, sum(total_opex) AS c FROM r GROUP BY 1, 2), h AS (SELECT dataset, shift, avg(total_opex) AS c FROM r GROUP BY 1, 2),
      ends AS (SELECT dataset, first(factory ORDER BY c DESC, factory) AS top_factory, last(factory ORDER BY c DESC, factory) AS bottom_factory FROM f GROUP BY 1),
      shifts AS (SELECT dataset, first(shift ORDER BY c DESC, shift) AS most_expensive_shift, last(shift ORDER BY c DESC, shift) AS cheapest_shift FROM h GROUP BY 1),
      s AS (SELECT dataset, sum(total_opex) AS o, sum(total_energy) AS e, sum(revenue) AS v, sum(hr_cost) AS hr, sum(admin_cost) AS ad, count(*) AS n FROM r GROUP BY 1)
    SELECT dataset, o AS total_opex, e AS total_energy, v AS total_revenue, v - o AS profit, CASE WHEN v = 0 THEN 0.0 ELSE (v - o) / v * 100 END AS profit_margin,
      CASE WHEN e = 0 THEN 0.0 ELSE v / e END AS energy_efficiency, 'revenue' AS efficiency_basis, top_factory, bottom_factory, most_expensive_shift, cheapest_shift,
      CASE WHEN o = 0 THEN 0.0 ELSE hr / o * 100 END AS hr_percent, CASE WHEN o = 0 THEN 0.0 ELSE ad / o * 100 END AS admin_percent, n AS events, CAST(0 AS BIGINT) AS late_events
    FROM s JOIN ends USING (dataset) JOIN shifts USING (dataset)"""


ORACLE.update({
    "filtered_dashboard_rollup": ORACLE["filtered_dashboard"],
    "filtered_dashboard_energy": _filtered_dashboard(VIEW + " AND energy_type_1 >= 10.0 AND energy_type_2 <= 40.0"),
    "forecast_incremental": ORACLE["forecast"],
    "describe_range": _describe(src=f"SELECT * FROM ({REC}) WHERE date BETWEEN DATE '1996-01-17' AND DATE '1996-12-05'"),
    "stream_kpis": _stream_kpis(),
})

ORACLE.update({
    "kpis_missing_columns": f"""SELECT total_opex, total_energy, energy_efficiency, efficiency_basis, top_factory, bottom_factory, hr_percent
        FROM ({_kpis(REC_NO_REVENUE, False)})""",
    "case_blind": with_ctes("""SELECT factory, total_opex, CAST(row_number() OVER (ORDER BY total_opex DESC, factory) AS INTEGER) AS rank
        FROM (SELECT factory, sum(total_opex) AS total_opex FROM r WHERE factory <> 'F00' AND shift = 'S_N' GROUP BY factory)"""),
})
