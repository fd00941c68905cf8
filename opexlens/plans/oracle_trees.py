"""DuckDB SQL that replays the tree models: first splits of a grown-out
regression tree, the Gini forest of the classifier, the isolation forest.

Written from the models' definitions (hash draws, split rule, ties), level by
level as chained CTEs; it shares no code with ``operators.trees``.
"""

from __future__ import annotations

import math

ROW32 = "('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8))::UBIGINT"


def mixed(value: str, out: str) -> str:
    """Select-list items that hash ``value`` (32 bits, UBIGINT) into ``out``."""
    return (f"({value})::UBIGINT AS {out}_a, xor({out}_a, {out}_a >> 16) * 2146121005 % 4294967296 AS {out}_b, "
            f"xor({out}_b, {out}_b >> 15) * 2221713035 % 4294967296 AS {out}_c, xor({out}_c, {out}_c >> 16) AS {out}")


def drawn(out: str, *counters: str) -> str:
    """Select-list items: the draw of the counters as column ``out``."""
    items, before = [], None
    for i, c in enumerate(counters):
        name = out if i + 1 == len(counters) else f"{out}{i}"
        items.append(mixed(f"({c})::UBIGINT" if before is None else f"xor({before}, ({c})::UBIGINT)", name))
        before = name
    return ", ".join(items)


# --- regression tree: first splits by exact variance reduction ------------------

def tree_splits(records: str, features: list[tuple[str, str]], label: str, depth: int) -> str:
    """node, feature, threshold, rows.  ``features``: (name, SQL value)."""
    values = ", ".join(f"({e})::DOUBLE AS v{i}" for i, (_, e) in enumerate(features))
    ctes = [f"learn AS ({records})", f"at0 AS (SELECT 1::BIGINT AS node, {label}::DOUBLE AS y, {values} FROM learn)"]
    for level in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {i} AS f, v{i} AS v, count(*) AS n, sum(y) AS s FROM at{level} GROUP BY node, v{i}" for i in range(len(features)))
        ctes += [
            f"hist{level} AS ({long})",
            f"""cum{level} AS (SELECT node, f, v, lead(v) OVER w AS following, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
                sum(n) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS s FROM hist{level} WINDOW w AS (PARTITION BY node, f ORDER BY v))""",
            f"""best{level} AS (SELECT * FROM (SELECT node, f, v, (v + following) / 2 AS threshold, n, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS score, s * s / n AS parent
                FROM cum{level} WHERE following IS NOT NULL) WHERE score > parent QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, f, v) = 1)""",
            f"""at{level + 1} AS (SELECT 2 * node + (CASE f {' '.join(f'WHEN {i} THEN v{i}' for i in range(len(features)))} END > b.v)::BIGINT AS node, y,
                {', '.join(f'v{i}' for i in range(len(features)))} FROM at{level} JOIN best{level} b USING (node))"""]
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(features))
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(
        f"SELECT node, CASE f {names} END AS feature, threshold, n::BIGINT AS rows FROM best{level}" for level in range(depth))


# --- Gini forest -----------------------------------------------------------------

def gini_accuracy(records: str, features: list[str], label: str, classes: list[str], trees: int, depth: int, bins: int) -> str:
    nf, nc = len(features), len(classes)
    offered = math.ceil(math.sqrt(nf))
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(math.floor(total * 2.0**32))
    times = " + ".join(f"(u >= {x})::INTEGER" for x in steps)
    probs = "[" + ", ".join(f"{k / bins!r}" for k in range(1, bins)) + "]"
    y = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes))
    keep = ", ".join(f"c{i}" for i in range(nf))
    sums = ", ".join(f"sum(w) FILTER (y = {k}) AS p{k}" for k in range(nc))
    ctes = [
        f"src AS ({records})",
        "q AS (SELECT " + ", ".join(f"quantile_cont({c}, {probs}) AS q{i}" for i, c in enumerate(features)) + " FROM src)",
        *[f"edge{i} AS (SELECT DISTINCT unnest(q{i}) AS e FROM q)" for i in range(nf)],
        *[f"val{i} AS (SELECT v, (SELECT count(*) FROM edge{i} WHERE e < v) AS code FROM (SELECT DISTINCT {c} AS v FROM src))" for i, c in enumerate(features)],
        "enc AS (SELECT row32, is_test, y, " + ", ".join(f"val{i}.code AS c{i}" for i in range(nf)) + ", row_number() OVER () AS id FROM "
        + f"(SELECT *, CASE {label} {y} END AS y, {ROW32} AS row32 FROM src) s " + " ".join(f"JOIN val{i} ON val{i}.v = s.{c}" for i, c in enumerate(features)) + ")",
        f"drawn AS (SELECT tree, id, is_test, y, {keep}, {drawn('u', 'row32', 'tree')} FROM enc, (SELECT unnest(generate_series(0, {trees - 1})) AS tree))",
        f"at0 AS (SELECT tree, id, is_test, y, {keep}, w, 1 AS heap FROM (SELECT *, {times} AS w FROM drawn) WHERE is_test OR w > 0)",
        f"""allowed AS (SELECT tree, heap, f FROM (SELECT tree, heap, f, {drawn('u', 'tree', 'heap', '1000 + f')} FROM
            (SELECT unnest(generate_series(0, {trees - 1})) AS tree), (SELECT unnest(generate_series(1, {2 ** depth - 1})) AS heap), (SELECT unnest(generate_series(0, {nf - 1})) AS f))
            QUALIFY row_number() OVER (PARTITION BY tree, heap ORDER BY u, f) <= {offered})"""]
    square = "round(({}) / {}, 6)"
    for level in range(depth):
        parts = " UNION ALL ".join(f"SELECT tree, heap, {i} AS f, c{i} AS code, sum(w) AS w, {sums} FROM at{level} WHERE NOT is_test AND heap >= {2 ** level} GROUP BY tree, heap, c{i}" for i in range(nf))
        run = ", ".join(f"sum(coalesce(p{k}, 0)) OVER o AS l{k}, sum(coalesce(p{k}, 0)) OVER g AS t{k}" for k in range(nc))
        left = square.format(" + ".join(f"l{k} * l{k}" for k in range(nc)), "wl")
        right = square.format(" + ".join(f"(t{k} - l{k}) * (t{k} - l{k})" for k in range(nc)), "(n - wl)")
        parent = square.format(" + ".join(f"t{k} * t{k}" for k in range(nc)), "n")
        ctes += [
            f"hist{level} AS ({parts})",
            f"""cum{level} AS (SELECT tree, heap, f, code, lead(code) OVER o AS following, sum(w) OVER o AS wl, sum(w) OVER g AS n, {run} FROM hist{level} SEMI JOIN allowed USING (tree, heap, f)
                WINDOW o AS (PARTITION BY tree, heap, f ORDER BY code), g AS (PARTITION BY tree, heap, f))""",
            f"""best{level} AS (SELECT tree, heap, f, code FROM (SELECT tree, heap, f, code, {left} + {right} AS score, {parent} AS parent FROM cum{level} WHERE following IS NOT NULL)
                WHERE score > parent QUALIFY row_number() OVER (PARTITION BY tree, heap ORDER BY score DESC, f, code) = 1)""",
            f"""at{level + 1} AS (SELECT a.tree, id, is_test, y, {keep}, w, CASE WHEN b.f IS NULL THEN a.heap
                ELSE 2 * a.heap + (CASE b.f {' '.join(f'WHEN {i} THEN c{i}' for i in range(nf))} END > b.code)::INTEGER END AS heap
                FROM at{level} a LEFT JOIN best{level} b ON a.tree = b.tree AND a.heap = b.heap)"""]
    share = ", ".join(f"coalesce(sum(w) FILTER (y = {k}), 0) / sum(w) AS p{k}" for k in range(nc))
    ctes += [f"leaf AS (SELECT tree, heap, {share} FROM at{depth} WHERE NOT is_test GROUP BY tree, heap)",
             "vote AS (SELECT id, min(y) AS y, " + ", ".join(f"round(avg(p{k}), 9) AS p{k}" for k in range(nc)) + f" FROM at{depth} JOIN leaf USING (tree, heap) WHERE is_test GROUP BY id)"]
    most = "greatest(" + ", ".join(f"p{k}" for k in range(nc)) + ")"
    best = " ".join(f"WHEN p{k} = {most} THEN {k}" for k in range(nc))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT round(avg((CASE {best} END = y)::INTEGER), 6) AS accuracy FROM vote"


# --- isolation forest --------------------------------------------------------------

def isolation_scores(records: str, value: str, keys: list[str], trees: int, psi: int, share: float) -> str:
    """keys, value, anomaly_score, anomaly; for tables of at least ``psi`` rows."""
    levels, key = math.ceil(math.log2(psi)), ", ".join(keys)
    path = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1)::DOUBLE / n WHEN n = 2 THEN 1.0 ELSE 0.0 END"
    ctes = [
        f"src AS ({records})",
        f"d AS (SELECT tree, row32, x, {drawn('u', 'row32', 'tree')} FROM (SELECT {ROW32} AS row32, {value}::DOUBLE AS x FROM src), (SELECT unnest(generate_series(0, {trees - 1})) AS tree))",
        f"s0 AS (SELECT tree, 1::BIGINT AS heap, x FROM d QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, row32, x) <= {psi})",
        f"v0 AS (SELECT tree, 1::BIGINT AS heap, x FROM (SELECT DISTINCT x FROM d), (SELECT unnest(generate_series(0, {trees - 1})) AS tree))"]
    for level in range(levels + 1):
        splits = f"n > 1 AND lo < hi AND {level} < {levels}"
        ctes += [f"""n{level} AS (SELECT tree, heap, n, lo, hi, {splits} AS inner_node, {drawn('u', 'tree', 'heap', '2')}, lo + ((u + 0.5) / 4294967296.0::DOUBLE) * (hi - lo) AS t
            FROM (SELECT tree, heap, count(*) AS n, min(x) AS lo, max(x) AS hi FROM s{level} GROUP BY tree, heap))"""]
        if level < levels:
            ctes += [f"{a}{level + 1} AS (SELECT a.tree, 2 * a.heap + (x >= t)::BIGINT AS heap, x FROM {a}{level} a JOIN n{level} b ON a.tree = b.tree AND a.heap = b.heap WHERE inner_node)"
                     for a in ("s", "v")]
    ends = " UNION ALL ".join(f"SELECT x, {level} + {path} AS depth FROM v{level} a JOIN n{level} b ON a.tree = b.tree AND a.heap = b.heap WHERE NOT inner_node" for level in range(levels + 1))
    norm = 2 * (math.log(psi - 1) + 0.5772156649015329) - 2 * (psi - 1) / psi
    ctes += [f"score AS (SELECT x, round(-pow(2.0::DOUBLE, -round(sum(depth) / {trees}, 9) / {norm!r}), 9) AS anomaly_score FROM ({ends}) GROUP BY x)",
             f"scored AS (SELECT {key}, {value}, anomaly_score FROM src JOIN score ON score.x = src.{value})"]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {key}, {value}, anomaly_score, anomaly_score < (SELECT quantile_cont(anomaly_score, {share}) FROM scored) AS anomaly FROM scored"
