"""Line dedup by distinct-site spread.

A line is boilerplate when it stands on at least ``min_sites`` different
sites.  Each line hash carries a HyperLogLog sketch of its sites, merged by
aggregation; lines whose estimate lies near the threshold are counted again
exactly.  Boilerplate lines go everywhere but in the document with the
smallest id, so no text leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import SPACES, fresh, stage, table

MIN_SITES, LG_K = 10, 12


def wide_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first_id) of the lines on at least ``min_sites`` sites.
    ``lines``: h1, h2, site, doc_id; read twice, so best a written table.

    The sketch's relative error is 1.04 / sqrt(2^lg_k); estimates within five
    of those (one site at least) of the threshold are settled by an exact
    count of distinct sites."""
    near = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = stage(lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
                   .where(F.col("n") >= min_sites)
                   .select("h1", "h2", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
                   .where(F.col("sites") >= min_sites - near), "line-spread")
    unsure = spread.where(F.col("sites") <= min_sites + near)
    exact = (lines.join(unsure.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2", "site").count()
             .groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites))
    return spread.where(F.col("sites") > min_sites + near).select("h1", "h2", "first_id") \
        .union(unsure.select("h1", "h2", "first_id").join(exact.select("h1", "h2"), ["h1", "h2"]))


def remove_wide_lines(df: DataFrame, site: str = "source", id_col: str = "doc_id", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with boilerplate lines cut from ``text``, plus n_lines (lines
    with a word) and n_removed.  Lines are split at line feeds and compared
    without outer white space; every line with a word is judged by its spread.

    Null sites count as no site, null texts stay null.  The document with a
    line's smallest id keeps it (all rows of that id; without any id, every
    document).  Repeated rows get equal results, an empty table none; texts may
    be of any length (a row a line).  Columns of the new names are replaced."""
    df = df.drop("n_lines", "n_removed")
    key, drop, at = fresh(df, "__key", "__drop", "__id")
    value = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn(key, F.xxhash64(value)).withColumn(at, F.col(id_col))
    trimmed = F.btrim(F.col("line"), F.lit(SPACES))
    # The outer form: for the plain one Spark adds a filter that splits every text once more.
    lines = stage(keyed.select(F.col(at).alias("doc_id"), F.col(key).alias("k"), F.col(site).cast("string").alias("site"),
                               F.posexplode_outer(F.split(value, "\n", -1)).alias("pos", "line"))
                  .select("doc_id", "k", "site", "pos", trimmed.alias("line")).where("line != ''")
                  .select("doc_id", "k", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    wide = wide_lines(lines.select("h1", "h2", "site", "doc_id"), min_sites)
    gone = stage(lines.join(wide, ["h1", "h2"]).where(F.col("doc_id").isNull() & F.col("first_id").isNotNull() | (F.col("doc_id") > F.col("first_id")))
                 .groupBy("doc_id", "k").agg(F.collect_set("pos").alias("pos")), "line-gone")
    gone = gone.select(F.col("doc_id").alias("__g"), F.col("k").alias("__k"), F.col("pos").alias(drop))
    # Both sides by key at every size: one plan, and no side has a proven bound.
    joined = keyed.join(gone.hint("merge"), (F.col(key) == F.col("__k")) & F.col(at).eqNullSafe(F.col("__g")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    n_lines = F.size(F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return joined.select(
        *[F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns],
        n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"))


def op8_lines(spark, sf_dir: str) -> DataFrame:
    out = remove_wide_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS a, text FROM documents),
ln AS (SELECT id, doc_id, source, unnest(generate_series(1, len(a))) AS pos, unnest(a) AS raw FROM d),
full_line AS (SELECT *, trim(raw, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n FROM ln),
wide AS (SELECT line, min(doc_id) AS first_id FROM full_line WHERE n > 0 GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT f.*, first_id IS NOT NULL AND (doc_id IS NULL OR doc_id > first_id) AS gone FROM full_line f LEFT JOIN wide ON wide.line = f.line),
out AS (SELECT id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS t
        FROM marked GROUP BY id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN out USING (id)
"""
