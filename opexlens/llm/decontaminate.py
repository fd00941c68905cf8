"""Benchmark decontamination over a distributed positional inverted index.

The index stores the postings (text key, term, position) of every corpus token
that a test item uses.  Each test window (``width`` consecutive words of an
item; a shorter item is one window) is looked up from its rarest term on: that
term's list gives the possible starts, then the lists of the next terms,
shifted by their offsets, are intersected with them until every term of the
window has stood its ground.  Windows with a term the corpus lacks go before
any list is read.  ``proximity`` finds the same windows with their terms in any
order inside a stretch of given length.

The index is partitioned by document (lists are written where the text is
read), so no list, however long, lies in one task; copies of a text share its
key.  Built-in functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opexlens.llm.common import fresh, stage, table

WIDTH = 10
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Lists that are intersected one after the other, rarest first; the rest of a
# window's terms are then met in one join.
SINGLE_ROUNDS = 3
# Candidate texts up to which their keys (16 bytes each) are broadcast to thin
# out the last join; beyond it the join takes all lists.
BROADCAST_TEXTS = 100_000


def lowered(value: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(value.rlike("[A-Z]"), F.translate(value, string.ascii_uppercase, string.ascii_lowercase)).otherwise(value)


def text_key(text: Column) -> list[Column]:
    """128 bits that equal texts share (null: as empty)."""
    value = F.coalesce(text, F.lit(""))
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def windows_of(items: DataFrame, item: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(windows: w1, w2, len, off, term; members: w1, w2, item).  Items of
    equal words are cut once; null and wordless texts have no window."""
    words = F.filter(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), BREAK, -1), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    joined = F.array_join("words", " ")
    rows = stage(rows.select("item", "words", F.xxhash64(joined).alias("c1"), F.xxhash64(F.lit(1), joined).alias("c2")), "test-items")
    texts = rows.groupBy("c1", "c2").agg(F.any_value("words").alias("words"))
    cut = texts.select("c1", "c2", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))).alias("at")) \
        .select("c1", "c2", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
    phrase = F.array_join("words", " ")
    cut = stage(cut.select("c1", "c2", "words", F.xxhash64(phrase).alias("w1"), F.xxhash64(F.lit(1), phrase).alias("w2")), "test-windows")
    windows = cut.groupBy("w1", "w2").agg(F.any_value("words").alias("words")) \
        .select("w1", "w2", F.size("words").alias("len"), F.posexplode("words").alias("off", "word")) \
        .select("w1", "w2", "len", "off", F.xxhash64("word").alias("term"))
    members = cut.select("w1", "w2", "c1", "c2").distinct().join(rows.select("c1", "c2", "item").distinct(), ["c1", "c2"]).select("w1", "w2", "item")
    return windows, members


def build_index(df: DataFrame, text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """The written index: h1, h2 (text key), term (hash), pos.  With a
    ``vocabulary`` (column term) only lists that it can ask for are stored.
    Null, empty and wordless texts have no postings; very long texts have one
    row a token like any other."""
    # The outer form: for the plain one Spark adds a filter that splits every text twice more.
    words = df.select(*text_key(F.col(text)), F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1)).alias("pos", "word")).where("word != ''")
    postings = words.select("h1", "h2", F.xxhash64(lowered(F.col("word"))).alias("term"), "pos")
    if vocabulary is not None:
        postings = postings.join(vocabulary.select("term"), "term", "left_semi")
    return stage(postings.select("h1", "h2", "term", "pos"), "postings")


def _plans(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with their terms rarest first:
    w1, w2, len, plan (array of n, term, off; at most ``width`` entries)."""
    counts = stage(index.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    return stage(windows.join(counts, "term").groupBy("w1", "w2", "len")
                 .agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("plan"))
                 .where(F.size("plan") == F.col("len")), "window-plans")


def phrases(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of the windows: w1, w2, len, h1, h2, start, once a
    text.  No window or no posting: no row."""
    plans = _plans(index, windows)
    spot = ["w1", "w2", "len", "h1", "h2", "start"]
    seeds = plans.select("w1", "w2", "len", "plan", F.col("plan")[0]["term"].alias("term"), F.col("plan")[0]["off"].alias("off"))
    # Only the seeds' lists move; a merge join holds the few windows of a term, not its list.
    lists = index.join(stage(seeds.select("term").distinct(), "seed-terms"), "term", "left_semi")
    found = lists.join(seeds, "term").select("w1", "w2", "len", "plan", "h1", "h2", (F.col("pos") - F.col("off")).alias("start")).dropDuplicates(spot)
    found = stage(found, "starts")
    for r in range(1, SINGLE_ROUNDS):
        step = F.get("plan", F.lit(r))
        terms = stage(plans.where(F.size("plan") > r).select(step["term"].alias("term")).distinct(), "next-terms")
        lists = index.join(terms, "term", "left_semi")
        probes = found.where(F.size("plan") > r).select("*", step["term"].alias("term"), (F.col("start") + step["off"]).alias("pos"))
        met = probes.join(lists, ["h1", "h2", "term", "pos"], "left_semi").select(found.columns)
        found = stage(met.union(found.where(F.size("plan") <= r)), "starts")
    texts = found.where(F.size("plan") > SINGLE_ROUNDS).select("h1", "h2").distinct()
    lists = index
    if texts.count() <= BROADCAST_TEXTS:
        lists = index.join(F.broadcast(texts), ["h1", "h2"], "left_semi")
    probes = found.select(*spot, F.explode(F.slice("plan", SINGLE_ROUNDS + 1, WIDTH_LIMIT)).alias("p")) \
        .select(*spot, F.col("p.term").alias("term"), (F.col("start") + F.col("p.off")).alias("pos"))
    met = probes.join(lists, ["h1", "h2", "term", "pos"], "left_semi").groupBy(*spot).agg(F.count("*").alias("n")) \
        .where(F.col("n") == F.col("len") - SINGLE_ROUNDS).select(spot)
    return stage(met.union(found.where(F.size("plan") <= SINGLE_ROUNDS).select(spot)), "phrases")


# slice() takes a length; windows are far shorter.
WIDTH_LIMIT = 1 << 20


def proximity(index: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """Stretches of at most ``span`` words that hold every different term of a
    window, in any order: w1, w2, h1, h2, start, end (last word), one row for
    each first word of such a stretch.  A text counts only where it has the
    window's rarest term within ``span``."""
    plans = _plans(index, windows)
    need = plans.select("w1", "w2", F.explode(F.array_distinct(F.transform("plan", lambda p: p["term"]))).alias("term"),
                        F.size(F.array_distinct(F.transform("plan", lambda p: p["term"]))).alias("terms"))
    rare = plans.select("w1", "w2", F.col("plan")[0]["term"].alias("term"))
    # Positions by tiles of span words: a stretch lies in its anchor's tile or a neighbour.
    tiles = rare.join(index, "term").select("w1", "w2", "h1", "h2", F.explode(F.array(*[F.floor(F.col("pos") / span) + d for d in (-1, 0, 1)])).alias("tile")).distinct()
    near = need.join(index, "term").withColumn("tile", F.floor(F.col("pos") / span)).dropDuplicates(["w1", "w2", "h1", "h2", "pos"]) \
        .join(tiles, ["w1", "w2", "h1", "h2", "tile"], "left_semi")
    ahead = Window.partitionBy("w1", "w2", "h1", "h2").orderBy("pos").rangeBetween(0, span - 1)
    seen = near.withColumn("met", F.collect_set("term").over(ahead)).withColumn("firsts", F.collect_list(F.struct("pos", "term")).over(ahead))
    # The stretch ends where the last missing term first appears.
    last = F.array_max(F.transform("met", lambda t: F.array_min(F.transform(F.filter("firsts", lambda p: p["term"] == t), lambda p: p["pos"]))))
    return seen.where(F.size("met") == F.col("terms")).select("w1", "w2", "h1", "h2", F.col("pos").alias("start"), last.alias("end"))


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Spans of ``df``'s texts that test items cover: h1, h2, items (sorted
    ids as text, null: ""), spans (disjoint [first word, words] pairs in order),
    n_hit.  Only texts with a hit; copies once."""
    windows, members = windows_of(items, item, item_text, width)
    windows = stage(windows, "window-terms")
    index = build_index(df, text, stage(windows.select("term").distinct(), "vocabulary"))
    found = phrases(index, windows)
    order = Window.partitionBy("h1", "h2").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("h1", "h2", "start", (F.col("start") + F.col("len")).alias("end")).distinct().withColumn("reach", reach) \
        .withColumn("open", F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("open").over(order)) \
        .groupBy("h1", "h2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("words")))).alias("spans"),
                                 F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    named = found.select("h1", "h2", "w1", "w2").distinct().join(members, ["w1", "w2"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stage(spans.join(named, ["h1", "h2"]), "covered")


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` plus n_words, n_hit, n_items, items (sorted ids as text),
    spans (first word, words; words counted over the split text, whose first
    piece is empty if it starts with a break) and contaminated; columns of
    these names are replaced.

    Null and wordless texts have no words and no hit.  Repeated rows get equal
    results; items with equal ids count once, null ids as one item "".  Empty
    tables give no rows or no hits.  Texts may be of any length."""
    names = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    df = df.drop(*names)
    k1, k2 = fresh(df, "__h1", "__h2")
    hits = find_items(df, items, text, item, item_text, width).withColumnsRenamed({"h1": k1, "h2": k2})
    keys = text_key(F.col(text))
    out = df.select("*", keys[0].alias(k1), keys[1].alias(k2), F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1), lambda w: w != "")).cast("long").alias("n_words")) \
        .join(hits, [k1, k2], "left")
    none = F.array().cast("array<string>")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
                      F.col("spans"), F.col("n_hit").isNotNull().alias("contaminated"))


def op11_contamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, array_to_string(w[s:s + {WIDTH} - 1], ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WIDTH - 1}))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, s, grams.n, item FROM grams JOIN win ON win.n = grams.n AND win.g = grams.g),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN named USING (rid)
"""
