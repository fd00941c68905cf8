"""Document fingerprints: bottom-k sketches of word-shingle hashes, in
DataFrame functions only.

A sketch keeps the k smallest 63-bit hashes of a text's 5-word shingles.  The
k smallest of a union come from the parts' sketches alone, so sketches merge
across parts; two of them estimate resemblance and containment, one the
number of distinct shingles (exact below k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import let, table, words_of
from opexlens.llm.mixing import numbered
from opexlens.llm.quality import window_hashes

K = 128
SHINGLE = 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the k smallest shingle hashes.  Texts of fewer words
    than a shingle are one shingle; null and blank texts have none."""
    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= shingle, window_hashes(w, shingle)) \
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))) \
            .otherwise(F.array().cast("array<long>"))
    short = F.transform(let(words_of(text), hashes), lambda h: F.shiftrightunsigned(h, 1))
    return F.slice(F.sort_array(F.array_distinct(short)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(s) < k, F.size(s).cast("double")) \
        .otherwise((k - 1) / (F.get(s, F.lit(k - 1)).cast("double") / float(2**63)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity (two empty sketches: 1, one: 0)."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (an empty a: 1)."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (na + nb) / na))


def encode(s: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash, smallest first."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``df`` plus ``sketch``, ``fingerprint`` (its text form) and
    ``n_shingles`` (estimated); columns of these names are replaced."""
    return df.withColumn("sketch", sketch(F.col(text), k)) \
        .withColumn("fingerprint", encode(F.col("sketch"))).withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def compare_edited(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each document against its edited text (second half replaced by the
    start of the next document) and against the next document.

    Next: ascending id (null ids first), ties by text hash, the first after the last.
    Repeated rows (same id and text) share one next document; null texts are
    empty; a lone document is its own next; an empty table gives no rows."""
    # k0, k1, k2 identify a row: null id, id, text.  The same three columns
    # and the text feed both joins, so the text is shuffled once.
    rows = df.select(F.col(id_col).isNull().cast("int").alias("k0"), F.coalesce(F.col(id_col), F.lit(0).cast(df.schema[id_col].dataType)).alias("k1"),
                     F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("k2", F.xxhash64("t"))
    keys = ["k0", "k1", "k2"]
    ranked = numbered(rows.select(*keys, F.length("t").alias("n")).distinct(), [F.col("k0").desc(), F.col("k1"), F.col("k2")], "rank", "sketch-order")
    total = ranked.count()
    successor = ranked.select(*[F.col(c).alias(f"p{c}") for c in keys], F.floor(F.col("n") / 2).cast("int").alias("need"),
                              F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"))
    links = ranked.select(*keys, "rank").join(successor, "rank").drop("rank")
    heads = (rows.join(links, keys)
             .select("pk0", "pk1", "pk2", F.substring(F.col("t"), F.lit(1), F.col("need")).alias("head"), sketch(F.col("t"), k).alias("next_sketch"))
             .dropDuplicates(["pk0", "pk1", "pk2"]))
    both = rows.join(heads, [rows[c] == heads[f"p{c}"] for c in keys])
    n = F.length("t")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    sketched = (both.select(keys[0], keys[1], n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), sketch(F.col("t"), k).alias("s"),
                            sketch(edited, k).alias("e"), "next_sketch"))
    return sketched.select(
        F.when(F.col("k0") == 0, F.col("k1")).alias(id_col), "n_chars", "edited_sha256", encode(F.col("s")).alias("fingerprint"),
        encode(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_sketch"), k).alias("near_next"))


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
