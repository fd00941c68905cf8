"""Ranked lexical search by pipelined term partitioning.

The index holds inverted lists by block of documents (the rows of one Arrow
batch): term -> slots and occurrences, and per block the documents' ids and
lengths.  A list, however long, is thus spread over the blocks.

Terms belong to owners, rarest terms first.  Items travel in bundles: a bundle
carries, for each block, the sparse scores its items' documents have gathered
so far, and passes the owners one after the other.  At each owner a cogroup
brings the bundle together with the owner's lists of that block and adds their
integer contributions.  The last owner's documents below an item's 50th best
score so far (scores only grow) are left behind; the best of the rest are
selected.  Scores are 64-bit integers, so the order of additions does not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opexlens.llm.common import fresh, stage, table, text_blocks, text_buffer, word_hashes, word_spans

TOP = 50
BUNDLE_ITEMS = 128  # items to a bundle, on average
# Owners by the share of documents a term is in: a term of at most the first
# share belongs to the first owner, and so on; the last owner takes the rest.
OWNER_SHARES = (0.001, 0.02)
# Bits of the vocabulary filter (1 MB), whatever the number of items.
FILTER_BITS = 1 << 23
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False

_LISTS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("term", T.LongType()),
    T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType())),
    T.StructField("lens", T.ArrayType(T.LongType()))])


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, occurrences), rows ascending, and per row its length in terms last."""
    data, rows = text_buffer(column)
    starts, ends, first = word_spans(data, rows, _BREAK)
    hashes = word_hashes(data, starts, ends, lower=True)
    lengths = np.diff(first)
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return np.stack([r[at], np.diff(np.append(at, len(r)))]) if len(r) else np.zeros((2, 0), np.int64), h[at], lengths


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 23)).astype(np.int64)


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Written rows (qid, item, term), one per item and different term."""
    qid, = fresh(items, "qid")
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn(qid, F.monotonically_increasing_id())
    rows = rows.select(qid, "item", "text")

    def run(batches):
        for batch in batches:
            (row, _), h, _ = _terms(batch.column(2).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(h.view(np.int64))], ["qid", "item", "term"])

    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("item", items.schema[item].dataType), T.StructField("term", T.LongType())])
    return stage(rows.mapInArrow(run, schema), "item-terms")


def _vocabulary_bits(terms: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with the terms' first bits set: at most 256 rows of 4 KB reach the driver."""
    bit = F.shiftrightunsigned("term", 64 - 23)
    rows = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS, bool)
    for bucket, raw in rows:
        # Bit 0 stands in bucket 0, all others in buckets from 1.
        base = (bucket - 1) * 32768 + 1 if bucket > 0 else 0
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(raw), np.uint8), bitorder="little"))
        bits[base + on if bucket > 0 else on] = True
    return np.packbits(bits)


def build_index(df: DataFrame, vocabulary: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(lists: block, term, slots, tf; blocks: block, ids, lens), written once.
    Only lists of terms in the vocabulary's filter are kept (a few others may
    pass; no query asks for them).  Slots of a block go by id, nulls last."""
    packed = _vocabulary_bits(vocabulary)
    id_type = df.schema[id_col].dataType
    schema = T.StructType(list(_LISTS.fields) + [T.StructField("ids", T.ArrayType(id_type))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        known = np.unpackbits(packed).astype(bool)
        partition, number = TaskContext.get().partitionId(), 0
        arrow_id = to_arrow_type(id_type)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        names = [f.name for f in schema.fields]
        for batch in batches:
            order = pc.sort_indices(batch.column(0), null_placement="at_end")
            ids, texts = batch.column(0).take(order), batch.column(1).cast(pa.large_string()).take(order)
            for at, part in text_blocks(texts):
                block = (partition << 32) | number
                number += 1
                (row, tf), h, lengths = _terms(part)
                some = known[_bit(h)]
                row, tf, h = row[some], tf[some], h[some]
                by = np.argsort(h, kind="stable")
                row, tf, h = row[by], tf[by], h[by]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                offsets = pa.array(np.append(first, len(h)), pa.int32())
                n = len(first)
                slots = pa.ListArray.from_arrays(offsets, pa.array(row.astype(np.int32)))
                tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(h[first].view(np.int64)), slots.cast(ints), tfs.cast(ints), pa.nulls(n, longs), pa.nulls(n, pa.list_(arrow_id))], names)
                one = pa.array([0, len(part)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, ints), pa.nulls(1, ints),
                     pa.ListArray.from_arrays(one, pa.array(lengths.astype(np.int64))).cast(longs),
                     pa.ListArray.from_arrays(one, ids.slice(at, len(part))).cast(pa.list_(arrow_id))], names)

    rows = stage(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "search-index")
    return rows.where("term IS NOT NULL").select("block", "term", "slots", "tf"), rows.where("lens IS NOT NULL").select("block", "ids", "lens")


_CARRIED = "bundle long, block long, lens array<long>, theta array<long>, items array<int>, slots array<int>, scores array<long>"
_ARROW = {"bundle": pa.int64(), "block": pa.int64(), "lens": pa.list_(pa.int64()), "theta": pa.list_(pa.int64()),
          "items": pa.list_(pa.int32()), "slots": pa.list_(pa.int32()), "scores": pa.list_(pa.int64())}


def _owner_stage(total_terms: int, documents: int, last: bool, top: int):
    """The cogroup function of one owner: adds the contributions of its lists
    to a bundle's scores in one block."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:  # a list without a bundle cannot be: every bundle visits every block
            return pa.Table.from_arrays([pa.array([], t) for t in _ARROW.values()], names=list(_ARROW))
        lens = left["lens"][0].values.to_numpy(zero_copy_only=False)
        theta = left["theta"][0].values.to_numpy(zero_copy_only=False) if last else None
        n_items = left["theta"][0].values.__len__()
        score = np.zeros((n_items, len(lens)), np.int64)
        score[left["items"][0].values.to_numpy(zero_copy_only=False), left["slots"][0].values.to_numpy(zero_copy_only=False)] = left["scores"][0].values.to_numpy(zero_copy_only=False)
        m = 100 - 50 + (50 * lens * documents) // max(1, total_terms)
        for slots, tf, items, weight in zip(*(right[c].combine_chunks() for c in ("slots", "tf", "items", "weight"))):
            s, f = slots.values.to_numpy(zero_copy_only=False), tf.values.to_numpy(zero_copy_only=False).astype(np.int64)
            add = weight.as_py() * ((1_000_000_000 * f) // (1000 * f + 20 * m[s]))
            score[np.ix_(items.values.to_numpy(zero_copy_only=False), s)] += add
        if last:
            score[score < np.maximum(theta, 1)[:, None]] = 0
            if score.shape[1] > top:  # equal scores: earlier slots, that is smaller ids
                worse = np.argsort(-score, axis=1, kind="stable")[:, top:]
                np.put_along_axis(score, worse, 0, axis=1)
        item, slot = np.nonzero(score)
        columns = {"items": item.astype(np.int32), "slots": slot.astype(np.int32), "scores": score[item, slot]}
        out = []
        for name, kind in _ARROW.items():
            if name in columns:
                values = columns[name]
                out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)).cast(kind))
            else:
                out.append(left[name].combine_chunks().cast(kind))
        return pa.Table.from_arrays(out, names=list(_ARROW))

    return run


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item: item, rank (from 1), id,
    score.  Equal scores go by id (nulls last).

    Every row of ``df`` is a document of its own, also repeated rows and those
    with a null id; a null, empty or wordless text is no document and matches
    nothing.  Every row of ``items`` is searched; items without a known term,
    and empty tables, give no rows.  Other columns of both are not carried.
    Texts may be of any length: a block holds at most about 4 MB of text, or one
    longer text."""
    terms = item_terms(items, item, item_text)
    lists, blocks = build_index(df, terms, id_col, text)
    sizes = blocks.select(F.explode("lens").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, total = sizes.docs, sizes.terms
    bundles = max(1, -(-terms.select("qid").distinct().count() // BUNDLE_ITEMS))
    out_type = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("rank", T.IntegerType()),
                             T.StructField("id", df.schema[id_col].dataType), T.StructField("score", T.LongType())])
    frequency = lists.select("term", F.size("slots").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
    known = terms.select("term").distinct().join(frequency, "term")
    owner = F.lit(0)
    for share in OWNER_SHARES:
        owner = owner + (F.col("df") > share * documents).cast("int")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * documents + 2)) / (F.lit(2.0) * F.col("df") + 1)))
    known = known.select("term", owner.alias("owner"), weight.alias("weight"))
    # Items by bundle, numbered within it (a bundle holds BUNDLE_ITEMS or so).
    numbered = terms.select("qid", "item").distinct().withColumn("bundle", F.pmod(F.xxhash64("qid"), F.lit(bundles)))
    numbered = stage(numbered.withColumn("no", F.row_number().over(Window.partitionBy("bundle").orderBy("qid")) - 1), "bundles")
    asked = stage(terms.select("qid", "term").join(numbered.select("qid", "bundle", "no"), "qid").join(known, "term")
                  .groupBy("owner", "bundle", "term", "weight").agg(F.sort_array(F.collect_list("no")).alias("items")), "asked")
    zero = F.array_repeat(F.lit(0).cast("long"), F.col("n").cast("int"))
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("items", "int"), ("slots", "int"), ("scores", "long"))]
    per_bundle = numbered.groupBy("bundle").agg(F.count("*").alias("n")).select("bundle", zero.alias("theta"))
    # Every bundle meets every block: the search is all items against all documents.
    nos = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long")))
    carried = blocks.select("block", "lens", nos.alias("bundle")).join(per_bundle, "bundle").select("bundle", "block", "lens", "theta", *empty)
    last = len(OWNER_SHARES)
    for k in range(last + 1):
        if k == last and k > 0:
            best = _best(carried, top).where(F.col("rank") == top)
            theta = numbered.join(best.select("bundle", "no", "score"), ["bundle", "no"], "left").groupBy("bundle") \
                .agg(F.sort_array(F.collect_list(F.struct("no", F.coalesce("score", F.lit(0)).alias("score")))).alias("t")) \
                .select("bundle", F.transform("t", lambda x: x["score"]).alias("theta"))
            carried = carried.drop("theta").join(theta, "bundle").select("bundle", "block", "lens", "theta", "items", "slots", "scores")
        mine = lists.join(asked.where(F.col("owner") == k).select("bundle", "term", "weight", "items"), "term") \
            .select(F.col("bundle").alias("to"), F.col("block").alias("at"), "slots", "tf", "items", "weight")
        carried = carried.groupBy("bundle", "block").cogroup(mine.groupBy("to", "at")).applyInArrow(_owner_stage(total, documents, k == last, top), _CARRIED)
        carried = stage(carried, f"owner-{k}")
    found = _hits(carried).join(blocks.select("block", "ids"), "block").select("bundle", "no", "score", F.col("ids")[F.col("slot")].alias("id"))
    rank = F.row_number().over(Window.partitionBy("bundle", "no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    named = ranked.join(numbered.select("bundle", "no", "item"), ["bundle", "no"])
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out_type.fields])


def _hits(carried: DataFrame) -> DataFrame:
    rows = carried.select("bundle", "block", F.explode(F.arrays_zip("items", "slots", "scores")).alias("x"))
    return rows.select("bundle", "block", F.col("x.items").alias("no"), F.col("x.slots").alias("slot"), F.col("x.scores").alias("score"))


def _best(carried: DataFrame, top: int) -> DataFrame:
    """Each item's ``top`` best scores so far (the row limit is applied within
    partitions before the exchange)."""
    rank = F.row_number().over(Window.partitionBy("bundle", "no").orderBy(F.desc("score")))
    return _hits(carried).withColumn("rank", rank).where(F.col("rank") <= top)


def op12_search(spark, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
sized AS (SELECT rid, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT qid, item_id, t FROM (SELECT qid, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS w FROM benchmark))),
weighed AS (SELECT qid, item_id, t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (t), total),
scored AS (SELECT qid, item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
           FROM weighed JOIN tf USING (t) JOIN sized USING (rid), total GROUP BY qid, item_id, rid),
ranked AS (SELECT qid, item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored JOIN sized USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
