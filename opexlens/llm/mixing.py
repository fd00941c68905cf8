"""Mixing sources to target weights by a multivariate-hypergeometric
splitting tree.

Each source is one long stream of words, its documents in the order of the
written parts (parts in seeded order), cut into blocks of ``block_words``.  A
source's target is met by whole passes over its blocks plus a partial pass over
the first blocks of a keyed block permutation (the last one cut), so the words
taken equal the target.  The block quotas of all sources are split among the
output shards by a binary tree of hypergeometric draws; block number g of a
source's draw then belongs to the shard whose quota range holds g, so blocks
are disjoint by construction.  Inside a shard the pieces are shuffled by a
seeded key.

Texts are written once with their place in their part, so that a table of
(source, part) starts places every document where it lies; texts then move once,
to their shards.  Nothing grows on the driver but one row per 1,000 sources.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opexlens.llm.common import (fresh, mix64, multi_hypergeometric, partitions, permute, stage, table, text_blocks, text_buffer, word_spans,
                                 words_of)

CHUNK = 1000
WEIGHTS = (3.0, 1.0, 2.0)


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with its gapless 0-based rank in ``order``: range-sorted and
    written, then each file's rows are counted on from the files before."""
    part, mid = fresh(df, "__part", "__mid")
    rows = stage(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()), label)
    rows = rows.withColumn(part, F.shiftright(mid, 33))
    counts = rows.groupBy(part).agg(F.count("*").alias("__c"))
    before = counts.select(part, (F.sum("__c").over(Window.orderBy(part)) - F.col("__c")).alias("__before"))
    return (rows.join(before, part)
            .withColumn(name, F.col("__before") + F.col(mid).bitwiseAND((1 << 33) - 1))
            .drop(part, mid, "__before"))


def targets(sources: DataFrame, budget: float, max_repeat: float) -> DataFrame:
    """``sources`` (source_size, weight) plus ``target``: the budget shared by
    weight, no target above ``max_repeat`` x size, the excess shared again by
    weight until none is above.  Empty sources get 0."""
    cap = F.col("source_size") * max_repeat
    level = 0.0
    while True:
        full = cap <= F.col("weight") * level
        rest, weight, capped = sources.agg(
            F.lit(budget) - F.sum(F.when(full, cap).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if not weight or rest is None:
            break
        higher = rest / weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas (one per kind) -> kinds x shards counts with the quotas as row
    sums: each node deals an exact share of its items to its left half."""
    out = np.zeros((len(quotas), shards), np.int64)

    def walk(items: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = items
            return
        mid = (lo + hi) // 2
        left = multi_hypergeometric(rng, items, int(items.sum()) * (mid - lo) // (hi - lo))
        walk(left, lo, mid)
        walk(items - left, mid, hi)

    walk(np.asarray(quotas, np.int64), 0, shards)
    return out


def _quotas(sources: DataFrame, block_words: int, shards: int, seed: int) -> DataFrame:
    """Per source: blocks, words of the partial pass, and the running shard
    quotas ``edges`` (shards + 1 entries) of its draw of blocks."""
    W = block_words
    planned = stage(
        sources.withColumn("words_out", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / W).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words_out") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words_out") - F.col("passes") * F.col("source_size"))
        # Bounds the draw only: the last block may be short, so one more block may be needed.
        .withColumn("quota", F.col("passes") * F.col("blocks") + F.least(F.col("blocks"), F.ceil(F.col("rest") / W) + 1) * (F.col("rest") > 0).cast("long"))
        .withColumn("chunk", F.floor(F.col("source_rank") / CHUNK).cast("long")), "mix-sources")
    chunks = planned.groupBy("chunk").agg(F.sum("quota").alias("q")).orderBy("chunk").toPandas()
    tree = splitting_tree(chunks["q"].to_numpy(np.int64), shards, np.random.default_rng([seed, 0])) if len(chunks) else []
    per_chunk = {int(c): tree[i].tolist() for i, c in enumerate(chunks["chunk"])}

    def deal(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng, left = np.random.default_rng([seed, 1, int(key[0])]), part.sort_values("source_rank")
        rest = left["quota"].to_numpy(np.int64).copy()
        edges = np.zeros((len(left), shards + 1), np.int64)
        for s, draws in enumerate(per_chunk[int(key[0])]):
            got = multi_hypergeometric(rng, rest, int(draws))
            rest -= got
            edges[:, s + 1] = edges[:, s] + got
        return pd.DataFrame({"source_rank": left["source_rank"].to_numpy(), "edges": list(edges)})

    edges = planned.groupBy("chunk").applyInPandas(deal, "source_rank long, edges array<long>")
    return stage(planned.join(edges, "source_rank").drop("chunk", "quota"), "mix-plan")


def _ranges(size, at, passes, rest, source_size, blocks, source_rank, edges, W: int, seed: int):
    """Rows of documents -> their taken word ranges, an entry per (pass,
    block) that a document meets: (row, pass, shard, block, first word, words)."""
    first, last = at // W, (at + np.maximum(size, 1) - 1) // W
    spans = last - first + 1
    reps = np.where(size > 0, spans * (passes + (rest > 0)), 0)
    row = np.repeat(np.arange(len(size)), reps)
    k = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
    turn, block = k // spans[row], first[row] + k % spans[row]
    n_blocks = blocks[row]
    key = source_rank.astype(np.uint64)[row] * np.uint64(1_000_003) + np.uint64(seed) + (turn.astype(np.uint64) << np.uint64(56))
    place = permute(block, n_blocks, key)
    begin, end = np.maximum(at[row], block * W), np.minimum(at[row] + size[row], (block + 1) * W)
    # The partial pass takes the words of places before its cut.
    short = n_blocks * W - source_size[row]
    before = place * W - np.where(permute(n_blocks - 1, n_blocks, key) < place, short, 0)
    stop = np.where(turn >= passes[row], np.minimum(end, block * W + np.maximum(rest[row] - before, 0)), end)
    keep = stop > begin
    row, turn, block, place, n_blocks, begin, stop = (v[keep] for v in (row, turn, block, place, n_blocks, begin, stop))
    g, shard = turn * n_blocks + place, np.empty(len(row), np.int32)
    for lo in range(0, len(row), 1 << 17):  # in bounded slices
        s = slice(lo, lo + (1 << 17))
        shard[s] = (edges[row[s]] <= g[s, None]).sum(axis=1) - 1
    return row, turn, shard, block, begin - at[row], stop - begin


_PLACED = ("size", "at", "passes", "rest", "source_size", "blocks", "source_rank")


def _of_batch(batch: pa.RecordBatch, W: int, seed: int):
    columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _PLACED]
    edges = batch.column("edges")
    flat = edges.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1), np.int64)
    return _ranges(*columns, flat, W, seed)


def _pieces(block_words: int, seed: int):
    """Arrow step: placed documents -> one row with the taken ranges of each
    that gives any."""
    def run(batches):
        for batch in batches:
            row, turn, shard, block, first, n = _of_batch(batch, block_words, seed)
            if not len(row):
                continue
            new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            edge = pa.array(np.append(new, len(row)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(edge, pa.array(v)) for v in (turn.astype(np.int32), shard, block, first, n)]
            yield pa.RecordBatch.from_arrays([batch.column("mid").take(pa.array(row[new])), *arrays], ["mid", "pass", "shard", "block", "first_word", "n_words"])
    return run


def _write_rows(source: str, names: list[str]):
    """Arrow step: adds size (words) and, in the order of the task's rows,
    ``before``: the words of the same source ahead."""
    def run(batches):
        ahead: dict = {}
        for batch in batches:
            for lo, texts in text_blocks(batch.column(names.index("text"))):
                data, rows = text_buffer(texts)
                size = np.diff(word_spans(data, rows)[2])
                before = np.zeros(len(size), np.int64)
                for i, (s, n) in enumerate(zip(batch.column(names.index(source)).slice(lo, len(size)).to_pylist(), size.tolist())):
                    before[i] = ahead.get(s, 0)
                    ahead[s] = before[i] + n
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, len(size)) for i in range(len(names))], pa.array(size.astype(np.int64)), pa.array(before)],
                                                 [*names, "size", "before"])
    return run


def place(df: DataFrame, source: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0,
          shards: int = 16, block_words: int = 4096, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the written rows of ``df`` under inner names c0, c1, ...
    (``text`` keeps its name) with mid (row number), size, before, at (first
    word in the source's stream) and the plan of their source; and that plan, a
    row a source."""
    # Inner names are positional, so no column of df can clash with them.
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(df.columns)]
    key = names[df.columns.index(source)]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)]
    flat = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, df.columns)], F.monotonically_increasing_id().alias("mid"))
    rows = stage(flat.mapInArrow(_write_rows(key, [*names, "mid"]), T.StructType(
        [*fields, *[T.StructField(n, T.LongType()) for n in ("mid", "size", "before")]])), "mix-rows", codec="zstd")
    part = F.shiftright("mid", 33)
    sums = stage(rows.groupBy(F.col(key).alias("__source"), part.alias("part")).agg(F.sum("size").alias("words")), "mix-parts")
    by_source = sums.groupBy("__source").agg(F.sum("words").alias("source_size"))
    ranked = numbered(by_source, [F.col("__source").asc_nulls_last()], "source_rank", "mix-rank")
    ranked = stage(ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights)).cast("int"))), "mix-weights")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    plan_of = _quotas(targets(ranked, budget, max_repeat), block_words, shards, seed)
    order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed), "part"), "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sums.withColumn("start", F.coalesce(F.sum("words").over(order), F.lit(0)))
                   .join(plan_of.select(F.col("__source").alias("__s"), "source_rank"), F.col("__source").eqNullSafe(F.col("__s")))
                   .select("__source", "part", "start", "source_rank"), "mix-starts")
    detail = plan_of.select("source_rank", "source_size", "target", "blocks", "passes", "rest", "edges")
    # Tables of (source, part) and of sources: broadcast by their measured size, else joined by key.
    placed = rows.join(starts, F.col(key).eqNullSafe(F.col("__source")) & (part == F.col("part"))).drop("__source", "part") \
        .join(detail, "source_rank").withColumn("at", F.col("start") + F.col("before"))
    return placed, plan_of


def plan(df: DataFrame, source: str = "source", block_words: int = 4096, seed: int = 11, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): what the mix takes from each document.

    documents: columns of ``df`` but the text under inner names c0, c1, ...,
    mid (row number), size, source_size, target.  pieces: mid and the arrays
    pass, shard, block, first_word, n_words, an entry per pass and block that a
    document meets; one row a document.  Null sources are one source, sorted
    last; null texts have no words; a row without words has no piece; repeated
    rows are rows of their own; an empty table gives none.  Above 10^9 blocks a
    draw of quotas takes the normal limit of its law."""
    placed, _ = place(df, source, block_words=block_words, seed=seed, **options)
    return _documents(placed, df), placed.select("mid", *_PLACED, "edges").mapInArrow(
        _pieces(block_words, seed), "mid long, `pass` array<int>, shard array<int>, block array<long>, first_word array<long>, n_words array<long>")


def _documents(placed: DataFrame, df: DataFrame) -> DataFrame:
    return placed.select(*[f"c{i}" for i, c in enumerate(df.columns) if c != "text"], "mid", "size", "source_size", "target")


def _cut(names: list[str], block_words: int, seed: int, max_chars: int = 8 << 20):
    """Arrow step: a placed document -> a row per range, with the separators
    between its words kept.  The text is read once, however many ranges it has;
    about ``max_chars`` characters are held back at a time."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches):
        for batch in batches:
            row, turn, shard, _, first, n = _of_batch(batch, block_words, seed)
            size = batch.column("size").to_numpy(zero_copy_only=False)
            key = order_keys(batch.column("mid").to_numpy(zero_copy_only=False).astype(np.uint64)[row], turn.astype(np.uint64), first.astype(np.uint64), seed)
            texts, out, held, done, now, spans, text = batch.column("text"), [], 0, 0, -1, None, None

            def flush(to):
                at = pa.array(row[done:to])
                arrays = [pa.array(out, pa.string()) if c == "text" else batch.column(c).take(at) for c in names]
                return pa.RecordBatch.from_arrays([*arrays, batch.column("mid").take(at), pa.array(shard[done:to]), pa.array(key[done:to])], [*names, "mid", "shard", "order_key"])

            for j, (i, a, k) in enumerate(zip(row.tolist(), first.tolist(), n.tolist())):
                if i != now:
                    now, spans, text = i, None, texts[i].as_py()
                if a == 0 and k == size[i]:
                    out.append(text)
                else:
                    if spans is None:
                        spans = [m.span() for m in word.finditer(text)]
                    out.append(text[spans[a][0]:spans[a + k - 1][1]])
                held += len(out[-1])
                if held > max_chars:
                    yield flush(j + 1)
                    out, held, done = [], 0, j + 1
            if out:
                yield flush(len(row))
    return run


def order_keys(mid: np.ndarray, turn: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Seeded place of each piece in its shard's order."""
    with np.errstate(over="ignore"):
        x = mix64(mid + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        return mix64(mix64(x ^ turn) ^ first).view(np.int64)


def mix_rows(df: DataFrame, seed: int = 11, shards: int = 16, source: str = "source", block_words: int = 4096, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, mixed): the plan's documents, and the mixed rows under the
    same inner names plus mid, shard and order_key; see ``plan`` and ``mix``."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "order_key")])
    placed, _ = place(df, source, shards=shards, seed=seed, block_words=block_words, **options)
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(df.columns)]
    cut = placed.select(*names, "mid", *_PLACED, "edges").mapInArrow(_cut(names, block_words, seed), T.StructType(
        [*[T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)], T.StructField("mid", T.LongType()),
         T.StructField("shard", T.IntegerType()), T.StructField("order_key", T.LongType())]))
    cells = max(1, partitions(df.sparkSession) // shards)
    cell = F.floor((F.shiftright("order_key", 33) + (1 << 30)) * cells / (1 << 31))
    return _documents(placed, df), cut.repartition(F.col("shard"), cell).sortWithinPartitions("shard", "order_key")


def mix(df: DataFrame, seed: int = 11, shards: int = 16, source: str = "source", **options) -> DataFrame:
    """The mixed rows: the columns of ``df``, a row per taken range and pass
    with ``text`` cut to the range, plus shard and order_key; dealt out by
    shard and stretch of the order, sorted by (shard, order_key) in a task.

    Edge cases as in ``plan``; columns named shard and order_key are replaced.
    A text of any length is moved once and read once, its ranges leave one by one."""
    names = [c for c in df.columns if c not in ("shard", "order_key")]
    _, mixed = mix_rows(df, seed, shards, source, **options)
    return mixed.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)], "shard", "order_key")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """``taken`` counts the words of the mixed rows themselves."""
    docs, mixed = mix_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = mixed.groupBy("mid").agg(F.sum(F.size(words_of(F.col("text")))).alias("taken"))
    return docs.join(taken, "mid", "left").select(
        F.col("c0").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
