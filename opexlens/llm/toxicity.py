"""Toxicity from the nearest labelled examples.

Texts are bags of words and word beginnings (4, 5 and 6 bytes, ASCII folded
to lower case).  A bounded sample of labelled documents serves as the
examples, and every term of theirs counts: its weight is the inverse document
frequency, counted over the whole corpus, times a power of the absolute log
odds of the classes among the examples (smoothed by half a text).  The power, 0
for plain TF-IDF or one of ``POWERS``, is the one with the least leave-one-out
loss on the examples, which are learning rows only.  Each document finds its
``k`` nearest examples by the cosine of these vectors; an example with the same
terms as the document (itself, or a copy) says nothing about it and is left out.  The commonest ``DENSE``
terms stand in blocks of examples with each term's largest weight per block,
all others in posting lists; a block whose bound cannot beat the k-th best of
the lists alone is skipped, so results are exact.  Votes weighted by similarity are
calibrated by a logistic fit on leave-one-out votes of the examples.

Bound (parameter): examples per class.  Everything else covers all rows.
The driver holds the examples' terms and their counts only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import drop_stage, fresh, mix64, stage, table, text_blocks, text_buffer, word_hashes, word_spans

PREFIXES = (4, 5, 6)
BLOCK, K = 64, 15
PER_CLASS, DENSE = 2000, 1024
POWERS = (0.0, 0.5, 1.0)
SAME = 1 - 1e-5  # cosine from which two bags of terms are the same
QUERIES, POSTINGS = 250, 1 << 18  # texts scored at a time, postings read at a time


# -- terms ------------------------------------------------------------------

def text_terms(column: pa.Array):
    """Yields (term hashes of every word, index of each text's first word):
    whole words first, then each beginning; words shorter than a beginning
    have none of it."""
    data, rows = text_buffer(column)
    starts, ends, first = word_spans(data, rows)
    yield word_hashes(data, starts, ends, lower=True), first
    for n in PREFIXES:
        full = ends - starts >= n
        with np.errstate(over="ignore"):
            yield mix64(word_hashes(data, starts[full], starts[full] + n, lower=True) + np.uint64(n)), np.append(0, np.cumsum(full))[first]


def _example_terms(batches):
    """Labelled texts -> one row per different term of a text."""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for lo, texts in text_blocks(batch.column("text"), 1 << 20):
            term, row = [], []
            for values, first in text_terms(texts):
                term.append(values)
                row.append(np.repeat(np.arange(len(texts)), np.diff(first)))
            pairs = np.unique(np.stack([np.concatenate(row).astype(np.uint64), np.concatenate(term)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(label[lo + pairs[0].astype(np.int64)])], ["term", "toxic"])


def _vectors(terms: np.ndarray, keep: list[str], added: list[str]):
    """Columns ``keep``, then the text -> ``keep`` and (term numbers, counts)
    over the examples' terms (sorted)."""
    def run(batches):
        for batch in batches:
            for lo, texts in text_blocks(batch.column(len(keep)), 1 << 20):
                found = []
                for values, first in text_terms(texts):
                    if not len(terms):
                        continue
                    at = np.searchsorted(terms, values)
                    hit = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == values)
                    row = np.searchsorted(first, hit, side="right") - 1
                    found.append(row * len(terms) + at[hit])
                code, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                row, term = np.divmod(code, max(1, len(terms)))
                edge = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                    + [pa.ListArray.from_arrays(edge, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(count.astype(np.int32)))],
                    keep + added)
    return run


def _frequencies(terms: np.ndarray):
    """Texts -> (term number, texts with it), once per task; -1: all texts."""
    def run(batches):
        seen, n = np.zeros(len(terms), np.int64), 0
        for out in _vectors(terms, [], ["terms", "counts"])(batches):
            n += len(out)
            seen += np.bincount(out.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(terms))
        found = np.flatnonzero(seen)
        for lo in range(0, len(found) + 1, 1 << 16):
            part = found[lo:lo + (1 << 16)]
            all_texts = ([-1], [n]) if lo == 0 else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(part, all_texts[0]).astype(np.int32)),
                                              pa.array(np.append(seen[part], all_texts[1]).astype(np.int64))], ["term", "n"])
    return run


def weights(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Entries of unit vectors (rows 0 to n - 1): (1 + log count) * weight."""
    out = (1 + np.log(counts)) * weight[terms]
    norm = np.sqrt(np.bincount(rows, weights=out**2, minlength=n))
    return (out / np.where(norm > 0, norm, 1)[rows]).astype(np.float32)


class Vectors(NamedTuple):
    """Unit vectors: the commonest terms as a dense matrix, the entries of
    all others as (row, term, value)."""

    dense: np.ndarray
    row: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def part(self, lo: int, hi: int) -> Vectors:
        """Rows lo to hi - 1 (entries are sorted by row)."""
        a, b = np.searchsorted(self.row, [lo, hi])
        return Vectors(self.dense[lo:hi], self.row[a:b] - lo, self.term[a:b], self.value[a:b])


def vectors(n: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, column: np.ndarray) -> Vectors:
    """``n`` entries a row; ``column``: a term's dense column, -1 for none."""
    row = np.repeat(np.arange(len(n)), n)
    value = weights(row, terms, counts, weight, len(n))
    at = column[terms]
    common = at >= 0
    dense = np.zeros((len(n), int(column.max(initial=-1)) + 1), np.float32)
    dense[row[common], at[common]] = value[common]
    return Vectors(dense, row[~common].astype(np.int32), terms[~common].astype(np.int32), value[~common])


# -- the block-max index ----------------------------------------------------

class BlockMaxIndex:
    """Examples in blocks, with every common term's largest weight per block
    and posting lists of all other terms."""

    def __init__(self, vectors: np.ndarray | Vectors, ids: np.ndarray, labels: np.ndarray):
        if not isinstance(vectors, Vectors):
            vectors = Vectors(vectors, *(np.zeros(0, t) for t in (np.int64, np.int64, np.float32)))
        dense = vectors.dense
        # Examples with the same strongest term stand together, so that a
        # block is strong in few terms and its bound is tight.
        order = np.lexsort((ids, dense.argmax(axis=1) if dense.shape[1] else np.zeros(len(ids)), ~dense.any(axis=1)))
        self.vectors, self.ids, self.labels = dense[order], ids[order], labels[order]
        self.edges = list(range(0, len(ids), BLOCK))
        self.most = np.stack([self.vectors[e:e + BLOCK].max(axis=0) for e in self.edges], axis=1) if self.edges else np.zeros((dense.shape[1], 0), np.float32)
        place = np.argsort(order)
        by_term = np.argsort(vectors.term, kind="stable")
        self.example, self.value = place[vectors.row[by_term]].astype(np.min_scalar_type(max(1, len(ids)))), vectors.value[by_term]
        self.first = np.searchsorted(vectors.term[by_term], np.arange(int(vectors.term.max(initial=-1)) + 2))
        # Most examples with one and the same vector.
        alike: dict[bytes, int] = {}
        ends = np.searchsorted(vectors.row, np.arange(len(ids) + 1))
        for i in range(len(ids)):
            key = b"".join(x.tobytes() for x in (dense[i], vectors.term[ends[i]:ends[i + 1]], vectors.value[ends[i]:ends[i + 1]]))
            alike[key] = alike.get(key, 0) + 1
        self.copies = max(alike.values(), default=0)

    def rare(self, queries: Vectors) -> np.ndarray:
        """Products over the posting lists (queries x examples)."""
        out = np.zeros((len(queries.dense), len(self.ids)), np.float32)
        known = np.flatnonzero(queries.term < len(self.first) - 1)
        row, term, value = queries.row[known], queries.term[known], queries.value[known]
        size = self.first[term + 1] - self.first[term]
        upto, at = np.cumsum(size), 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POSTINGS, side="right")))
            n = size[at:to]
            post = np.repeat(self.first[term[at:to]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            lo, hi = int(row[at]), int(row[to - 1]) + 1
            out[lo:hi] += np.bincount(np.repeat((row[at:to] - lo).astype(np.int64) * len(self.ids), n) + self.example[post], weights=np.repeat(value[at:to], n) * self.value[post],
                                      minlength=(hi - lo) * len(self.ids)).reshape(hi - lo, -1)
            at = to
        return out

    def nearest(self, queries: np.ndarray | Vectors, k: int, same: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines), the k best of each query, best first
        and ties by number; cosine 0 where fewer have a term in common.
        Examples with a cosine above ``same`` are left out."""
        rare = None
        if isinstance(queries, Vectors):
            if len(queries.dense) > QUERIES:
                parts = [self.nearest(queries.part(lo, lo + QUERIES), k, same) for lo in range(0, len(queries.dense), QUERIES)]
                return tuple(np.concatenate(x) for x in zip(*parts))
            rare, queries = self.rare(queries), queries.dense
        who, best = np.full((len(queries), k), -1), np.zeros((len(queries), k), np.float32)
        if not self.edges:
            return who, best
        # Common terms only add, so the k-th best of the others is a floor.
        bound, floor = queries @ self.most, np.zeros(len(queries), np.float32)
        score = np.zeros((len(queries), len(self.ids)))
        if rare is not None:
            bound += np.maximum.reduceat(rare, self.edges, axis=1)
            # Of the best, as many as are alike may be left out.
            spare = k + (self.copies if same is not None else 0)
            if len(self.ids) > spare:
                floor = np.partition(rare, -spare, axis=1)[:, -spare]
        for b, lo in enumerate(self.edges):
            rows = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] * (1 + 1e-5) >= floor))
            if len(rows):
                product = queries[rows] @ self.vectors[lo:lo + BLOCK].T
                score[rows, lo:lo + BLOCK] = product if rare is None else product + rare[rows, lo:lo + BLOCK]
        if same is not None:
            score[score > same] = 0
        # Far below the spacing of single precision: ties go by number.
        ranked = score - np.arange(len(self.ids)) * 1e-14
        pick = np.argpartition(-ranked, k - 1, axis=1)[:, :k] if len(self.ids) > k else np.broadcast_to(np.arange(len(self.ids)), score.shape)
        pick = np.take_along_axis(pick, np.lexsort((pick, -np.take_along_axis(score, pick, axis=1)), axis=1), axis=1)
        n = pick.shape[1]
        best[:, :n] = np.take_along_axis(score, pick, axis=1)
        who[:, :n] = np.where(best[:, :n] > 0, pick, -1)
        return who, best

    def votes(self, queries: np.ndarray | Vectors, k: int, prior: float):
        """Share of similarity that is toxic, drawn to the prior by half a
        perfect neighbour, with the neighbours behind it; examples that are the
        query itself or a copy have no vote."""
        who, cosine = self.nearest(queries, k, SAME)
        label = np.where(who >= 0, self.labels[who], 0) if len(self.labels) else np.zeros(who.shape)
        return ((cosine * label).sum(axis=1) + 0.5 * prior) / (cosine.sum(axis=1) + 0.5), who, cosine


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted fit of P(y = 1) = 1 / (1 + exp(-(a x + b))) with a small ridge."""
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (w * (p - y)) + np.array([1e-2, 1e-3]) * theta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 0)), float(theta[1])


# -- operator ---------------------------------------------------------------

def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Scorer(NamedTuple):
    """A fitted model: the examples' terms, their weights and dense columns,
    and the index with the calibration."""

    terms: np.ndarray
    weight: np.ndarray
    column: np.ndarray
    model: tuple
    k: int
    prior: float

    def of_batches(self, keep: list[str]):
        """Arrow step: columns ``keep``, then the text -> ``keep``, score,
        evidence, cosines."""
        found = _vectors(self.terms, keep, ["terms", "counts"])
        scores = _score(self.model, self.weight, self.column, self.k, self.prior, len(keep))

        def run(batches):
            for out in scores(found(batches)):
                yield out.rename_columns(keep + ["score", "evidence", "cosines"])
        return run

    def of_text(self, text: Column) -> Column:
        """The score of a text column, where the rows are."""
        scores = self.of_batches([])

        @F.pandas_udf("double")
        def score_text(values: pd.Series) -> pd.Series:
            batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string(), from_pandas=True)], ["text"])
            return pd.Series([p for out in scores([batch]) for p in out.column("score").to_numpy()], dtype=float)
        return score_text(text)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", per_class: int = PER_CLASS,
        k: int = K, seed: int = 5, powers: tuple[float, ...] = POWERS) -> Scorer:
    """The scorer that :func:`score` applies; see there."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")) \
        .where(~held_out(F.col("doc_id")))
    # Labels without a document here teach nothing; only those with one are sampled.
    here = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct()
    known = stage(known.join(here, "doc_id"), "toxic-labels")
    size = {int(r["toxic"]): int(r["n"]) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    prior = size.get(1, 0) / total if total else 0.0
    by_chance = F.xxhash64(F.lit(seed), "doc_id")
    sample = None
    for c in (0, 1):  # top-n of narrow rows: at most per_class per task and in all
        part = known.where(F.col("toxic") == c).orderBy(by_chance, "doc_id").limit(per_class)
        sample = part if sample is None else sample.union(part)
    sample = stage(sample, "toxic-sample")
    # One text per example: the smallest of repeated ids, by hash.
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL") \
        .join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("text")) \
        .groupBy("doc_id", "toxic").agg(F.min_by("text", "h").alias("text"))  # broadcast: at most 2 x per_class rows
    texts = stage(texts, "toxic-examples")
    of = {int(r["toxic"]): int(r["n"]) for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = of.get(0, 0), of.get(1, 0)

    # Every term of the examples, weighed by the log odds of the classes.
    found = texts.select("toxic", "text").mapInArrow(_example_terms, "term long, toxic int").groupBy("term") \
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.lit(bool(n0 and n1))).toArrow()
    terms, a, b = (found.column(c).to_numpy() for c in ("term", "a", "b"))
    terms = terms.view(np.uint64)
    order = np.argsort(terms)
    terms, a, b = terms[order], a[order], b[order]
    odds = np.abs(np.log((a + 0.5) / (n1 + 1.0) / ((b + 0.5) / (n0 + 1.0))))
    column = np.full(len(terms), -1, np.int32)
    common = np.lexsort((terms, -(a + b)))[:DENSE]
    column[common] = np.arange(len(common))

    # Rows of the terms' counts: at most one per term and task, one per term in all.
    counted = df.select(F.col(text).alias("text")).mapInArrow(_frequencies(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms) + 1)
    seen[counted["term"].to_numpy()] = counted["n"].to_numpy()
    n_docs, seen = seen[-1], seen[:-1]  # -1: all texts
    idf = np.log((1 + n_docs) / (1 + seen)) + 1

    examples = texts.select("doc_id", "toxic", "text").mapInArrow(_vectors(terms, ["doc_id", "toxic"], ["terms", "counts"]), f"doc_id {df.schema[id_col].dataType.simpleString()}, toxic int, terms array<int>, counts array<int>").orderBy("doc_id").toArrow()
    best = None
    for power in powers:
        weight = idf * odds**power
        model, loss = _fit(examples, weight, column, {c: size.get(c, 0) for c in (0, 1)}, k, prior)
        if best is None or loss < best[0] - 1e-9:
            best = loss, weight, model
    drop_stage(known, sample, texts)
    return Scorer(terms, best[1], column, best[2], k, prior)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` without its text plus held_out, score (0 to 1), predicted, and
    the evidence: ids and cosines of the nearest examples, best first.

    ``labels``: the id column and ``toxic`` (0, 1; null: unlabelled), of
    which ids with crc32(id) mod 5 = 0 are never learned from.  At most
    ``per_class`` documents of each class are examples (a seeded sample).  A
    document labelled twice counts as toxic if any label says so.  Null and
    blank texts have no terms and get the score of term-less documents; with
    no labels at all every score is 0.  Repeated rows score alike.
    ``options``: per_class, k, seed, powers.  Texts of any length are read
    whole, in bounded slices of a batch."""
    m = fit(df, labels, id_col, text, **options)
    names = [c for c in df.columns if c not in (text, "held_out", "score", "predicted", "evidence", "cosines")]
    fields = "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)
    out = df.select(*[F.col(f"`{n}`") for n in names], F.col(text).alias(fresh(df, "__text")[0])) \
        .mapInArrow(m.of_batches(names), f"{fields}score double, evidence array<long>, cosines array<double>")
    return out.select(*[F.col(f"`{n}`") for n in names], held_out(F.col(f"`{id_col}`")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")


def _batch_vectors(terms: pa.Array, counts: pa.Array, weight: np.ndarray, column: np.ndarray) -> Vectors:
    n = np.diff(terms.offsets.to_numpy())
    return vectors(n, *(c.flatten().to_numpy(zero_copy_only=False) for c in (terms, counts)), weight, column)


def _fit(examples, weight: np.ndarray, column: np.ndarray, size: dict[int, int], k: int, prior: float):
    """((index, slope, intercept), loss) from the examples; votes for the fit
    leave the example itself out, and classes weigh as in all labelled rows."""
    parts, at = [], 0
    for batch in examples.to_batches(max_chunksize=QUERIES):
        found = _batch_vectors(batch.column("terms"), batch.column("counts"), weight, column)
        parts.append(found._replace(row=found.row + np.int32(at)))
        at += len(batch)
    own = Vectors(*(np.concatenate(x) for x in zip(*parts))) if parts else vectors(*np.zeros((3, 0), np.int32), weight, column)
    label = examples["toxic"].to_numpy().astype(np.int64)
    index = BlockMaxIndex(own, examples["doc_id"].to_numpy().astype(np.int64), label)
    y = label.astype(float)
    if not len(y) or y.min() == y.max():
        return (index, 0.0, 30.0 if prior == 1 else -30.0), 0.0
    vote, _, _ = index.votes(own, k, prior)
    share = np.array([size[int(c)] / max(1, (y == c).sum()) for c in y])
    slope, intercept = logistic(vote, y, share / share.sum() * len(y))
    p = 1 / (1 + np.exp(-np.clip(slope * vote + intercept, -30, 30)))
    # Both classes count alike: the rare one is what is looked for.
    loss = -np.mean([np.log(np.where(y == c, np.where(c, p, 1 - p), 1)).sum() / (y == c).sum() for c in (0, 1)])
    return (index, slope, intercept), float(loss)


def _score(model, weight: np.ndarray, column: np.ndarray, k: int, prior: float, keep: int):
    """Arrow step: ``keep`` columns, terms, counts -> the columns, score,
    evidence, cosines."""
    index, slope, intercept = model

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                vote, who, cosine = index.votes(_batch_vectors(part.column(keep), part.column(keep + 1), weight, column), k, prior)
                p = 1 / (1 + np.exp(-np.clip(slope * vote + intercept, -30, 30))) if prior else np.zeros(len(part))
                used = who >= 0
                edge = np.append(0, np.cumsum(used.sum(axis=1))).astype(np.int32)
                ids = index.ids[who[used]] if len(index.ids) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(keep)] + [pa.array(p), pa.ListArray.from_arrays(edge, pa.array(ids.astype(np.int64))),
                                                             pa.ListArray.from_arrays(edge, pa.array(cosine[used].astype(float)))],
                    [f"c{i}" for i in range(keep)] + ["score", "evidence", "cosines"])
    return run


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
