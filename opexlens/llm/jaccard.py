"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of 5-word shingles; two texts are linked at Jaccard
similarity 0.8 or more.  Equal texts are one class from the start.

1. Each text gets 128 MinHash values.  Texts that agree on all four values of
   one of 32 bands share a bucket (a link at 0.8 misses every band with
   probability 5e-8).
2. Inside a bucket, pairs compare their MinHash values 32 at a time and are
   dropped once the posterior probability of similarity >= 0.8 (uniform
   prior) is below ``tolerance``.  Texts that the bucket's surviving pairs
   already connect are not compared again, so a bucket of near copies costs
   one pass; all pairs of texts not yet connected are compared.
3. Surviving pairs make connected groups; within a group, members meet in
   blocks, are pruned the same way, and what survives is verified by exact
   set intersection.  Links are counted where they are found; only counts and
   one edge per member leave a block, never all pairs.
4. Verified links make the final classes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import fresh, mix64, stage, table, text_blocks, text_buffer, word_hashes, word_spans
from opexlens.session import shared_path, stage_scope

SHINGLE = 5
HASHES, ROWS = 128, 4
BANDS, STEP = HASHES // ROWS, 32
BUCKET = 4096
# Members of a group to a chunk, and their shingles in all: a text of a group
# travels once per chunk of the group, so chunks are as large as a task holds.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_A = np.uint64(0x9E3779B97F4A7C15)
_seed = np.random.default_rng(424242)
_MULTIPLY = _seed.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _seed.integers(0, 2**64, HASHES, dtype=np.uint64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After 32, 64, ... equal-or-not comparisons: the fewest matches for
    which P(similarity >= threshold | matches) >= tolerance.  With a uniform
    prior that probability is P(Binomial(n + 1, threshold) <= matches)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b) no step drops."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[left, part] == b[left, part]).sum(axis=1)
        ok = matches >= need
        left, matches = left[ok], matches[ok]
    return left


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in order, start of each text's).  A text
    of one to four words is one shingle; a text without words has none."""
    data, rows = text_buffer(column)
    starts, ends, first = word_spans(data, rows)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(words), np.uint64)
        for j in range(SHINGLE):
            rolling[:max(0, len(words) - j)] += words[j:] * np.uint64(pow(int(_A), j + 1, 2**64))
        rolling = mix64(rolling)
        keep = np.repeat(first[1:], n) - SHINGLE >= np.arange(len(words))
        for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
            value = np.uint64(n[i])
            for w in words[first[i]:first[i + 1]]:
                value = mix64(np.array([value * _A + w]))[0]
            rolling[first[i]], keep[first[i]] = value, True
    counts = np.add.reduceat(np.append(keep, False), first[:-1]) * (n > 0) if len(n) else np.zeros(0, np.int64)
    return rolling[keep], np.append(0, np.cumsum(counts)).astype(np.int64)


def minhash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures (texts x 128, 16 bits each) of texts with shingles."""
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                low = np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], first[:-1][full])
                out[full, k] = (mix64(low + np.uint64(k)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signatures(batches):
    for batch in batches:
        for lo, texts in text_blocks(batch.column("text")):
            values, first = shingles(texts)
            sig = minhash(values, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, len(texts)) for c in ("mid", "doc_id", "h1", "h2")]
                + [pa.array(np.diff(first)), pa.array([row.tobytes() for row in sig], pa.binary())],
                ["mid", "doc_id", "h1", "h2", "n", "sig"])


def _sig_matrix(column: pa.Array) -> np.ndarray:
    """All signatures of a binary column as one matrix."""
    wide = column.cast(pa.binary(2 * HASHES))
    raw = np.frombuffer(wide.buffers()[1], np.uint16)
    return raw[wide.offset * HASHES:(wide.offset + len(wide)) * HASHES].reshape(-1, HASHES)


def _bands(batches):
    for batch in batches:
        if not len(batch):
            continue
        sig = _sig_matrix(batch.column("sig"))
        with np.errstate(over="ignore"):
            keys = mix64(np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS) + np.arange(1, BANDS + 1, dtype=np.uint64) * _A)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["band", "rep"])


def complete_groups(batches, keys: list[str]):
    """Sorted batches -> (table, group starts) with whole groups only."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        new = np.zeros(len(rows), bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield rows.slice(0, last).combine_chunks(), np.append(0, np.flatnonzero(new[:last]))
        held = rows.slice(last)
    if held is not None and len(held):
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _prune(least: list[int]):
    """Sorted bucket rows -> candidate edges.  Round r takes row r of every
    bucket and compares it with the rows after it that no edge of the bucket
    connects to it yet, until the rows left are all connected."""
    def run(batches):
        for rows, head in complete_groups(batches, ["band", "c0", "c1"]):
            rep = rows.column("rep").to_numpy()
            sig = _sig_matrix(rows.column("sig").combine_chunks())
            size, joined, turn = np.diff(np.append(head, len(rep))), np.arange(len(rep)), 0
            live = np.flatnonzero(size > 1)
            while len(live):
                pivot, n = head[live] + turn, size[live] - turn - 1
                start = np.cumsum(n) - n
                other = np.repeat(pivot + 1 - start, n) + np.arange(n.sum())
                one = np.repeat(pivot, n)
                apart = np.flatnonzero(joined[other] != joined[one])
                a, b, found = one[apart], other[apart], []
                for lo in range(0, len(a), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    found.append(survivors(sig[a[part]], sig[b[part]], least) + lo)
                if found:
                    found = np.concatenate(found)
                    a, b = a[found], b[found]
                    to = np.arange(len(rep))
                    to[joined[b]] = joined[a]  # one pivot a bucket: no chains
                    joined = to[joined]
                    linked = rep[a] != rep[b]
                    if linked.any():
                        yield pa.RecordBatch.from_arrays([pa.array(rep[a[linked]]), pa.array(rep[b[linked]])], ["a", "b"])
                mixed = np.logical_or.reduceat(joined[other] != np.repeat(joined[pivot + 1], n), start)
                live, turn = live[mixed], turn + 1
    return run


def _verify(least: list[int], up: int, down: int):
    """Sorted group blocks -> per member its verified links and the smallest
    member it is connected to inside the block.  Threshold: up / down."""
    def block(rep, copies, side, sig, texts, same):
        values, first = shingles(texts)
        doc = np.repeat(np.arange(len(rep)), np.diff(first))
        _, word = np.unique(values, return_inverse=True)
        pairs = np.unique(doc * (int(word.max()) + 1 if len(word) else 1) + word)
        doc, word = np.divmod(pairs, int(word.max()) + 1 if len(word) else 1)
        first = np.searchsorted(doc, np.arange(len(rep) + 1))
        size, mark = np.diff(first), np.zeros(int(word.max()) + 1 if len(word) else 1, bool)
        links, texts_linked, root = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64), np.arange(len(rep))
        right = np.arange(len(rep)) if same else np.flatnonzero(side == 1)
        for i in range(len(rep)) if same else np.flatnonzero(side == 0):
            other = right[right > i] if same else right
            # A set of the other size can reach the threshold at all.
            other = other[(np.minimum(size[other], size[i]) * down >= np.maximum(size[other], size[i]) * up)]
            if not len(other):
                continue
            other = other[survivors(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], least)]
            if not len(other):
                continue
            mark[word[first[i]:first[i + 1]]] = True
            n = size[other]
            at = np.repeat(first[other], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.add.reduceat(mark[word[at]].astype(np.int64), np.cumsum(n) - n)
            mark[word[first[i]:first[i + 1]]] = False
            other = other[common * down >= (n + size[i] - common) * up]
            if len(other):
                links[i] += copies[other].sum()
                texts_linked[i] += len(other)
                links[other] += copies[i]
                texts_linked[other] += 1
                joined = np.unique(root[np.append(other, i)])
                root[np.isin(root, joined)] = joined[0]
        return links, texts_linked, rep[root]

    def run(batches):
        for rows, head in complete_groups(batches, ["root", "c0", "c1"]):
            columns = {c: rows.column(c).to_numpy() for c in ("rep", "copies", "side", "c0", "c1")}
            sig, texts = _sig_matrix(rows.column("sig").combine_chunks()), rows.column("text").combine_chunks()
            out = []
            for a, b in zip(head, np.append(head[1:], len(rows))):
                k = np.unique(columns["rep"][a:b], return_index=True)[1] + a  # by member: the root is the smallest
                links, found, root = block(columns["rep"][k], columns["copies"][k], columns["side"][k], sig[k], texts.take(pa.array(k)), columns["c0"][a] == columns["c1"][a])
                out.append((columns["rep"][k], links, found, root))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "links", "texts", "root"])
    return run


def in_blocks(df: DataFrame, chunks: Column, member: str) -> DataFrame:
    """Rows of each key dealt to its number of ``chunks``, each row once per
    pair (c0, c1) of chunks that its chunk is part of; ``side`` is 0 in c0.
    Keys of one chunk are one block."""
    chunks = F.ceil(chunks).cast("int")
    own = F.pmod(F.xxhash64(member), chunks).cast("int")
    return (df.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .withColumn("c0", F.least("__own", "__other")).withColumn("c1", F.greatest("__own", "__other"))
            .withColumn("side", (F.col("__own") == F.col("c1")).cast("int") * (F.col("c0") != F.col("c1")).cast("int")).drop("__own", "__other"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of the edges
    (a, b).

    Contraction: every node joins the first of its neighbours and itself in
    hash order (a seeded order leaves no long chains), joined nodes become
    one, and the edges between different ones go to the next round, until
    none is left.  A star of any size is gone after two or three rounds."""
    def undirected(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    left = stage(edges.where("a <> b").select(*undirected("a", "b")).distinct(), "cc-edges")
    merged = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))
        up = stage(first.select("node", F.least("m", own)["v"].alias("up")), "cc-up")
        if merged is None:
            merged = up.withColumnRenamed("up", "now")
        else:
            merged = merged.join(up.withColumnRenamed("node", "n"), F.col("now") == F.col("n"), "left") \
                .select("node", F.coalesce("up", "now").alias("now"))
        merged = stage(merged, "cc-merged")
        ends = [up.select(F.col("node").alias(f"n{c}"), F.col("up").alias(f"u{c}")) for c in "ab"]
        left = stage(left.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb"))
                     .where("ua <> ub").select(*undirected("ua", "ub")).distinct(), "cc-edges")
    if merged is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    least = merged.groupBy("now").agg(F.min("node").alias("root"))
    return merged.join(least, "now").select("node", "root")


def text_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", up: int = 4, down: int = 5, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(rows, texts) of the join.

    rows: mid, doc_id, h1, h2, n (shingles) of every row.  texts: one row
    per different text with shingles: rep, h1, h2 (its hashes), least_id
    (smallest id that has it), copies, root (of its connected group), links
    (rows linked to it) and texts (different texts linked), null without links."""
    least = least_matches(up / down, tolerance)
    value = F.coalesce(F.col(text), F.lit(""))
    source = df.select(F.monotonically_increasing_id().alias("mid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), value.alias("text"))
    sigs = stage(source.mapInArrow(_signatures, "mid long, doc_id long, h1 long, h2 long, n long, sig binary"), "near-sigs")
    reps = stage(sigs.where("n > 0").groupBy("h1", "h2").agg(F.min("mid").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"),
                                                             F.first("n").alias("n"), F.first("sig").alias("sig")), "near-texts")

    bands = reps.select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = bands.join(shared, "band").join(reps.select("rep", "sig"), "rep")
    buckets = in_blocks(members, F.col("size") / BUCKET, "rep").select("band", "c0", "c1", "rep", "sig")
    edges = buckets.repartition("band", "c0", "c1").sortWithinPartitions("band", "c0", "c1", "rep").mapInArrow(_prune(least), "a long, b long")
    groups = components(edges)

    found = groups.join(reps.select(F.col("rep").alias("node"), "h1", "h2", "least_id", "copies", "n", "sig"), "node").withColumnRenamed("node", "rep")
    found = stage(found, "near-members")
    sizes = found.groupBy("root").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("chunks"))
    linked = stage(found.join(sizes, "root").drop("n"), "near-groups")
    # One row per text: the one with the smallest id (exact repeats of that
    # row are dropped inside the block).
    texts = source.select("h1", "h2", "doc_id", "text").join(
        linked.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2").hint("merge"),
        (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("doc_id").eqNullSafe(F.col("least_id")))
    blocks = in_blocks(texts.drop("h1", "h2", "g1", "g2", "doc_id", "least_id"), F.col("chunks"), "rep")
    checked = stage(blocks.repartition("root", "c0", "c1").sortWithinPartitions("root", "c0", "c1", "rep")
                    .select("root", "c0", "c1", "side", "rep", "copies", "sig", "text")
                    .mapInArrow(_verify(least, up, down), "rep long, links long, texts long, root long"), "near-links")
    counts = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = components(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.select("rep", "h1", "h2", "least_id", "copies").join(classes.withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("root", F.coalesce("root", "rep")).join(counts, "rep", "left")
    return sigs.drop("sig"), named


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``df``: the id, ``class_id`` (smallest id of its connected
    group of texts of similarity >= up/down), ``n_links`` (other rows linked
    to it directly, copies included), ``n_text_links`` (different texts linked) and
    ``n_copies`` (rows with its text, itself included).

    Texts without words, null ones too, are compared with nothing: each is a
    class of its own without links or copies.  Repeated rows are copies.  Other columns of ``df``
    are not read; an empty table gives no rows.  ``options``: see :func:`text_classes`."""
    rows, named = text_classes(df, id_col, text, **options)
    ids = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = named.join(ids, "root").select("h1", "h2", "class_id", "copies", "links", "texts")
    worded = rows.where("n > 0").select("doc_id", "h1", "h2").join(known, ["h1", "h2"]).select(
        "doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0).cast("long")).alias("n_text_links"), F.col("copies").alias("n_copies"))
    blank = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                       F.lit(0).cast("long").alias("n_text_links"), F.lit(1).cast("long").alias("n_copies"))
    return worded.union(blank).withColumnRenamed("doc_id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class of :func:`near_duplicates`: the one
    with the smallest id (rows without an id come last).  Texts without
    words all stay."""
    spark = df.sparkSession
    path = shared_path(spark, "llm-near-marks")
    with stage_scope(spark):
        rows, named = text_classes(df, id_col, text, **options)
        first = F.min(F.struct(F.col("least_id").isNull().alias("late"), "least_id", "rep")).alias("m")
        groups = named.groupBy("root").agg(first, F.count("*").alias("in_group")).select("root", F.col("m.rep").alias("stays"), "in_group")
        # Only texts with a copy or a link need a mark; of a text that stays,
        # the row with its smallest id stays (repeats: that row's number).
        marks = named.join(groups, "root").where("in_group > 1 OR copies > 1") \
            .select("h1", "h2", "least_id", (F.col("rep") == F.col("stays")).alias("stays"))
        own = rows.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("doc_id").alias("rid"))
        same = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("least_id").eqNullSafe(F.col("rid"))
        marks = marks.join(own, same).groupBy("h1", "h2", "least_id", "stays").agg(F.count("*").alias("repeats"))
        marks = stage(marks, "near-marks", path)
    m1, m2, least, stays, repeats, h1, h2 = fresh(df, "__m1", "__m2", "__least", "__stays", "__repeats", "__h1", "__h2")
    marks = marks.toDF(m1, m2, least, stays, repeats)
    value = F.coalesce(F.col(text), F.lit(""))
    hashed = df.withColumn(h1, F.xxhash64(value)).withColumn(h2, F.xxhash64(F.lit(1), value))
    # Both sides by key at every size: one plan, and no side has a proven bound.
    joined = hashed.join(marks.hint("merge"), (F.col(h1) == F.col(m1)) & (F.col(h2) == F.col(m2)), "left")
    chosen = F.col(stays) & F.col(id_col).cast("long").eqNullSafe(F.col(least))
    out = joined.where(F.col(stays).isNull() | (chosen & (F.col(repeats) == 1)))
    if not marks.where((F.col(repeats) > 1) & F.col(stays)).isEmpty():  # repeated rows: one of each
        out = out.union(joined.where(chosen & (F.col(repeats) > 1)).dropDuplicates([h1, h2]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Every pair of texts that share a shingle, counted, and the closure of the
# links (quadratic in a shingle's texts: for small tables).
OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS tid, text, w, copies, least_id FROM (
    SELECT text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, count(*) AS copies, min(doc_id) AS least_id
    FROM documents WHERE text IS NOT NULL GROUP BY text) WHERE len(w) > 0),
sh AS (SELECT DISTINCT tid, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
    FROM t, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(i)),
n AS (SELECT tid, count(*) AS n FROM sh GROUP BY tid),
near AS (SELECT x, y FROM (SELECT a.tid AS x, b.tid AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.tid <> b.tid GROUP BY a.tid, b.tid)
    JOIN n AS p ON p.tid = x JOIN n AS q ON q.tid = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT tid AS a, tid AS b FROM t UNION SELECT reach.a, near.y FROM reach JOIN near ON near.x = reach.b),
cls AS (SELECT a AS tid, min(least_id) AS class_id FROM reach JOIN t ON t.tid = reach.b GROUP BY a),
lnk AS (SELECT x AS tid, sum(copies) AS links, count(*) AS texts FROM near JOIN t ON t.tid = near.y GROUP BY x)
SELECT d.doc_id, CASE WHEN t.tid IS NULL THEN d.doc_id ELSE class_id END AS class_id,
    CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links,
    CAST(coalesce(copies, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN cls USING (tid) LEFT JOIN lnk USING (tid)
"""
