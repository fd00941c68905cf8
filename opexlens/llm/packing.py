"""Packing by cutting-stock column generation.

Documents become token ids; every full ``width`` ids is a sequence of its
own, and the remainders (1 to width - 1 ids) are the items of a cutting-stock
problem.  Its input is the histogram of remainder lengths: at most width - 1
numbers whatever the corpus.  The driver solves the linear program over
columns: a multiset of lengths that fits one sequence, filled up, where it
does not fit exactly, by a piece cut from one more item, whose rest is an item
again (of a shorter length, with its own row in the program).  A knapsack
dynamic program over the current prices finds the next columns and their cuts.
Column counts are rounded down, and documents, ranked within their length, are
dealt to column slots by arithmetic on the rank: a cut item's rest gets a
rank among the items of its length, and so on until it is placed.  Only what
rounding leaves over is laid end to end and cut at the sequence width, so
nothing but the very last sequence is padded.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opexlens.llm.common import partitions, stage, table

WIDTH = 1024
END_ID = 0


# -- the linear program (driver, at most width - 1 lengths) -----------------

def _knapsack(lengths: np.ndarray, prices: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for every capacity the best value and the item to
    take next (-1: leave one unit empty)."""
    value, pick = np.zeros(width + 1), np.full(width + 1, -1)
    fits = np.searchsorted(lengths, np.arange(width + 1), side="right")
    for c in range(1, width + 1):
        value[c] = value[c - 1]
        if fits[c]:
            got = value[c - lengths[:fits[c]]] + prices[:fits[c]]
            k = got.argmax()
            if got[k] > value[c] + 1e-12:
                value[c], pick[c] = got[k], k
    return value, pick


def _pattern(first: int, lengths: np.ndarray, pick: np.ndarray, width: int) -> dict[int, int]:
    """The best pattern that holds the item ``first``."""
    items, c = {first: 1}, width - int(lengths[first])
    while c > 0:
        k = int(pick[c])
        if k < 0:
            c -= 1
            continue
        items[k] = items.get(k, 0) + 1
        c -= int(lengths[k])
    return items


# A column: {index of length: copies} and the cut (index of the length that
# is cut, ids taken from it) or None.
Column = tuple[dict[int, int], tuple[int, int] | None]


def _net(column: Column) -> dict[int, int]:
    """Items used up per length; a cut uses one and gives its rest back.
    Length l has index l - 1."""
    items, cut = column
    net = dict(items)
    if cut:
        net[cut[0]] = net.get(cut[0], 0) + 1
        rest = cut[0] - cut[1]
        net[rest] = net.get(rest, 0) - 1
    return net


def _filled(column: Column) -> int:
    items, cut = column
    return sum((i + 1) * n for i, n in items.items()) + (cut[1] if cut else 0)


def _first_basis(demand: np.ndarray, width: int) -> tuple[list[Column], np.ndarray]:
    """A feasible basis and its amounts: the longest length left, its sequence filled as far
    as possible with lengths left and then by a cut of another, as often as the
    scarcest of them allows.  Every column uses up one length (its row) and
    touches only rows still open, so the basis is triangular."""
    m = len(demand)
    columns: list = [None] * m
    left, closed, amounts = demand.astype(float), np.zeros(m, bool), np.zeros(m)
    while True:
        rest = np.flatnonzero((left > 1e-9) & ~closed)
        if not len(rest):
            break
        first = int(rest[-1])
        lengths = rest + 1
        _, pick = _knapsack(lengths, lengths.astype(float) * (1 + 1e-6 * np.arange(len(rest)) / len(rest)), width - first - 1)
        items = {int(rest[k]): n for k, n in _pattern(len(rest) - 1, lengths, pick, width).items()}
        room, cut = width - _filled((items, None)), None
        if room:
            # The most frequent open length that leaves an open rest.
            fit = [i for i in rest if i + 1 > room and not closed[i - room] and i - room not in items]
            if fit:
                cut = (int(max(fit, key=lambda i: left[i])), room)
        net = _net((items, cut))
        used = {i: n for i, n in net.items() if n > 0}
        row = min(used, key=lambda i: left[i] / used[i])
        step = left[row] / used[row]
        for i, n in net.items():
            left[i] -= step * n
        columns[row], closed[row], left[row], amounts[row] = (items, cut), True, 0, step
    for i in range(m):
        if columns[i] is None:
            columns[i] = ({i: width // (i + 1)}, None)
    return columns, amounts


def _offers(guide: np.ndarray, width: int, n: int) -> list[Column]:
    """The best columns at these prices: around every length the best
    multiset, and for every length the best cut of it."""
    m = len(guide)
    lengths = np.arange(1, m + 1)
    value, pick = _knapsack(lengths, guide, width)
    whole = guide + value[width - lengths]
    # Cutting a ids off length r: value[width - a] + guide[r] - guide[r - a].
    cuts = np.full(m, -np.inf)
    at = np.zeros(m, np.int64)
    for r in range(2, m + 1):
        a = np.arange(1, r)
        got = value[width - a] + guide[r - 1] - guide[r - a - 1]
        at[r - 1] = a[got.argmax()]
        cuts[r - 1] = got.max()
    out: list[tuple[float, Column]] = []
    for i in np.argsort(-whole, kind="stable")[:n]:
        out.append((whole[i], (_pattern(int(i), lengths, pick, width), None)))
    for i in np.argsort(-cuts, kind="stable")[:n]:
        if cuts[i] > -np.inf:
            items, c = {}, width - int(at[i])
            while c > 0:
                k = int(pick[c])
                if k < 0:
                    c -= 1
                    continue
                items[k] = items.get(k, 0) + 1
                c -= k + 1
            out.append((cuts[i], (items, (int(i), int(at[i])))))
    return [c for _, c in sorted(out, key=lambda x: -x[0])]


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, width: int, gap: float = 0.0001, rounds: int = 60,
                   per_round: int = 24) -> list[tuple[Column, float]]:
    """[(column, how often)] for items of the given lengths: the fractional
    optimum to within ``gap`` of the bound tokens / width, or the best after
    ``rounds`` pricings.

    Revised simplex over columns priced by the knapsack program.  Prices are
    smoothed towards length / width, the prices of a perfect packing, and one
    pricing offers the best columns around several items."""
    m = int(max(lengths, default=0))
    wanted = np.zeros(m)
    wanted[np.asarray(lengths, np.int64) - 1] = demand
    columns, amounts = _first_basis(wanted, width)
    bound, centre, trust = float(demand @ lengths) / width, np.arange(1, m + 1) / width, 0.9
    if amounts.sum() > bound * (1 + gap):
        inverse = np.zeros((m, m))
        for i, column in enumerate(columns):
            for k, n in _net(column).items():
                inverse[k, i] = n
        inverse = np.linalg.inv(inverse)
        amounts = np.maximum(inverse @ wanted, 0)
    for _ in range(rounds):
        if amounts.sum() <= bound * (1 + gap):
            break
        prices = np.maximum(inverse.sum(axis=0), 0)
        entered = 0
        for column in _offers(trust * centre + (1 - trust) * prices, width, 2 * per_round):
            net = _net(column)
            idx, n = np.fromiter(net, np.int64), np.fromiter(net.values(), np.float64)
            if n @ inverse.sum(axis=0)[idx] <= 1 + 1e-7:
                continue
            entering = inverse[:, idx] @ n
            usable = entering > 1e-9
            if not usable.any():
                continue
            ratios = np.where(usable, amounts / np.where(usable, entering, 1), np.inf)
            out = int(ratios.argmin())
            pivot = inverse[out] / entering[out]
            inverse -= np.outer(entering, pivot)
            inverse[out] = pivot
            step = ratios[out]
            amounts = np.maximum(amounts - step * entering, 0)
            amounts[out] = step
            columns[out] = column
            entered += 1
            if entered == per_round:
                break
        if not entered:
            if trust < 0.01:
                break
            trust /= 2
    return [(c, float(x)) for c, x in zip(columns, amounts) if x > 1e-9]


def rounded(columns: list[tuple[Column, float]], demand: np.ndarray, width: int) -> list[tuple[Column, int]]:
    """Whole numbers of the columns that fill their sequence, none of them
    using more items of a length than there are or are left by cuts."""
    chosen = [(c, int(x + 1e-6)) for c, x in sorted(columns, key=lambda p: (sorted(p[0][0].items()), p[0][1] or ())) if _filled(c) == width]
    times = np.array([t for _, t in chosen], np.int64)
    net = np.zeros((len(demand), len(chosen)), np.int64)
    for j, (c, _) in enumerate(chosen):
        for i, n in _net(c).items():
            net[i, j] = n
    while len(times):
        short = net @ times - demand
        i = int(short.argmax())
        if short[i] <= 0:
            break
        users = np.flatnonzero((net[i] > 0) & (times > 0))
        j = int(users[times[users].argmax()])
        times[j] -= min(int(times[j]), -(-int(short[i]) // int(net[i, j])))
    return [(c, int(t)) for (c, _), t in zip(chosen, times) if t > 0]


def slots(histogram: dict[int, int], width: int = WIDTH) -> tuple[dict[int, tuple], int, int, float]:
    """(per length: its slots, first rank and first position in the end-to-end
    stream; number of column sequences; stream length; share of the remainders'
    ids that columns place).

    Slots are rows (first rank, copies, times, first sequence, offset, ids
    placed, first rank of the rests or -1).  The ranks of a length are its
    documents first, then the rests that cuts leave, longest lengths first."""
    m = max(histogram, default=0)
    demand = np.zeros(m, np.int64)
    for r, n in histogram.items():
        demand[r - 1] = n
    lengths = np.flatnonzero(demand) + 1
    columns = rounded(solve_patterns(lengths, demand[lengths - 1], width), demand, width) if m else []
    sequence, firsts = 0, []
    total = demand.copy()  # items of each length, with the rests of cuts
    rests: dict[int, int] = {}
    for j, ((_, cut), times) in enumerate(columns):
        firsts.append(sequence)
        sequence += times
        if cut:
            rest = cut[0] - cut[1]
            rests[j] = int(total[rest])
            total[rest] += times
    next_rank, rows = np.zeros(m, np.int64), [[] for _ in range(m)]
    for j, ((items, cut), times) in enumerate(columns):
        offset = 0
        for i, n in sorted(items.items()):
            rows[i].append((int(next_rank[i]), n, times, firsts[j], offset, i + 1, -1))
            next_rank[i] += n * times
            offset += n * (i + 1)
        if cut:
            rows[cut[0]].append((int(next_rank[cut[0]]), 1, times, firsts[j], offset, cut[1], rests[j]))
            next_rank[cut[0]] += times
    out, position = {}, 0
    for i in range(m):
        if total[i]:
            out[i + 1] = (np.array(rows[i], np.int64).reshape(-1, 7), int(next_rank[i]), position)
            position += (int(total[i]) - int(next_rank[i])) * (i + 1)
    ids = int((demand * np.arange(1, m + 1)).sum())
    return out, sequence, position, 1 - position / ids if ids else 1.0


# -- tokens -----------------------------------------------------------------

def load_encoder(vocabulary: str):
    """encode(text) -> ids of the byte-level BPE in the ``tokenizers`` file.
    The same vocabulary's rank table is read with tiktoken, about five times
    faster; texts that spell a special token go through ``tokenizers``."""
    import tiktoken
    from tokenizers import Tokenizer
    from public_tokenizers import PATTERN
    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)
    return encode


def _tokenize(vocabulary: str, end_id: int, keep: list[str]):
    def run(batches):
        encode = load_encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            out, counts, held, first = [], [], 0, 0
            for i, text in enumerate(texts):
                got = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                if got.max() < 65536:  # two bytes an id when they fit
                    out.append(got.astype("<u2").tobytes())
                else:
                    out.append(got.tobytes())
                counts.append(len(got))
                held += len(out[-1])
                if held > 8 << 20 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(first, len(out)) for c in keep] + [pa.array(counts, pa.int64()), pa.array(out, pa.binary())],
                        keep + ["n", "ids"])
                    first, out, counts, held = i + 1, [], [], 0
    return run


def _emit(layout: dict, full_first: dict, stream_first: int, width: int, keep: list[str]):
    """Arrow step: token rows with their rank -> pieces."""
    def run(batches):
        for pdf in batches:
            out = []
            for *key, n, ids, rank, full in zip(*[pdf[c] for c in keep], pdf["n"], pdf["ids"], pdf["rank"], pdf["full"]):
                tokens = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                whole, rest = divmod(int(n), width)
                full = int(full)
                for k in range(whole):
                    out.append((*key, k * width, width, zlib.crc32(tokens[k * width:(k + 1) * width].tobytes()), n, full_first[rest] + full + k, 0))
                if not rest:
                    continue
                at, rank = whole * width, int(rank)
                while rest:
                    rows, left_rank, position = layout[rest]
                    if rank >= left_rank:  # rounding's residue, end to end
                        p = position + (rank - left_rank) * rest
                        while rest:
                            piece = min(rest, width - p % width)
                            out.append((*key, at, piece, zlib.crc32(tokens[at:at + piece].tobytes()), n, stream_first + p // width, p % width))
                            at, p, rest = at + piece, p + piece, rest - piece
                        break
                    i = int(np.searchsorted(rows[:, 0], rank, side="right")) - 1
                    first, copies, times, sequence, offset, piece, rests = (int(v) for v in rows[i])
                    copy, turn = divmod(rank - first, times)
                    out.append((*key, at, piece, zlib.crc32(tokens[at:at + piece].tobytes()), n, sequence + turn, offset + copy * piece))
                    at, rest, rank = at + piece, rest - piece, rests + turn
            yield pd.DataFrame(out, columns=[*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(df: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None, width: int = WIDTH, end_id: int = END_ID,
         carry: list[str] | None = None) -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, then the columns named in ``carry``.
    Other columns of ``df`` are not read.

    Null and empty texts are one end id.  Repeated rows are packed each; an
    empty table gives no rows; a text of any length is tokenised as one.
    ``vocabulary`` is the tokenizer file.  The share of remainders that columns
    place is what ``slots`` returns for the histogram."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    spark, kept = df.sparkSession, {f"k{i}": c for i, c in enumerate([id_col, *(carry or [])])}
    fields = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in kept.items())
    source = df.select("text", F.monotonically_increasing_id().alias("mid"), *[F.col(f"`{c}`").alias(k) for k, c in kept.items()])
    tokens = stage(source.mapInArrow(_tokenize(vocabulary, end_id, ["mid", *kept]), f"mid long, {fields}, n long, ids binary"), "pack-ids")

    # Rank of each document within its remainder length, and the full
    # sequences before it.  A length may hold a third of all rows, so ranks
    # are counted in salted runs and shifted by the runs before.
    salted = tokens.select("mid", (F.col("n") % width).alias("rest"), F.floor(F.col("n") / width).alias("whole"),
                           F.pmod(F.xxhash64("mid"), F.lit(partitions(spark))).alias("salt"))
    runs = stage(salted.groupBy("rest", "salt").agg(F.count("*").alias("c"), F.sum("whole").alias("w")), "pack-runs")
    histogram = {int(r["rest"]): (int(r["c"]), int(r["w"])) for r in runs.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).collect()}
    layout, n_patterns, stream, _ = slots({r: c for r, (c, _) in histogram.items() if r}, width)
    full_first, at = {}, n_patterns + -(-stream // width)
    for r in sorted(histogram):
        full_first[r] = at
        at += histogram[r][1]

    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("rest", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("rest", "salt").orderBy("mid")
    ranks = (salted.withColumn("r0", F.row_number().over(inside) - 1)
             .withColumn("f0", F.sum("whole").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
             .join(shifts, ["rest", "salt"])
             .select("mid", (F.col("r0") + F.col("c0")).alias("rank"), (F.col("f0") + F.col("w0")).alias("full")))
    values = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = tokens.join(ranks, "mid").mapInPandas(
        _emit(layout, full_first, n_patterns, width, list(kept)), f"{fields}, " + ", ".join(f"{v} long" for v in values))
    return pieces.select(F.col("k0").alias(id_col), *values, *[F.col(k).alias(c) for k, c in list(kept.items())[1:]])


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
