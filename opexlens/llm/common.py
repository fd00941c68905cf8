"""Shared helpers: written stages, seeded permutations, hypergeometric draws
and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import os
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opexlens.session import shared_path

# Word characters of every operator: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
# Settings of the jobs that write a stage: shuffle files go when the table is
# written; Arrow batches stay small, as texts may be long.
STAGE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case-blind)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the jobs inside the block only."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared checkpoint folder and
    read it back (``zstd`` for whole texts: a third less disk for more CPU).  Cuts the lineage (a lost executor costs a re-read), and the
    job's shuffle files are released as soon as the table is written.  A
    ``path`` taken before a ``stage_scope`` outlives that scope."""
    spark = df.sparkSession
    path = path or shared_path(spark, f"llm-{name}")
    with settings(spark, **STAGE_SETTINGS):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_stage(*frames: DataFrame) -> None:
    """Delete written stages that no later DataFrame reads any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside one expression
    (Catalyst would otherwise repeat it for every use in a lambda)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


# -- seeded draws -----------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the key's permutation of 0..n-1 sends x, row by row (a balanced
    Feistel network on the next even power of two, walked until below n)."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (x, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k, v = half[todo], mask[todo], key[todo], out[todo]
            left, right = v >> h, v & m
            for r in range(4):
                left, right = right, left ^ (mix64(right + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & m)
            out[todo] = v = (left << h) | right
            todo = todo[v >= n[todo]]
    return out.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy's exact draw up to its limit of 10^9; above it the normal limit
    of the same law, held to the possible values."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    total = good + bad
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    return int(min(good, draws, max(0, draws - bad, round(rng.normal(draws * good / total, sd)))))


def multi_hypergeometric(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of each kind ``draws`` items without replacement hold."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(int(c) for c in counts):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, draws)
        draws -= out[i]
    return out


def communication_matrix(rows: np.ndarray, cols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts with the given row and column sums, distributed as the
    contingency table of a uniform random assignment."""
    left, out = np.array(cols, np.int64), np.zeros((len(rows), len(cols)), np.int64)
    for i, n in enumerate(rows):
        out[i] = multi_hypergeometric(rng, left, int(n))
        left -= out[i]
    return out


# -- Arrow text buffers -----------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64) - int(off[0])


def word_spans(data: np.ndarray, rows: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word and, per row, the index of its
    first word (one more entry closes the last row).  ``breaks`` marks the
    bytes between words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    word = ~breaks[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, rows)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random byte values, from
    prefix sums, segment by segment.  ``lower`` folds ASCII capitals."""
    out = np.zeros(len(starts), np.uint64)
    values = _LOWER if lower else _BYTE
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _SEGMENT, _SEGMENT))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            lo, hi = int(starts[a]), int(ends[b - 1])
            up, down = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[data[lo:hi]] * up[:hi - lo], out=sums[1:])
            s = starts[a:b] - lo
            out[a:b] = (sums[ends[a:b] - lo] - sums[s]) * down[s]
        return mix64(out)


def text_blocks(batch_column: pa.Array, max_bytes: int = 4 << 20):
    """Slices (first row, slice) of a text column of about ``max_bytes``
    each, so that work on an Arrow batch stays within bounded memory."""
    column = pc.fill_null(batch_column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + max_bytes, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def env_path(name: str, default: str) -> str:
    return os.environ.get(name) or default
