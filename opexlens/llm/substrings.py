"""Substring dedup by recompression: exact removal of word runs that repeat
across documents.

Each document's word sequence is recompressed in rounds.  A round names runs
of equal symbols (first round) and adjacent pairs (left letter, right letter)
of a seeded split of the alphabet.  A name is a 64-bit fingerprint of what it
stands for, so all tasks agree on names without exchanging a dictionary, and
equal substrings get equal symbols except near their ends.  With every symbol
goes its context: the words that decide it.  A symbol whose context lies in a
window exists in every occurrence of that window.

1. Every window of ``min_words`` words is put under its first such symbol;
   all windows under one occurrence form one row (symbol and context
   fingerprint, fingerprint of all words covered, document, place).  Windows
   without a symbol (inside long runs) go under their own fingerprint.
2. Rows meet by symbol.  A row whose words also occur under the symbol in a
   smaller document is a repeat as a whole.  Where the words around a shared
   symbol differ, the first row of each variant is settled window by window:
   its windows are fingerprinted and meet the others'.
3. Documents drop the words covered by repeated windows.

Fingerprints are compared as pairs of independent 64-bit values.  Rows of a
task (half a million at a time) are reduced before every shuffle: equal ones to
one, and where a symbol has many variants already, all but a few go on to be
settled without meeting under it.  A passage, document or short line in a third
of the corpus thus costs a few rows per symbol and task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opexlens.llm.common import fresh, mix64, stage, table, text_blocks, text_buffer, word_hashes, word_spans

# A row's place: 28 bits of the first window, 14 of the number of windows.
_N_BITS, _START_BITS = 14, 28
# Rows of a symbol in one task from which most are settled directly.
MANY = 16
MEET, AGAIN, SETTLE = 0, 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def n_rounds(min_words: int) -> int:
    """Rounds after which symbols (4/3 longer each) still fit a window with
    their context of about three lengths."""
    return max(0, int(math.log(max(1.0, min_words / 6.5)) / math.log(4 / 3)))


def recompress(words: np.ndarray, first_word: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """(name, context start, context end) of the symbols after ``rounds``.
    ``first_word``: index of each text's first word and, last, the total.  A
    decision that saw the end of a text has a context beyond that end."""
    n = len(words)
    doc = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    name, lo, hi = words.copy(), np.arange(n), np.arange(1, n + 1)
    before, after = first_word[:-1] - 1, first_word[1:] + 1

    def neighbours(at_left: np.ndarray, at_right: np.ndarray, of: np.ndarray):
        """Context start of the left and context end of the right neighbour."""
        left, right = np.maximum(at_left, 0), np.minimum(at_right, len(name) - 1)
        has_left, has_right = (at_left >= 0) & (doc[left] == of), (at_right < len(name)) & (doc[right] == of)
        return np.where(has_left, lo[left], before[of]), np.where(has_right, hi[right], after[of])

    with np.errstate(over="ignore"):
        for k in range(rounds):
            if k == 0:
                head = np.ones(len(name), bool)
                head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(head)
                tail = np.append(head[1:], len(name)) - 1
                length = (tail - head + 1).astype(np.uint64)
                new_lo, new_hi = neighbours(head - 1, tail + 1, doc[head])
                name = np.where(length > 1, mix64(name[head] * _A + length * _B), name[head])
                lo, hi, doc = new_lo, new_hi, doc[head]
            is_right = (mix64(name + np.uint64(0x1234567 * (k + 1))) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(name), bool)
            joins[:-1] = ~is_right[:-1] & is_right[1:] & (doc[1:] == doc[:-1])
            absorbed = np.zeros(len(name), bool)
            absorbed[1:] = joins[:-1]
            at = np.flatnonzero(~absorbed)
            pair, right = joins[at], is_right[at]
            to = np.minimum(at + 1, len(name) - 1)
            left_lo, right_hi = neighbours(at - 1, at + 1, doc[at])
            new_lo = np.where(right, left_lo, lo[at])
            new_hi = np.where(right, hi[at], right_hi)  # of a pair: its right letter's end
            name = np.where(pair, mix64(name[at] * _B + name[to] * _A), name[at])
            lo, hi, doc = new_lo, new_hi, doc[at]
    return name, lo, hi


class _Ranges:
    """Fingerprint of any range of a word sequence, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int):
        steps = np.full(len(words) + 1, base, np.uint64)
        steps[0] = 1
        back = np.full(len(words) + 1, pow(base, -1, 2**64), np.uint64)
        back[0] = 1
        with np.errstate(over="ignore"):
            self.back = np.cumprod(back)
            self.sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * np.cumprod(steps)[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * _B)


def _parse(column: pa.Array):
    data, rows = text_buffer(column)
    starts, ends, first = word_spans(data, rows)
    words = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        return first, words, _Ranges(words, 0x2545F4914F6CDD1D), _Ranges(mix64(words + _A), 0x5851F42D4C957F2D)


def _window_rows(column: pa.Array, size: int, rounds: int):
    """(text index, first window, number of windows, symbol fingerprint,
    fingerprint of the covered words) of every group of windows."""
    first, words, one, two = _parse(column)
    name, lo, hi = recompress(words, first, rounds)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(first[1:][doc] - size >= np.arange(len(words)))
    symbol = np.searchsorted(lo, at, side="left")
    inside = np.minimum(symbol, len(lo) - 1)
    fits = (symbol < len(lo)) & (hi[inside] <= at + size) if len(lo) else np.zeros(len(at), bool)
    with np.errstate(over="ignore"):
        # Windows under one symbol occurrence are neighbours; others group
        # by their own fingerprint while it stays the same (long runs).
        own = one.of(at, at + size)
        group = np.where(fits, symbol.astype(np.uint64), own | np.uint64(1 << 63))
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (doc[at][1:] != doc[at][:-1])
        head = np.flatnonzero(new)
        count, most = np.diff(np.append(head, len(at))), (1 << _N_BITS) - 1
        if (count > most).any():  # more windows than the counter holds: several rows
            new[np.concatenate([np.arange(h, h + c, most) for h, c in zip(head[count > most], count[count > most])])] = True
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(at)))
        start, s, ok = at[head], inside[head], fits[head]
        key = np.where(ok, mix64(one.of(lo[s].clip(0), np.where(ok, hi[s], lo[s].clip(0)).clip(0, len(words))) ^ (name[s] * _A)), mix64(own[head] ^ _B)) if len(lo) else own[head]
        last = start + count - 1 + size
        span = np.where(ok, two.of(start, last), two.of(start, start + size))
    return doc[start], start - first[doc[start]], count, key, span


def _reduce(key: np.ndarray, span: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """True for rows whose (key, span) also comes with a smaller id here."""
    with np.errstate(over="ignore"):
        both = mix64(key + span * _B)
    order = np.argsort(both, kind="stable")
    head = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1])) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc_id[order], head) if len(head) else doc_id
    out = np.zeros(len(key), bool)
    out[order] = doc_id[order] > np.repeat(least, np.diff(np.append(head, len(order))))
    return out


def _crowded(key: np.ndarray, span: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """True for rows of symbols that have many rows, several documents and
    several variants here, but for those of the least and largest document and
    variant: they stay to show the others that the symbol is shared."""
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
    out = np.zeros(len(key), bool)
    size = np.diff(np.append(head, len(order)))
    for a, n in zip(head[size >= MANY], size[size >= MANY]):
        rows = order[a:a + n]
        ends = [f(v[rows]) for v in (doc_id, span) for f in (np.argmin, np.argmax)]
        if doc_id[rows[ends[0]]] < doc_id[rows[ends[1]]] and span[rows[ends[2]]] != span[rows[ends[3]]]:
            out[rows] = True
            out[rows[ends]] = False
    return out


_ROW = "key long, span long, doc_id long, tag long, place long, state int"


_FLUSH = 1 << 19  # rows gathered over batches before they are reduced


def _batch(parts: list, meeting: bool) -> pa.RecordBatch:
    doc_id, tag, start, count, key, span = (np.concatenate(x) for x in zip(*parts))
    state = np.where(_reduce(key, span, doc_id), AGAIN, MEET).astype(np.int32)
    if meeting:
        left = np.flatnonzero(state == MEET)
        state[left[_crowded(key[left], span[left], doc_id[left])]] = SETTLE
    place = (start << _N_BITS) | count
    with np.errstate(over="ignore"):  # rows that meet no others only pass through: spread them
        key = np.where(state != MEET, mix64(place.astype(np.uint64) + doc_id.astype(np.uint64) * _A + tag.astype(np.uint64) * _B), key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc_id), pa.array(tag), pa.array(place), pa.array(state)],
        ["key", "span", "doc_id", "tag", "place", "state"])


def _reduced(parts, meeting: bool):
    """Gathers the parts of several batches, so that reduction pays."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= _FLUSH:
            yield _batch(held, meeting)
            held, rows = [], 0
    if held:
        yield _batch(held, meeting)


def _symbols(size: int, rounds: int):
    def parts(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for lo, texts in text_blocks(batch.column("text")):
                row, start, count, key, span = _window_rows(texts, size, rounds)
                yield ids[row + lo], tags[row + lo], start, count, key, span

    def run(batches):
        yield from _reduced(parts(batches), True)
    return run


def _windows(size: int):
    """Documents with the places to settle -> one row per window there."""
    def parts(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags, places = batch.column("tag").to_numpy(zero_copy_only=False), batch.column("places")
            for lo, texts in text_blocks(batch.column("text")):
                first, _, one, two = _parse(texts)
                for i in range(len(texts)):
                    place = places[lo + i].values.to_numpy(zero_copy_only=False)
                    count = place & ((1 << _N_BITS) - 1)
                    start = np.repeat((place >> _N_BITS) & ((1 << _START_BITS) - 1), count)
                    start = start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                    at = start + first[i]
                    yield (np.full(len(at), ids[lo + i]), np.full(len(at), tags[lo + i]), start, np.ones(len(at), np.int64),
                           one.of(at, at + size), two.of(at, at + size))

    def run(batches):
        yield from _reduced(parts(batches), False)
    return run


def _drop(size: int, schema_names: list[str], text_at: int):
    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(schema_names))]
            kept, totals, removed = [], [], []
            for text, places in zip(columns[text_at], batch.column(len(schema_names))):
                words = (text.as_py() or "").encode().split()  # bytes split on ASCII white space only
                totals.append(len(words))
                if places.as_py():
                    place = places.values.to_numpy(zero_copy_only=False)
                    start = (place >> _N_BITS) & ((1 << _START_BITS) - 1)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + (place & ((1 << _N_BITS) - 1)) - 1 + size, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered) if not c]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                schema_names + ["kept_text", "n_words", "n_removed"])
    return run


def repeated_places(df: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, tag, places): per document the packed ranges of windows that
    also start in a document with a smaller id.  ``df``: doc_id, text, tag."""
    known = df.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = known.mapInArrow(_symbols(min_words, n_rounds(min_words)), _ROW)
    by_key, by_span = Window.partitionBy("key"), Window.partitionBy("key", "span")
    met = (rows.withColumn("lo", F.min("doc_id").over(by_key)).withColumn("hi", F.max("doc_id").over(by_key))
           .withColumn("s0", F.min("span").over(by_key)).withColumn("s1", F.max("span").over(by_key))
           .where(f"state <> {MEET} OR lo < hi").withColumn("first", F.min("doc_id").over(by_span))
           .withColumn("again", (F.col("state") == AGAIN) | ((F.col("state") == MEET) & (F.col("doc_id") > F.col("first"))))
           .where(f"again OR state = {SETTLE} OR s0 < s1").select("doc_id", "tag", "place", "again"))
    met = stage(met, "substr-met")
    open_places = met.where("NOT again").groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))
    windows = known.join(open_places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places").mapInArrow(_windows(min_words), _ROW)
    settled = (windows.withColumn("first", F.min("doc_id").over(by_span))
               .where(f"state = {AGAIN} OR doc_id > first").select("doc_id", "tag", "place"))
    settled = stage(settled, "substr-settled")
    return (met.where("again").select("doc_id", "tag", "place").union(settled)
            .groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places")))


def remove_repeats(df: DataFrame, min_words: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` plus kept_text (kept words joined by one space), n_words and
    n_removed.  Every word covered by a window of ``min_words`` words that
    also starts in a document with a smaller id is removed; windows are those
    of the input.

    Null texts are empty.  Rows with a null id lose nothing and repeat
    nothing; rows with one id never remove words from each other, and are told
    apart by the 64-bit hash of their texts (equal ones fare alike).  Texts may
    be of any length up to 2^28 words; an empty table gives no rows.  Columns
    of the new names are replaced."""
    df = df.drop("kept_text", "n_words", "n_removed")
    tag, key, places = fresh(df, "__tag", "__key", "__places")
    tagged = df.withColumn(tag, F.xxhash64(text)).withColumn(key, F.col(id_col).cast("long"))
    found = repeated_places(tagged.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(tag).alias("tag")), min_words)
    found = found.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("places").alias(places))
    joined = tagged.join(found, [key, tag], "left").select(*[F.col(f"`{c}`") for c in df.columns], places)
    added = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(_drop(min_words, df.columns, df.columns.index(text)), T.StructType(df.schema.fields + added))


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT id, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
        FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
cover AS (SELECT DISTINCT id, i + j AS k FROM win JOIN firsts USING (g), generate_series(0, 49) AS s(j) WHERE m < doc_id),
word AS (SELECT id, unnest(generate_series(1, len(w))) AS k, unnest(w) AS word FROM d),
kept AS (SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN cover USING (id, k) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (id)
"""
