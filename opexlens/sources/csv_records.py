"""Records of CSV text whose quoted cells hold line feeds, found in parallel.

A text file is read in stretches (Spark's file splits), line by line, so the
open question is only which line feeds lie inside quotes.  Every line maps the
state at its start (outside or inside a quoted cell) to the state at its end;
such maps compose, so one narrow pass folds each stretch into one map, the maps
are composed along each file, and a second pass, now knowing the state at the
start of its stretch, joins lines into records.  Pieces of records that cross a
boundary (two a stretch at most) are put together afterwards.
"""

from __future__ import annotations

import csv as pycsv
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# What a line does: cells that close, then one that stays open at its end.
_CLOSED = r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+'
_OPEN_END = _CLOSED + r'"(?:[^"]|"")*+$'
_INSIDE = r'^(?:[^"]|"")*+'
OUT_TO_IN = "(?s)^" + _OPEN_END
IN_TO_IN = "(?s)" + _INSIDE + r'(?:$|"[^,]*+,' + _OPEN_END + ")"
# Maps of {outside, inside}: bit 0 is the end state from outside, bit 1 from inside.
_PARSE = {"escape": '"', "mode": "PERMISSIVE"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start of its stretch, map).  Lines end at line feeds; a
    carriage return before one stays on the line."""
    line = F.col("value")
    code = F.when(~F.contains(line, F.lit('"')), 2).otherwise(
        line.rlike(OUT_TO_IN).cast("int") + 2 * line.rlike(IN_TO_IN).cast("int"))
    return spark.read.option("lineSep", "\n").text(path).select(
        line.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), code.cast("byte").alias("code"))


def states(code: np.ndarray, first: int) -> np.ndarray:
    """State before each line and after the last one (len + 1 entries): the
    last constant map decides, flipped once by every swap since."""
    value = np.append(first, code & 1)                   # of a constant map, or the start
    fixed = np.append(True, (code == 0) | (code == 3))
    swaps = np.cumsum(np.append(0, code == 1))
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), 0))
    return value[last] ^ ((swaps - swaps[last]) & 1)


def _runs(file: pa.Array, start: np.ndarray):
    """(from, to) of neighbouring rows of one stretch."""
    files = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.flatnonzero((np.diff(start) != 0) | (np.diff(files) != 0)) + 1
    return zip(np.append(0, new), np.append(new, len(start)))


def _fold(batches):
    """Arrow step: rows (file, start, code) -> one map per stretch and batch."""
    for batch in batches:
        start, code = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        rows = [(batch.column(0)[a].as_py(), int(start[a]), int(states(code[a:b], 0)[-1] | states(code[a:b], 1)[-1] << 1))
                for a, b in _runs(batch.column(0), start) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "code"])


def stretch_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): the state at the start of every stretch.  One
    row a split of the input, whatever its size."""
    parts = lines.select("file", "start", "code").mapInArrow(_fold, "file string, start long, code long") \
        .withColumn("n", F.monotonically_increasing_id())  # batches of a stretch stay in order
    order = Window.partitionBy("file").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("code").isin(0, 3)
    swaps = F.coalesce(F.sum(F.when(F.col("code") == 1, 1).otherwise(0)).over(order), F.lit(0))
    last = F.last(F.when(constant, F.struct((F.col("code").bitwiseAND(1)).alias("value"), F.col("swaps_before").alias("swaps"))), ignorenulls=True).over(order)
    folded = parts.withColumn("swaps_before", swaps).withColumn("fixed", last)
    inside = F.pmod(F.coalesce("fixed.value", F.lit(0)) + F.col("swaps_before") - F.coalesce("fixed.swaps", F.lit(0)), F.lit(2))
    first = Window.partitionBy("file", "start").orderBy("n")
    return folded.withColumn("inside", inside).withColumn("k", F.row_number().over(first)).where("k = 1").select("file", "start", F.col("inside").cast("int").alias("inside"))


def _join_lines(batches):
    """Arrow step: (line, file, start, code, inside) -> records and pieces:
    file, start, seq, part, record.  Parts: 0 whole, 1 begins here and goes on
    in the next stretch, 2 goes on from the one before."""
    key, seq, state, held, part = None, 0, 0, [], 0   # held: joined lines of the record that is open

    def rows(seqs, kind, records):
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], np.int64)), pa.array(np.asarray(seqs, np.int64)),
                                           pa.array(np.full(n, kind, np.int32)), pa.array(records, pa.string())], ["file", "start", "seq", "part", "record"])

    def close(kind, text):
        """The record that was open when a run of lines began."""
        nonlocal seq, held, part
        held, part = [], 0
        if kind != 0 or text.strip():
            seq += kind != 2
            yield rows([-1 if kind == 2 else seq - 1], kind, [text])

    for batch in batches:
        start, code, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for a, b in _runs(batch.column(1), start):
            if a == b:
                continue
            here = (batch.column(1)[int(a)].as_py(), int(start[a]))
            if here != key:
                if held:
                    yield from close(2 if part == 2 else 1, "\n".join(held))
                key, seq, state = here, 0, int(inside[a])
                part = 2 if state else 0
            lines = batch.column(0).slice(a, b - a)
            after = states(code[a:b], state)[1:]
            state, ends = int(after[-1]), np.flatnonzero(after == 0) + 1
            if (held or part) and len(ends):     # the open record ends in this run
                text = "\n".join([*held, *lines.slice(0, ends[0]).to_pylist()])
                yield from close(part, text)
                lines, ends = lines.slice(ends[0]), ends[1:] - ends[0]
            if len(ends):                        # records that lie in this run as a whole
                last = int(ends[-1])
                records = lines.slice(0, last)
                if len(ends) < last:
                    offsets = pa.array(np.append(0, ends).astype(np.int32))
                    records = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays([records])), "\n")
                bare = pc.equal(pc.utf8_trim_whitespace(records), "")
                if pc.any(bare).as_py():
                    records = records.filter(pc.invert(bare))
                if len(records):
                    yield rows(seq + np.arange(len(records)), 0, records)
                    seq += len(records)
                lines = lines.slice(last)
            held += ["\n".join(lines.to_pylist())] if len(lines) else []
    if held:
        yield from close(2 if part == 2 else 1, "\n".join(held))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, seq, record): every record of the files, blank ones left
    out, in order of (start, seq) within a file; written once."""
    lines = _lines(spark, path)
    # One row a split, so it may be broadcast: 800,000 rows for 100 TB.
    inside = F.broadcast(cut_lineage(stretch_states(lines), "csv-states"))
    pieces = cut_lineage(lines.join(inside, ["file", "start"]).select("line", "file", "start", "code", "inside")
                         .mapInArrow(_join_lines, "file string, start long, seq long, part int, record string"), "csv-records")
    order = Window.partitionBy("file").orderBy("start", "seq")
    parts = pieces.where("part > 0").withColumn("no", F.sum((F.col("part") == 1).cast("int")).over(order)).groupBy("file", "no") \
        .agg(F.sort_array(F.collect_list(F.struct("start", "seq", "record"))).alias("p"))
    crossing = parts.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    records = pieces.where("part = 0").select("file", "start", "seq", "record").union(crossing)
    return records.withColumn("record", F.regexp_replace("record", r"\r$", "")).where(F.trim("record") != "")


def column_names(header: str) -> list[str]:
    """Cells of a header record as Spark's reader names them: empty ones by
    position, repeated ones (case-blind) with their position behind."""
    cells = next(pycsv.reader([header.lstrip("﻿")], strict=False), [])
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """All cells as text; files are grouped by their header record and the
    groups united by column name.  None if there is no record at all.  The
    different headers are read on the driver (they define the columns)."""
    records = csv_records(spark, path)
    heads = cut_lineage(records.where("seq = 0").groupBy("file").agg(F.min(F.struct("start", "seq", "record")).alias("h"))
                        .select("file", F.col("h.start").alias("h_start"), F.col("h.record").alias("header")), "csv-headers")
    groups = [r.header for r in heads.select("header").distinct().orderBy("header").collect()]
    if not groups:
        return None
    body = records.join(heads, "file").where(~((F.col("start") == F.col("h_start")) & (F.col("seq") == 0)))
    parts = []
    for header in groups:
        names = column_names(header)
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        mine = body if len(groups) == 1 else body.where(F.col("header") == header)
        parts.append(mine.select(F.from_csv("record", schema, _PARSE).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
