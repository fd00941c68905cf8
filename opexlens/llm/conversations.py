"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation's rows, in order of their turns, are edited at least cost so
that the role initials read ``(s?(ua)+)?``: rows are kept, given another role
or deleted, and empty user or assistant rows inserted.  The search holds one
surviving edit sequence per state (nothing yet, after system, user, assistant)
in a tree of back pointers.  Nodes count their references; as soon as all
survivors share an ancestor, the edits up to it are final and leave, so memory
holds the unresolved edits only, however long the conversation is.  Sequences
of equal cost are told apart by their complete unresolved edits (the least in
ASCII order survives).

Spark sorts each conversation's rows into one partition and streams them; the
duplicates are settled before by an aggregate over (conversation, role, text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opexlens.llm.common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
# Where an initial leads from a state; user and assistant may be made up.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MADE = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = frozenset(("su", "ua", "au"))
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


class _Node:
    """One edit of the tree: its parent, the edits after it, and whether a
    survivor ends here."""
    __slots__ = ("parent", "edit", "role", "text", "after", "ends", "depth")

    def __init__(self, parent, edit, role, text):
        self.parent, self.edit, self.role, self.text = parent, edit, role, text
        self.after, self.ends = {}, 0
        self.depth = parent.depth + 1 if parent else 0


def _less(a: _Node, b: _Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b``, compared
    from their last common edit on (all earlier ones are equal)."""
    ea = eb = ""
    while a is not b:
        if a.depth >= b.depth:
            ea, step = a.edit, a.parent
            if b.depth == a.depth:
                eb, b = b.edit, b.parent
            a = step
        else:
            eb, b = b.edit, b.parent
    return ea < eb


class Repair:
    """Edits of one conversation, row by row: ``row`` and ``end`` yield final
    edits (edit, role, text) as soon as they are."""

    def __init__(self):
        self.root = _Node(None, "", None, None)
        self.best = {START: (0, self.root)}
        self.root.ends = 1
        self.cost = 0

    def _offer(self, table, state, cost, parent, edit, role, text):
        old = table.get(state)
        if old is not None and old[0] < cost:
            return False
        node = parent.after.get(edit)
        made = node is None
        if made:
            node = _Node(parent, edit, role, text)
            parent.after[edit] = node
        if old is not None and (old[1] is node or old[0] == cost and not _less(node, old[1])):
            if made:
                del parent.after[edit]
            return False
        node.ends += 1
        table[state] = (cost, node)
        if old is not None:
            self._release(old[1])
        return True

    @staticmethod
    def _release(node):
        node.ends -= 1
        while node.parent is not None and not node.ends and not node.after:
            parent = node.parent
            if parent.after.get(node.edit) is node:
                del parent.after[node.edit]
            node = parent

    def _inserts(self):
        todo = list(self.best)
        while todo:
            state = todo.pop()
            cost, node = self.best[state]
            to, role = MADE[state]
            if self._offer(self.best, to, cost + INSERT, node, "I", role, ""):
                todo.append(to)
        # Whatever follows "nothing yet" or "after system" can also follow an
        # assistant row (a system row kept first is deleted there): those two
        # end once they cost more than that, or they would never coalesce.
        if ASSISTANT in self.best:
            cost, node = self.best[ASSISTANT]
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > cost + more:
                    self._release(self.best.pop(state)[1])

    def _final(self) -> Iterator[tuple[str, str | None, str | None]]:
        while not self.root.ends and len(self.root.after) == 1:
            self.root = next(iter(self.root.after.values()))
            self.root.parent = None
            yield self.root.edit, self.root.role, self.root.text

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, str | None, str | None]]:
        self._inserts()
        after, extra = {}, TRUNCATED if truncated else 0
        step = NEXT.get(role[:1], {})
        for state, (cost, node) in self.best.items():
            self._offer(after, state, cost + DELETE, node, "D", None, None)
            if not must_go:
                if state in step:
                    self._offer(after, step[state], cost + KEEP + extra, node, "K", role, text)
                to, made = MADE[state]
                self._offer(after, to, cost + REROLE + extra, node, "R", made, text)
        old, self.best = self.best, after
        for _, node in old.values():
            self._release(node)
        yield from self._final()

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        self._inserts()
        state = START if START in self.best else None
        if ASSISTANT in self.best and (state is None or (self.best[ASSISTANT][0], 0) < (self.best[START][0], 0)
                                       or self.best[ASSISTANT][0] == self.best[START][0] and _less(self.best[ASSISTANT][1], self.best[START][1])):
            state = ASSISTANT
        self.cost = self.best[state][0]
        for other, (_, node) in self.best.items():
            if other != state:
                self._release(node)
        self.best[state][1].ends = 0
        yield from self._final()


def _sorted_rows(df: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    """Narrow rows (conv, turn, role, text, absent, first turn of an equal
    row), a conversation's in one partition and in order."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.col(absent) if absent else F.lit(False)).alias("absent"))
    same = F.struct(F.col("conv").isNull(), F.col("conv"), "role", "text")
    rows = rows.withColumn("h1", F.xxhash64(same)).withColumn("h2", F.xxhash64(F.lit(1), same))
    firsts = rows.where(~F.col("absent")).groupBy("h1", "h2").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    rows = rows.join(firsts, ["h1", "h2"], "left")
    later = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least")))
    rows = rows.select("conv", "turn", "role", "text", "absent", F.coalesce(later, F.lit(False)).alias("later"))
    return rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "absent", F.asc_nulls_first("turn"), "role", "text")


def _stream(batches):
    """(conversation, row or None, final edits, search) per row, then once with None at
    the end of each conversation."""
    current, search, last = None, None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for conv, turn, role, text, absent, later in zip(*columns):
            if search is None or conv != current:
                if search is not None:
                    yield current, None, list(search.end()), search
                current, search, last = conv, Repair(), None
            if absent:
                yield conv, None, (), None
                continue
            tail = _LAST.search(text)
            fault = "blank" if tail is None else "duplicate" if later or last == (turn, role, text) else "truncated" if tail[0] not in ".!?" else ""
            yield conv, (turn, role, text, fault), search.row(role, text, fault in ("blank", "duplicate"), fault == "truncated"), search
            last = (turn, role, text)
    if search is not None:
        yield current, None, list(search.end()), search


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: conversation, step (from 0), edit (K, R or I), role,
    text.  Deleted rows are left out.

    A null conversation id is a conversation of its own; null turns come first;
    a null role or text counts as one space; a role of another or of no initial
    is given up for user or assistant, or deleted.  Rows of one turn go by role
    and text.  Other columns are not carried.  No rows give no rows; a
    conversation's length does not matter to memory."""
    schema = T.StructType([T.StructField(conv, df.schema[conv].dataType), T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = _arrow_type(df, conv)

    def run(batches):
        out, step = [], 0
        for key, row, edits, search in _stream(batches):
            for edit, r, t in edits:
                if edit != "D":
                    out.append((key, step, edit, r, t))
                    step += 1
            if row is None and search is not None:
                step = 0
            if len(out) >= 1000:
                yield _record(out, schema.names, [arrow, pa.int64(), pa.string(), pa.string(), pa.string()])
                out = []
        yield _record(out, schema.names, [arrow, pa.int64(), pa.string(), pa.string(), pa.string()])

    return _sorted_rows(df, conv, turn, role, text, None).mapInArrow(run, schema)


def _arrow_type(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


def _record(rows, names, types):
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], list(names))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None) -> DataFrame:
    """One row per conversation: counts of faults and gaps, the cost and the
    edits' initials in order (``audit``), and the SHA-256 of the repaired
    ``role:text`` lines.  Rows whose ``absent`` column is true only say that the
    conversation exists.  Edge cases as in ``repair``; a role without an
    initial makes an illegal neighbour.  The hash and the audit take a
    conversation's rows one after the other in one task."""
    schema = T.StructType([T.StructField(conv, df.schema[conv].dataType)] + [T.StructField(n, T.LongType()) for n in REPORT] +
                          [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    types = [_arrow_type(df, conv)] + [pa.int64()] * len(REPORT) + [pa.string(), pa.string()]

    def run(batches):
        out = []

        def clear():
            return {"least": None, "most": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None,
                    "audit": [], "hash": hashlib.sha256(), "lines": 0}

        s = clear()
        for key, row, edits, search in _stream(batches):
            if row is not None:
                number, name, _, fault = row
                if fault:
                    s[fault] += 1
                if number is not None and number != s["most"]:
                    s["least"] = number if s["least"] is None else s["least"]
                    s["most"], s["turns"] = number, s["turns"] + 1
                if s["before"] is not None and s["before"] + name[:1] not in LEGAL:
                    s["illegal"] += 1
                s["before"] = name[:1]
            for edit, r, t in edits:
                s["audit"].append(edit)
                if edit != "D":
                    s["hash"].update((("\n" if s["lines"] else "") + r + ":" + t).encode())
                    s["lines"] += 1
            if row is None and search is not None:
                gaps = int(s["most"] - s["least"]) + 1 - s["turns"] if s["turns"] else 0
                out.append((key, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], search.cost, "".join(s["audit"]), s["hash"].hexdigest()))
                s = clear()
            if len(out) >= 1000:
                yield _record(out, schema.names, types)
                out = []
        yield _record(out, schema.names, types)

    return _sorted_rows(df, conv, turn, role, text, absent).mapInArrow(run, schema)


def damage(df: DataFrame) -> DataFrame:
    """``conversations`` with seeded faults, by the checksum of conversation
    and turn: rows lost (marked ``absent``), emptied, without end marks, said
    twice, or given to the user.  Nulls count as one space."""
    def spaced(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), draw.alias("draw"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") == 0).alias("absent"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), absent="absent")
