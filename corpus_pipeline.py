"""Corpus pipeline: documents -> packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last keep the columns of ``docs``; rows may be null, blank,
repeated or missing altogether, and extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opexlens.llm import jaccard, lines, mixing, packing, toxicity
from opexlens.llm.common import drop_stage, fresh, stage, table
from opexlens.session import shared_path, stage_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more by their nearest labelled examples go.
    Null and blank texts score as text-less ones (and stay unless most labelled
    documents are toxic); repeated rows score alike; an empty table, or no
    labels, drops nothing.  Each text is scored where its row is."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(model.of_text(F.col("text")) < 0.5)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources go from all documents but the first; documents
    that lose all their words go, blank and null ones that lost nothing stay.
    Null sources count as no source; rows of one id keep or lose a line alike;
    an empty table gives no rows."""
    gone, before = fresh(docs, "__gone", "__lines")
    cut = lines.remove_wide_lines(docs.drop("n_lines", "n_removed")).withColumnsRenamed({"n_removed": gone, "n_lines": before})
    kept = cut.where((F.col(gone) == 0) | (F.col(before) > F.col(gone))).drop(before, gone)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns if c in kept.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays: the one
    with the smallest id (rows without one come last).  Null and blank texts
    are compared with nothing and all stay; of repeated rows one stays; an empty
    table gives no rows."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target words: documents may be cut or stand
    twice, in shuffled order; documents without words (null ones too) add none
    and go.  Null sources are one source; repeated rows are rows of their own."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns if c in mixed.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences (rows may share a doc_id:
    ``row`` tells the rows of the mix apart).  Null texts are one end id; an
    empty table gives no rows."""
    row, = fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    return packing.pack(rows, carry=[row])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained scores, seeded mixing and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  A stage's own tables and
    its input go as soon as its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with stage_scope(spark):
            after = stage(step(spark, docs, sf_dir), name, path)
        if before is not None:
            drop_stage(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
