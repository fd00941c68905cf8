"""Sharding by a hypergeometric communication matrix.

Every input partition learns exactly how many of its rows go to each shard
(one draw from the law that a uniform shuffle of all rows has), permutes its
rows, deals them out, and each shard permutes what it received.  The result
is a uniform random order cut into shards of exactly equal row counts (at
most one apart).

Only the counts travel before the exchange: partition sizes are grouped into
chunks of 1,000 partitions, the driver draws the chunk x shard table, and a
task per chunk draws the partition x shard rows.  Both permutations are keyed
bijections of row numbers, so no row order is ever kept in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opexlens.llm.common import communication_matrix, fresh, permute, stage, table

CHUNK = 1000
ROWS_PER_TASK = 10_000


def _permute_udf():
    @F.pandas_udf("long")
    def send(x: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n.to_numpy(), key.to_numpy()))
    return send


def shard(df: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (0 to n_shards - 1) and
    ``slot`` (gapless position in the shard), sorted by both inside each task.

    Row counts of shards differ by one at most.  Repeated rows and null
    values are rows like any other; an empty table gives no rows.  The order
    depends on the input's partitions and ``seed`` only.  A text of any length
    travels as one value.  Above 10^9 rows a hypergeometric draw takes the normal
    limit of its law.  A column of ``df`` already named shard or slot is
    replaced."""
    df = df.drop("shard", "slot")
    mid, pid, n, cum, start, size, pos, at = fresh(df, "__mid", "__pid", "__n", "__cum", "__start", "__size", "__pos", "__at")
    rows = stage(df.withColumn(mid, F.monotonically_increasing_id()), "shard-rows")
    rows = rows.withColumn(pid, F.shiftright(mid, 33))
    counts = stage(rows.groupBy(F.col(pid).alias("pid")).agg(F.count("*").alias("n"))
                   .withColumn("chunk", F.floor(F.col("pid") / CHUNK)), "shard-counts")

    chunks = counts.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy("chunk").toPandas()
    total = int(chunks["n"].sum()) if len(chunks) else 0
    cols = np.array([total // n_shards + (k < total % n_shards) for k in range(n_shards)], np.int64)
    drawn = communication_matrix(chunks["n"].to_numpy(np.int64) if len(chunks) else np.zeros(0, np.int64), cols, np.random.default_rng([seed, 0]))
    firsts = np.cumsum(drawn, axis=0) - drawn
    per_chunk = {int(c): (drawn[i].tolist(), firsts[i].tolist()) for i, c in enumerate(chunks["chunk"])}

    def deal(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pid")
        own, first = per_chunk[int(key[0])]
        table = communication_matrix(part["n"].to_numpy(np.int64), np.array(own, np.int64), np.random.default_rng([seed, 1, int(key[0])]))
        begin = np.cumsum(table, axis=0) - table + np.array(first, np.int64)
        edge = np.concatenate([np.zeros((len(table), 1), np.int64), np.cumsum(table, axis=1)], axis=1)
        return pd.DataFrame({pid: part["pid"].to_numpy(), n: part["n"].to_numpy(), cum: list(edge), start: list(begin)})

    plan = stage(counts.groupBy("chunk").applyInPandas(
        deal, f"`{pid}` long, `{n}` long, `{cum}` array<long>, `{start}` array<long>"), "shard-plan")
    sizes = F.array(*[F.lit(int(c)) for c in cols])
    send = _permute_udf()
    # Row number -> place in the partition's own shuffle -> shard and arrival
    # place there -> place in the shard's shuffle.
    out = (rows.join(plan, pid)
           .withColumn(pos, send(F.col(mid).bitwiseAND((1 << 33) - 1), F.col(n), F.xxhash64(F.lit(seed), F.lit("local"), pid)))
           .withColumn("shard", (F.size(F.filter(cum, lambda c: c <= F.col(pos))) - 1).cast("int"))
           .withColumn(at, F.get(start, F.col("shard")) + F.col(pos) - F.get(cum, F.col("shard")))
           .withColumn(size, F.get(sizes, F.col("shard")).cast("long"))
           .withColumn("slot", send(at, size, F.xxhash64(F.lit(seed), F.lit("shard"), "shard"))))
    return (out.select(*df.columns, "shard", "slot")
            .repartition(F.col("shard"), F.floor(F.col("slot") / ROWS_PER_TASK))
            .sortWithinPartitions("shard", "slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
