"""Ranks and greedy batches over the one order of a whole table, with no task that holds the order.

Rows are sorted into ranges and written once with their place in their range; what must run
through the order runs over small summaries of blocks of `BLOCK` rows instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import new_folder

BLOCK = 1 << 16
#: Summaries that are composed in one step.
FANOUT = 256


def _laid(df: DataFrame, order: tuple[str | Column, ...]) -> tuple[DataFrame, DataFrame]:
    """(df in written ranges of the order, with __part and __at; __part, __before: rows in earlier ranges)."""
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    path = new_folder(df.sparkSession, "laid")
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    return rows, sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))


def global_ranks(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with the place, from 0, of each row in the order of all; rows that are equal in it have places next to each other.

    Ranges, their counts and the offsets that follow: there is no window over the rows.
    """
    rows, offsets = _laid(df, order)
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def _jumps(cost: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums up to and with each row, where the batch after one that begins at each row begins; len(cost) for beyond)."""
    sums = np.cumsum(cost)
    before = sums - cost
    return sums, np.maximum(np.searchsorted(sums, before + limit, side="right"), np.arange(1, len(cost) + 1))


def _summary(cost: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sum 0 to limit + 1 (as good as full) of the batch that comes in: batches begun, and the sum that goes out."""
    m = len(cost)
    sums, jump = _jumps(cost, limit)
    # by doubling: from a batch that begins at a row, how many begin from there on and the sum of the last
    to, begun = np.append(jump, m), np.append(np.ones(m, np.int64), 0)
    last = np.arange(m + 1)
    while (to[:m] < m).any():
        last = np.where(to < m, last[to], last)
        begun, to = begun + begun[to], to[to]
    came = np.arange(limit + 2)
    first = np.searchsorted(sums, limit - came, side="right")
    out = np.minimum(came + (sums[-1] if m else 0), limit + 1)
    on = first < m
    start = last[first[on]]
    out[on] = np.minimum(sums[-1] - sums[start] + cost[start], limit + 1)
    return np.where(on, begun[first], 0), out


def _packed(n: np.ndarray, out: np.ndarray) -> tuple[bytes, bytes]:
    return n.astype(np.int64).tobytes(), out.astype(np.int64).tobytes()


def budget_batches(df: DataFrame, cost: Column, limit: int, *order: str | Column, name: str = "batch") -> DataFrame:
    """df with the number of its batch: rows in order are packed while their costs (whole, 0 or more) stay within the limit; a larger row is alone.

    A block of rows is a function from the sum that comes in, 0 to limit, to the batches that it
    begins and the sum that goes out.  Functions are composed up a tree of blocks, sums are
    handed down it, and each block numbers its rows from what came in.  Null costs count as 0.
    """
    if limit < 1:
        raise ValueError("the limit must be 1 or more")
    rows, _ = _laid(df.withColumn("__cost", F.coalesce(cost.cast("bigint"), F.lit(0))), order)
    session = df.sparkSession

    def kept(frame: DataFrame) -> DataFrame:
        path = new_folder(session, "sums")
        frame.write.parquet(path)
        return session.read.schema(frame.schema).parquet(path)

    cut = rows.select("__part", F.floor(F.col("__at") / BLOCK).alias("b"), "__at", "__cost")
    counts = cut.groupBy("__part").agg((F.max("b") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("from"))
    cut = cut.join(F.broadcast(counts), "__part").select((F.col("from") + F.col("b")).alias("node"), "__part", "__at", "__cost")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__at")
        return pd.DataFrame([(int(part["node"].iloc[0]), *_packed(*_summary(part["__cost"].to_numpy(np.int64), limit)))], columns=["node", "n", "out"])

    levels = [kept(cut.groupBy("node").applyInPandas(summed, "node bigint, n binary, out binary"))]
    n_nodes = levels[0].count()

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        n, out = np.zeros(limit + 2, np.int64), np.arange(limit + 2)
        for r in part.sort_values("node").itertuples():
            n, out = n + np.frombuffer(r.n, np.int64)[out], np.frombuffer(r.out, np.int64)[out]
        return pd.DataFrame([(int(part["parent"].iloc[0]), *_packed(n, out))], columns=["node", "n", "out"])

    while n_nodes > 1:
        up = levels[-1].withColumn("parent", F.floor(F.col("node") / FANOUT))
        levels.append(kept(up.groupBy("parent").applyInPandas(composed, "node bigint, n binary, out binary")))
        n_nodes = -(-n_nodes // FANOUT)
    came = session.createDataFrame([(0, limit + 1, 0)], "node bigint, came bigint, begun bigint")  # as after a full batch

    def handed(part: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("node"), []
        s, begun = int(part["came"].iloc[0]), int(part["begun"].iloc[0])
        for r in part.itertuples():
            out.append((r.node, s, begun))
            begun += int(np.frombuffer(r.n, np.int64)[s])
            s = int(np.frombuffer(r.out, np.int64)[s])
        return pd.DataFrame(out, columns=["node", "came", "begun"])

    for level in levels[-2::-1]:
        down = level.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(came.withColumnRenamed("node", "parent"), "parent")
        came = kept(down.groupBy("parent").applyInPandas(handed, "node bigint, came bigint, begun bigint"))

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__at")
        costs = part["__cost"].to_numpy(np.int64)
        sums, jump = _jumps(costs, limit)
        starts, at = np.zeros(len(costs), np.int64), int(np.searchsorted(sums, limit - int(part["came"].iloc[0]), side="right"))
        while at < len(costs):
            starts[at], at = 1, int(jump[at])
        return part[["__part", "__at"]].assign(batch=np.cumsum(starts) + int(part["begun"].iloc[0]) - 1)

    numbers = cut.join(came, "node").groupBy("node").applyInPandas(numbered, "__part bigint, __at bigint, batch bigint")
    return rows.drop("__cost").join(numbers.withColumnRenamed("batch", name), ["__part", "__at"]).drop("__part", "__at")
