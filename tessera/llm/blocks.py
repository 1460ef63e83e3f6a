"""Exact pairwise verification inside groups, in blocks.

A group of m rows is cut into blocks of about `BLOCK` rows; every pair of blocks is one
task, so no task holds a whole hot group, and only sums per row and one label per row
leave a task: pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def pair_blocks(members: DataFrame, node: str, size: str) -> DataFrame:
    """members with i, j, left, right: each row once for every block pair that it belongs to."""
    out = members.withColumn("n_blocks", F.ceil(F.col(size) / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64(node), F.col("n_blocks").cast("long")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n_blocks")


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run() on the rows of each key, many keys a task, rows as Arrow tables."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                a, b = c.slice(0, len(c) - 1), c.slice(1)
                change |= pc.not_equal(a, b).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if open_ and any(open_[-1].column(k)[-1] != part.column(k)[0] for k in keys):
                    if (got := run(pa.Table.from_batches(open_))) is not None:
                        yield got
                    open_ = []
                open_.append(part)
        if open_ and (got := run(pa.Table.from_batches(open_))) is not None:
            yield got

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, schema)


def labels_of(linked: np.ndarray) -> np.ndarray:
    """The least row that each row reaches in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label, n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def settle(linked: np.ndarray, own: np.ndarray, i: int, j: int) -> np.ndarray:
    """The pairs that this task counts: inside the block where i = j, else across the two."""
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= own[:, None] != own[None, :]
    return linked
