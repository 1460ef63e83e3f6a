"""Connected components by least labels and pointer jumping, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, label: the least node that each node of edges (a, b) reaches.

    A round takes the least label among a node's neighbours, then the label of its
    label, so long paths shrink by halves.  Only minima per node are shuffled to a
    node; the joins feed partial aggregates, so adaptive execution may split a hot
    node.  Loops and repeated edges do no harm; an empty edge table gives no nodes.
    """
    both = edges.where("a is not null and b is not null")
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # so that edges are computed once
    both = scratch.keep(both.select(F.inline(turned)).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        near = scratch.keep(near, "near")
        lower = scratch.keep(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower")), "lower")
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("beyond"))
        after = lower.join(jump, "lower").select("node", F.col("label").alias("was"), F.least("lower", "beyond").alias("label"))
        after = scratch.keep(after, "after")
        scratch.drop("labels", "near", "lower")
        scratch.paths["labels"] = scratch.paths.pop("after")
        changed = not after.where("was <> label").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            scratch.drop("edges")
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
