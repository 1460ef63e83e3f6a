"""Which pieces of a document were seen in an earlier one: shared by the line and the substring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import Scratch


def earlier_owners(pieces: DataFrame, scratch: Scratch, keys: list[str]) -> DataFrame:
    """doc_id, one array per key, owners: the pieces of each document whose first owner is another, smaller doc_id.

    pieces: doc_id and the key columns, one row for each distinct piece of a document.
    A hot piece is pre-aggregated to one row per task before it is shuffled; the join
    back reads both sides from tables, so adaptive execution may split its key.
    Documents without such pieces have no row.
    """
    pieces = scratch.keep(pieces, "pieces")
    owners = scratch.keep(pieces.groupBy(*keys).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "owners")
    seen = pieces.join(owners, keys).where("doc_id > owner")
    lists = seen.groupBy("doc_id").agg(F.collect_list(F.struct(*keys, "owner")).alias("seen"))
    return lists.select("doc_id", *[F.col(f"seen.{k}").alias(k) for k in keys], F.col("seen.owner").alias("owners"))
