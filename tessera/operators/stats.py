"""Aggregates: counts over linked sources, statuses, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rows import latest_per


def project_stats(sources: DataFrame, documents: DataFrame, chunks: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """documents, chunks, events, entities: counts over a set of source ids; archived documents and deleted events do not count, all entities do."""
    docs = documents.where("archived_at is null").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    ids = docs.select(F.col("id").alias("document_id"))
    mine = sources.select(F.col("id").alias("source_id"))
    parts = [
        docs.agg(F.count("*").alias("documents")), chunks.join(ids, "document_id", "left_semi").agg(F.count("*").alias("chunks")),
        events.where("deleted_at is null").join(ids, "document_id", "left_semi").agg(F.count("*").alias("events")),
        entities.join(mine, "source_id", "left_semi").agg(F.countDistinct("id").alias("entities")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def status_record(df: DataFrame, key: str | list[str], status: str, known: list[str]) -> DataFrame:
    """One row per key with a count for each known status (0 if none) and total over all."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in known]
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(*counts, F.count("*").alias("total"))


def filtered_counts(left: DataFrame, right: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """left with the number of its right rows under the condition, 0 if none."""
    counts = right.where(condition).groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def distinct_links(left: DataFrame, links: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """left, isolated rows included, with its number of distinct linked ids."""
    return filtered_counts(left, links.select(key, other).distinct(), key, F.lit(True), name)


def run_totals(runs: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c.removeprefix("stats_"))
    return runs.agg(total("stats_added"), total("stats_updated"), total("stats_deleted"), F.count_if(F.col("status").isin("failed", "partial")).alias("failed_or_partial"))


def progress(done: Column, total: Column) -> Column:
    """Percent from 0 to 100; -1 for a total of 0."""
    return F.when(total == 0, -1).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * done / total).cast("int"))))


def run_status(error: Column, failed: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(failed > 0, "completed_with_errors").otherwise("completed")


def folder_summary(folders: DataFrame, runs: DataFrame) -> DataFrame:
    """folders with the latest run of each; numbers of a missing run are 0."""
    last = latest_per(runs, "folder_id", "started_at", "id").select("folder_id", F.col("status").alias("run_status"), "started_at", *[F.col(c) for c in ("stats_added", "stats_updated", "stats_deleted", "stats_failed")])
    out = folders.join(last, folders["id"] == last["folder_id"], "left").drop("folder_id")
    return out.fillna(0, ["stats_added", "stats_updated", "stats_deleted", "stats_failed"])


def index_drift(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks, vectors, missing: counts, and chunks without a vector."""
    gone = chunks.select(F.col("id").alias("chunk_id")).join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(vectors.agg(F.count("*").alias("vectors"))).crossJoin(gone)


def streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures: key, first, last, n (gaps and islands)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__i", island).where(failed).groupBy(key, "__i").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).drop("__i")


def to_stop(checks: DataFrame, key: str, order: list[str], failed: Column, after: int = 3) -> DataFrame:
    """key, n: what has failed `after` times or more in a row up to its last check, and how often."""
    from pyspark.sql import Window

    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    fine = F.sum(F.when(failed, 0).otherwise(1)).over(newest.rowsBetween(Window.unboundedPreceding, 0))  # good checks since
    return checks.withColumn("__fine", fine).where("__fine = 0").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= after)
