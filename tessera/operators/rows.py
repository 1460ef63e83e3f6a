"""Filters, set operations, ordering and pages over DataFrames."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters ---------------------------------------------------------------


def live(events: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Events that are not deleted, of documents and sources that are not archived."""
    docs = documents.where("archived_at is null").select(F.col("id").alias("document_id"))
    srcs = sources.where("archived_at is null").select(F.col("id").alias("source_id"))
    return events.where("deleted_at is null").join(docs, "document_id", "left_semi").join(srcs, "source_id", "left_semi")


def filters(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """df under all conditions that are given; None stands for an absent one."""
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def one_of(column: str, values: list | None) -> Column | None:
    return None if values is None else F.col(column).isin(values)


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) >= threshold)


def missing(requested: DataFrame, sources: DataFrame, tenant: str | None = None) -> DataFrame:
    """Requested ids that no live source of the tenant has."""
    ok = filters(sources.where("archived_at is null"), None if tenant is None else F.col("tenant_id") == tenant)
    return requested.join(ok.select("id"), "id", "left_anti")


def require_sources(requested: DataFrame, sources: DataFrame, tenant: str | None = None) -> None:
    """ValueError that names up to ten missing ids, and the ten newest live sources (id, name, created_at) to choose from."""
    gone = [r["id"] for r in missing(requested, sources, tenant).orderBy("id").limit(10).collect()]
    if not gone:
        return
    there = filters(sources.where("archived_at is null"), None if tenant is None else F.col("tenant_id") == tenant)
    newest = there.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(10).select("id", "name").collect()
    choice = "; ".join(f"{r['id']} ({r['name']})" for r in newest)
    raise ValueError(f"sources not found: {', '.join(map(str, gone))}. " + (f"Live sources, newest first: {choice}" if newest else "There is no live source"))


# --- sets --------------------------------------------------------------------


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def first_of(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of each key in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all parts, each key where it comes first; place counts from 0 by part, then order."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    return first_of(tagged, [key], "__part", order).drop("__part")


def minus(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def in_order(ids: list, df: DataFrame, key: str) -> DataFrame:
    """Rows of df in the caller's order of ids, with place (from 0)."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"place int, {key} {kind}")
    return wanted.join(df, key).orderBy("place")


# --- order and pages ---------------------------------------------------------


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of greatest score; ties by the given columns."""
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def diversify(df: DataFrame, group: str, score: str, per_group: int, k: int, *ties: str) -> DataFrame:
    """At most per_group rows of each group by falling score, then the k best; rows without a group share one."""
    w = Window.partitionBy(F.coalesce(F.col(group).cast("string"), F.lit("__no_doc__"))).orderBy(F.col(score).desc(), *ties)
    return top_k(df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_group).drop("__n"), score, k, *ties)


def latest_per(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return first_of(df, [key], F.col(at).desc(), F.col(tie).desc())


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, int(value)))


def encode_cursor(**position) -> str:
    return base64.urlsafe_b64encode(json.dumps(position, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, after: dict | None = None) -> DataFrame:
    """The next rows by keys (name, descending) after a position; nulls of a key come last.

    The row comparison is expanded to a disjunction, so that each term can be pushed to the scan.
    """
    if after is not None:
        terms, equal = [], F.lit(True)
        for name, falling in keys:
            value = F.lit(after[name]).cast(df.schema[name].dataType)
            past = F.col(name) < value if falling else F.col(name) > value
            terms.append(equal & (past | F.col(name).isNull()))
            equal = equal & (F.col(name) == value)
        df = df.where(reduce(lambda a, b: a | b, terms))
    return df.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in keys]).limit(limit)


def next_cursor(page: list, keys: list[tuple[str, bool]], limit: int) -> str | None:
    """A cursor after the page's last row, only if the page is full."""
    return encode_cursor(**{n: page[-1][n] for n, _ in keys}) if len(page) == limit else None


def offset_page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def recent_failures(df: DataFrame, started: str, seen: str, k: int = 20, tie: str = "id") -> DataFrame:
    return df.orderBy(F.coalesce(started, seen).desc(), F.col(tie)).limit(k)
