"""Pages of manifests and sync runs: sort modes, limits, cursors, offsets, totals."""

from __future__ import annotations

import binascii
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rows import clamp, decode_cursor, keyset_page, next_cursor
from tessera.plans.storage import checkpointed

#: Sort modes: (column, descending) of each key.
MANIFEST_SORTS = {"recent": [("last_seen_at", True), ("rel_path", True)], "path": [("rel_path", False)]}
RUN_SORTS = {"recent": [("started_at", True), ("id", True)]}


@dataclass
class Page:
    """rows in order; cursor of the next page if this one is full; offset of the page before, if there is one; total of all pages (None if not asked for)."""

    rows: DataFrame
    next_cursor: str | None
    prev_offset: int | None
    total: int | None
    limit: int
    offset: int


def position(cursor: str | None, keys: list[tuple[str, bool]]) -> dict | None:
    """The position that a cursor holds; None without one, and for one that is none of ours or of another sort mode."""
    try:
        found = decode_cursor(cursor) if cursor else None
    except (ValueError, binascii.Error):
        return None
    return found if isinstance(found, dict) and set(found) == {n for n, _ in keys} and None not in found.values() else None


def page(df: DataFrame, sorts: dict[str, list[tuple[str, bool]]], sort: str = "recent", limit: int | None = None, most: int = 500, usual: int = 50, cursor: str | None = None, offset: int | None = None, include_total: bool = True) -> Page:
    """One page of df by a sort mode: after the cursor's position, else from the offset.

    The limit is held between 1 and `most`.  A cursor that cannot be read counts as none; with
    a cursor the offset is 0.  Only the page's rows leave the tasks.
    """
    if sort not in sorts:
        raise ValueError(f"unknown sort: {sort}")
    keys, n = sorts[sort], clamp(limit, 1, most, usual)
    after = position(cursor, keys)
    skip = 0 if after is not None else max(0, int(offset or 0))
    rows = keyset_page(df, keys, n, after) if not skip else df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]).offset(skip).limit(n)
    rows = checkpointed(rows)  # at most `most` rows
    last = rows.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]).select(*[c for c, _ in keys]).collect()
    return Page(rows, next_cursor(last, keys, n), skip - n if skip >= n else None, df.count() if include_total else None, n, skip)


def manifest_page(manifest: DataFrame, events: DataFrame, folder_id, sort: str = "recent", status: str | None = None, include_deleted: bool = False, **options) -> Page:
    """Files of a folder with event_count and fallback_event_count of their documents: of one status, else all but deleted ones.

    events: document_id, extraction_source.  Only events of the page's documents are counted.
    """
    mine = manifest.where(F.col("folder_id") == folder_id)
    if status is not None:
        mine = mine.where(F.col("last_event") == status)
    elif not include_deleted:
        mine = mine.where("last_event <> 'deleted'")
    got = page(mine, MANIFEST_SORTS, sort, most=500, usual=50, **options)
    own = events.join(F.broadcast(got.rows.select("document_id").where("document_id is not null").distinct()), "document_id", "left_semi")  # a page's documents
    fallback: Column = F.sum((F.coalesce(F.col("extraction_source"), F.lit("")) == "regex-fallback").cast("bigint"))
    counts = own.groupBy("document_id").agg(F.count("*").alias("event_count"), fallback.alias("fallback_event_count"))
    got.rows = got.rows.join(counts, "document_id", "left").fillna(0, ["event_count", "fallback_event_count"])
    return got


def runs_page(runs: DataFrame, folder_id, **options) -> Page:
    """Sync runs of a folder, the newest first; 20 a page, 200 at most."""
    return page(runs.where(F.col("folder_id") == folder_id), RUN_SORTS, "recent", most=200, usual=20, **options)
