"""Folder synchronisation: diff, states, retries, tombstones, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rows import first_of

STATES = ("pending", "syncing", "synced", "partial", "failed", "deleted")
#: Allowed transitions: to -> from.
TRANSITIONS = {"syncing": ["pending"], "synced": ["syncing"], "partial": ["syncing"], "failed": ["pending", "syncing"], "pending": ["failed", "synced", "partial"], "deleted": ["pending", "syncing", "synced", "partial", "failed"]}


def changed(old: str, new: str) -> Column:
    """Whether a file differs from its manifest row (columns are prefixed by old, new).

    A stored hash decides alone; else modification time, inode, size; a row without any of these counts as changed.
    """
    o, n = (lambda c: F.col(f"{old}{c}")), (lambda c: F.col(f"{new}{c}"))
    other = lambda c: o(c).isNotNull() & ~o(c).eqNullSafe(n(c))
    bare = o("mtime_ms").isNull() & o("inode").isNull() & o("size_bytes").isNull()
    return F.when(o("sha1").isNotNull(), ~o("sha1").eqNullSafe(n("sha1"))).otherwise(other("mtime_ms") | other("inode") | other("size_bytes") | bare)


def diff(manifest: DataFrame, files: DataFrame, key: str | list[str] = "rel_path", ignore: Column | None = None) -> DataFrame:
    """key, change (added, updated, deleted) of files against the manifest; rows under `ignore` (on old_ columns) are never deleted.

    One shuffle on the key of both sides; unchanged files have no row.
    """
    keys = [key] if isinstance(key, str) else key
    facts = ["size_bytes", "mtime_ms", "inode", "sha1"]
    old = manifest.where("coalesce(last_event, '') <> 'deleted'").select(*keys, *[F.col(c).alias(f"old_{c}") for c in facts], F.lit(True).alias("__old"))
    new = files.select(*keys, *[F.col(c).alias(f"new_{c}") for c in facts], F.lit(True).alias("__new"))
    kept = F.lit(False) if ignore is None else ignore
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), F.when(~kept, "deleted")).when(changed("old_", "new_"), "updated")
    return old.join(new, keys, "full_outer").withColumn("change", kind).where("change is not null").select(*keys, "change")


def reuse_hashes(manifest: DataFrame, files: DataFrame, key: str = "rel_path") -> DataFrame:
    """files with sha1 from the manifest where size and time are unchanged, null where it must be computed."""
    old = manifest.select(key, F.col("size_bytes").alias("__s"), F.col("mtime_ms").alias("__m"), F.col("sha1").alias("__h"))
    same = (F.col("__s") == F.col("size_bytes")) & (F.col("__m") == F.col("mtime_ms"))
    return files.drop("sha1").join(old, key, "left").withColumn("sha1", F.when(same, F.col("__h"))).drop("__s", "__m", "__h")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """old with the rows of new: overwrite columns take the new value, others the new one if it is not null."""
    cols = [c for c in old.columns if c not in keys]
    brought = [F.col(c).alias(f"new__{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(f"new__{c}") for c in cols]
    both = old.join(new.select(*keys, *brought, F.lit(True).alias("new__row")), keys, "full_outer")
    pick = [F.when(F.col("new__row") & F.lit(c in (overwrite or [])), F.col(f"new__{c}")).otherwise(F.coalesce(f"new__{c}", c)).alias(c) for c in cols]
    return both.select(*keys, *pick)


def merge_metadata(old: Column, new: Column) -> Column:
    """Map of both; new values win."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(new, F.create_map().cast("map<string,string>"))), k))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def set_attribute(metadata: Column, key: str, value: Column | None) -> Column:
    """metadata with the key set, or without it for None."""
    rest = F.map_filter(metadata, lambda k, _: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), value))


def transition(df: DataFrame, to: str, status: str = "last_event", where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(df after the allowed transitions, the changed rows): rows of a state that leads to `to`, or of none."""
    able = F.col(status).isin(TRANSITIONS[to]) | F.col(status).isNull()
    able = able if where is None else able & where
    return df.withColumn(status, F.when(able, to).otherwise(F.col(status))), df.where(able)


def claim(df: DataFrame, n: int, now: Column, lease_minutes: int = 5, key: str = "id") -> DataFrame:
    """The first n pending rows without a lease or with one that has run out, locked now. One writer at a time, as in foreachBatch."""
    free = F.col("locked_at").isNull() | (F.col("locked_at") < now - F.expr(f"interval {lease_minutes} minutes"))
    return df.where((F.col("status") == "pending") & free).orderBy(key).limit(n).withColumn("locked_at", now)


def minutes_since(at: str, now: Column) -> Column:
    return (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))) / 60


def reap_syncing(df: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Rows that sync for longer, or never started, become pending without a document."""
    stale = (F.col("last_event") == "syncing") & (F.col("sync_started_at").isNull() | (minutes_since("sync_started_at", now) > minutes))
    return df.withColumn("document_id", F.when(stale, None).otherwise(F.col("document_id"))).withColumn("last_event", F.when(stale, "pending").otherwise(F.col("last_event")))


def reap_runs(df: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    stale = (F.col("status") == "running") & (minutes_since("started_at", now) > minutes)
    return df.withColumn("status", F.when(stale, "abandoned").otherwise(F.col("status")))


def reset_for_retry(df: DataFrame, status: str = "last_event") -> DataFrame:
    again = F.col(status).isin("failed", "synced", "partial")
    return df.withColumn("last_error", F.when(again, None).otherwise(F.col("last_error"))).withColumn(status, F.when(again, "pending").otherwise(F.col(status)))


def retry_outcomes(wanted: DataFrame, manifest: DataFrame, files: DataFrame, key: str = "rel_path") -> DataFrame:
    """key, outcome: enqueued, skipped (its state is not reset), missing (its file is gone)."""
    out = wanted.join(manifest.select(key, "last_event"), key, "left").join(files.select(key, F.lit(True).alias("__f")), key, "left")
    return out.select(key, F.when(F.col("__f").isNull(), "missing").when(F.col("last_event").isin("failed", "synced", "partial"), "enqueued").otherwise("skipped").alias("outcome"))


def purge(df: DataFrame, before: Column, status: str = "last_event", seen: str = "last_seen_at") -> DataFrame:
    """df without tombstones last seen before that time."""
    return df.where(~F.coalesce((F.col(status) == "deleted") & (F.col(seen) < before), F.lit(False)))


def orphans(manifest: DataFrame) -> DataFrame:
    """Pending rows that no sync has started: to be queued again on start."""
    return manifest.where((F.col("last_event") == "pending") & F.col("sync_started_at").isNull())


def queue(requests: DataFrame, keys: list[str], at: str, tie: str, busy: DataFrame | None = None, most: int = 100_000) -> DataFrame:
    """The last request of each key that is not being worked on; of more than `most` the oldest go."""
    last = first_of(requests, keys, F.col(at).desc(), F.col(tie).desc())
    last = last if busy is None else last.join(busy.select(*keys), keys, "left_anti")
    return last.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(most)


def partial_update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Given columns take their value (null included) in the rows under where; others stay."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def archive(df: DataFrame, where: Column, now: Column) -> DataFrame:
    """archived_at is set where it was not."""
    return df.withColumn("archived_at", F.when(where, F.coalesce("archived_at", now)).otherwise(F.col("archived_at")))


def restore(df: DataFrame, where: Column) -> DataFrame:
    return df.withColumn("archived_at", F.when(where, None).otherwise(F.col("archived_at")))


def update_documents(documents: DataFrame, sources: DataFrame, updates: DataFrame, tenant: str, now: Column) -> DataFrame:
    """documents with the updates (id, title, metadata) of those whose source is the tenant's; all others stay.

    A blank or null title keeps the old one; metadata is merged, the new values win, and is
    left as it is where none is given; updated_at is set.  One update an id.
    """
    own = sources.where(F.col("tenant_id") == tenant).select(F.col("id").alias("source_id"), F.lit(True).alias("__own")).distinct()
    new = updates.select("id", F.trim("title").alias("__title"), F.col("metadata").alias("__metadata"), F.lit(True).alias("__new"))
    both = documents.join(new, "id", "left").join(own, "source_id", "left")
    hit = F.coalesce(F.col("__own") & F.col("__new"), F.lit(False))
    values = {
        "title": F.when(hit, F.coalesce(F.nullif("__title", F.lit("")), "title")).otherwise(F.col("title")),
        "metadata": F.when(hit & F.col("__metadata").isNotNull(), merge_metadata(F.col("metadata"), F.col("__metadata"))).otherwise(F.col("metadata")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return both.withColumns(values).select(*documents.columns)


def record_skipped(manifest: DataFrame, files: DataFrame, reason: Column, keys: list[str]) -> DataFrame:
    """manifest with a row, state synced, for each file that has a reason to be skipped; the reason is its last error.

    files: the keys, size_bytes, mtime_ms, inode, sha1, and what the reason looks at.  Files without a reason change nothing.
    """
    skipped = files.withColumn("last_error", reason).where("last_error is not null").withColumn("last_event", F.lit("synced"))
    given = [c for c in ("size_bytes", "mtime_ms", "inode", "sha1", "last_error", "last_event") if c in skipped.columns]
    return upsert(manifest, skipped.select(*keys, *given), keys, ["last_error", "last_event"])
