"""Details and listings of events, entities and documents; lookups, runs, repairs.

Each works on whole tables or on the rows that a filter leaves: a caller that wants one
record filters by its id, which is pushed to the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame, archived: bool) -> DataFrame:
    """df without rows that are archived, unless these are wanted."""
    return df if archived or "archived_at" not in df.columns else df.where(F.col("archived_at").isNull())


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def entity_lists(links: DataFrame, entities: DataFrame) -> DataFrame:
    """event_id, entities: array<struct<type, name, id>> of the entities linked to each event, by type and name."""
    own = links.select("event_id", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "type", "name"), "entity_id")
    return own.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("type", "name", F.col("entity_id").alias("id")))).alias("entities"))


def event_details(events: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, archived: bool = False) -> DataFrame:
    """Events (id, source_id, document_id, chunk_id, ...) that are not deleted, of live sources, and of live documents or none, with
    source_*, document_* and chunk_* columns (null where there is none) and entities; archived ones too if asked for."""
    docs = _named(documents, "document").withColumnRenamed("document_id", "document_id_")
    out = events.where("deleted_at is null").join(_named(_kept(sources, archived), "source").withColumnRenamed("source_id", "source_id_"), F.col("source_id") == F.col("source_id_")).drop("source_id_")
    out = out.join(docs, F.col("document_id") == F.col("document_id_"), "left").drop("document_id_")
    if not archived and "document_archived_at" in out.columns:
        out = out.where(F.col("document_archived_at").isNull())
    text = chunks.select(F.col("id").alias("chunk_id"), F.col("heading").alias("chunk_heading"), F.col("content").alias("chunk_content"))
    out = out.join(text, "chunk_id", "left").join(entity_lists(links, entities).withColumnRenamed("event_id", "id"), "id", "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast(out.schema["entities"].dataType)))


def entity_details(entities: DataFrame, sources: DataFrame, events: DataFrame, documents: DataFrame, links: DataFrame, archived: bool = False) -> DataFrame:
    """Entities of live sources with at least one event of a live document: source_name, event_count, events (struct<rank, id> in that order)."""
    alive = events.where("deleted_at is null").join(_kept(documents, archived).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    mine = links.select("event_id", "entity_id").distinct().join(alive.select(F.col("id").alias("event_id"), "rank"), "event_id")
    lists = mine.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("event_count"), F.array_sort(F.collect_list(F.struct("rank", F.col("event_id").alias("id")))).alias("events"))
    named = _kept(sources, archived).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return entities.join(named, "source_id").join(lists, "id")


def document_details(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """documents, archived ones too, with source_* of their source."""
    return documents.join(_named(sources, "source").withColumnRenamed("source_id", "source_id_"), F.col("source_id") == F.col("source_id_")).drop("source_id_")


def chunk_listing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """document_id, rank, id, heading, content, vector of chunks, by document, rank and id."""
    out = chunks.join(vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector")), "id", "left")
    return out.select("document_id", "rank", "id", "heading", "content", "vector").orderBy("document_id", "rank", "id")


def event_listing(events: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Events that are not deleted with their number of entities and these, by document, rank and id."""
    out = events.where("deleted_at is null").join(entity_lists(links, entities).withColumnRenamed("event_id", "id"), "id", "left")
    return out.withColumn("entity_count", F.coalesce(F.size("entities"), F.lit(0)).cast("long")).orderBy("document_id", "rank", "id")


def entity_listing(entities: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """document_id and entities with the events of that document that name them, most first, then by type and name."""
    alive = events.where("deleted_at is null").select(F.col("id").alias("event_id"), "document_id")
    counts = links.select("event_id", "entity_id").distinct().join(alive, "event_id").groupBy("document_id", "entity_id").agg(F.count("*").alias("event_count"))
    return counts.join(entities.withColumnRenamed("id", "entity_id"), "entity_id").orderBy("document_id", F.col("event_count").desc(), "type", "name")


def default_entity_type(types: DataFrame, wanted: str) -> str:
    """The id of the active type of that name, the default one first; else of `subject`; else of any; LookupError without any."""
    order = F.when(F.col("type") == wanted, 0).when(F.col("type") == "subject", 1).otherwise(2)
    got = types.where("is_active").orderBy(order, F.col("is_default").desc(), "id").limit(1).select("id").first()
    if got is None:
        raise LookupError("there is no active entity type")
    return got["id"]


def lookup(df: DataFrame, **values) -> DataFrame:
    """The rows whose columns have the values (null for None)."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def page_with_total(df: DataFrame, page: DataFrame) -> DataFrame:
    """page with total: the number of rows of df, of which it is a page."""
    return page.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))  # one row


def newest(df: DataFrame, at: str, tie: str, limit: int | None = None, default: int = 100, most: int = 1000) -> DataFrame:
    """The newest rows: `limit` of them, between 1 and `most`."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(default if limit is None else max(1, min(most, int(limit))))


# --- runs and folders --------------------------------------------------------


def start_runs(runs: DataFrame, wanted: DataFrame, folders: DataFrame, now: Column) -> DataFrame:
    """runs with a running one for each row of wanted (id, folder_id, trigger); the tenant is the folder's, `unknown` without one."""
    tenant = folders.select(F.col("id").alias("folder_id"), "tenant_id")
    new = wanted.join(tenant, "folder_id", "left").withColumns({"tenant_id": F.coalesce("tenant_id", F.lit("unknown")), "status": F.lit("running"), "started_at": now})
    return runs.unionByName(new, allowMissingColumns=True)


def finish_runs(runs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """runs with status, stats_* and error of ended (id, ...) and the time, where ended has the id."""
    cols = [c for c in ended.columns if c != "id"]
    both = runs.join(ended.select("id", F.lit(True).alias("ended__"), *[F.col(c).alias(f"{c}__") for c in cols]), "id", "left")
    new = {c: F.when(F.col("ended__"), F.col(f"{c}__")).otherwise(F.col(c)) for c in cols} | {"completed_at": F.when(F.col("ended__"), now).otherwise(F.col("completed_at"))}
    return both.withColumns(new).select(*runs.columns)


def scanned(folders: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """folders with last_scan_at, last_scan_status (ok or error), last_scan_error and updated_at of their row in scans (id, error)."""
    both = folders.join(scans.select("id", F.lit(True).alias("scan__"), F.col("error").alias("error__")), "id", "left")
    new = {"last_scan_at": now, "last_scan_status": F.when(F.col("error__").isNull(), "ok").otherwise("error"), "last_scan_error": F.col("error__"), "updated_at": now}
    return both.withColumns({c: F.when(F.col("scan__"), v).otherwise(F.col(c)) for c, v in new.items()}).select(*folders.columns)


def repair_events(events: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """events of sources that exist; a reference to a document that does not is null."""
    mine = events.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known__"))
    return mine.join(known, "document_id", "left").withColumn("document_id", F.when(F.col("known__"), F.col("document_id"))).select(*events.columns)


def delete_members(members: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, documents) without the members of gone (id): those of type upload take the documents of their upload with them."""
    uploads = members.join(gone.select("id"), "id", "left_semi").where("source_type = 'upload' and upload_id is not null").select(F.col("upload_id").alias("source_id")).distinct()
    return members.join(gone.select("id"), "id", "left_anti"), documents.join(uploads, "source_id", "left_anti")


def overview(progress: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Sums of a tenant's queue (added, updated, deleted, failed, total), done, and percent (0 to 100, -1 for none)."""
    parts = ("added", "updated", "deleted", "failed")
    out = progress.groupBy(tenant).agg(*[F.sum(c).alias(c) for c in (*parts, "total")])
    done = sum((F.col(c) for c in parts), F.lit(0))
    percent = F.when(F.col("total") == 0, -1).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * done / F.col("total")).cast("int"))))
    return out.withColumn("done", done.cast("long")).withColumn("percent", percent)


def relative_path(metadata: Column, name: Column) -> Column:
    """relPath of the JSON if it is a string that is not empty, else the file's name, else nothing."""
    return F.coalesce(F.nullif(F.get_json_object(metadata, "$.relPath"), F.lit("")), name, F.lit(""))


def rewritten_path(path: Column, relative: Column) -> Column:
    """path in the same folder with the relative path as its last part; as it is where that is empty."""
    separator = F.when(F.contains(path, F.lit("\\")), "\\").otherwise("/")
    kept = F.when(F.contains(path, F.lit("\\")), F.regexp_replace(path, r"\\[^\\]*$", "")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    return F.when(F.length(relative) > 0, F.concat(kept, separator, relative)).otherwise(path)

