"""Merging stores, deleting with cascades, materialising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rows import first_of


def last_writer_wins(ours: DataFrame, theirs: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """One row per key: theirs only if strictly newer."""
    both = ours.withColumn("__them", F.lit(0)).unionByName(theirs.withColumn("__them", F.lit(1)))
    return first_of(both, keys, F.col(updated).desc_nulls_last(), "__them").drop("__them")


def id_map(ours: DataFrame, theirs: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """old, new: our id for each of their ids, their own where we have none."""
    mine = ours.select(*keys, F.col(id_col).alias("__mine"))
    return theirs.select(*keys, F.col(id_col).alias("old")).join(mine, keys, "left").select("old", F.coalesce("__mine", "old").alias("new"))


def remap(children: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """children with new ids; those of no mapped parent go."""
    return children.join(ids, children[column] == ids["old"]).drop(column, "old").withColumnRenamed("new", column)


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """One entity per source, type and lower-case name: the one of the least id."""
    return first_of(entities.withColumn("__k", F.lower("name")), ["source_id", "type", "__k"], "id").drop("__k")


def delete_document(document_id, events: DataFrame, links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, links, entities) without a document's events and the entities that no other document shares."""
    gone = events.where(F.col("document_id") == document_id).select("event_id")
    kept_events = events.where(~F.col("document_id").eqNullSafe(document_id))
    kept_links = links.join(gone, "event_id", "left_anti")
    touched = links.join(gone, "event_id", "left_semi").select("entity_id").distinct()
    alone = touched.join(kept_links.select("entity_id"), "entity_id", "left_anti")
    return kept_events, kept_links, entities.join(alone, "entity_id", "left_anti")


def cascade(parents_gone: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each child table without the rows that point to a deleted parent (column id)."""
    return [c.join(parents_gone.select(F.col("id").alias(k)), k, "left_anti") for c, k in children]


def latest_document(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """sources with document_id filled by the newest document of each where it is null."""
    newest = first_of(documents, ["source_id"], F.col("created_at").desc(), F.col("id").desc()).select("source_id", F.col("id").alias("__d"))
    return sources.join(newest, "source_id", "left").withColumn("document_id", F.coalesce("document_id", "__d")).drop("__d")


def replace_partitions(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, plus new: an ingest that replaces what it brings."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_touch(parents: DataFrame, rows: DataFrame, key: str, at: str = "created_at") -> DataFrame:
    """parents with updated_at raised to their latest appended row."""
    last = rows.groupBy(key).agg(F.max(at).alias("__t"))
    return parents.join(last, parents["id"] == last[key], "left").withColumn("updated_at", F.greatest("updated_at", "__t")).drop("__t", key)


def missing_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks: what an index rebuild inserts."""
    return left.join(right.select(key), key, "left_anti")


def ring_buffer(logs: DataFrame, after: int | None = None, most: int = 500) -> DataFrame:
    """The newest `most` records (seq), each once, those after a sequence number if given."""
    last = logs.dropDuplicates(["seq"]).orderBy(F.col("seq").desc()).limit(most)
    return last if after is None else last.where(F.col("seq") > after)


#: Ids of imported records that are remembered.
REMEMBERED = 1000


def import_logs(logs: DataFrame, seen: DataFrame, incoming: DataFrame, most: int = 500, remembered: int = REMEMBERED) -> tuple[DataFrame, DataFrame]:
    """(the ring of logs with incoming records (id, at and others) that are new, numbered on from its last seq; the ids remembered after that).

    seen: id, at of records imported before.  A record whose id is remembered, or came earlier
    in the batch, is left out.  A batch of more than `remembered` ids is judged by what was
    remembered before it.
    """
    fresh = first_of(incoming.join(seen.select("id"), "id", "left_anti"), ["id"], "at")
    fresh = fresh.orderBy(F.col("at").desc(), F.col("id").desc()).limit(max(most, remembered))
    last = logs.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("at", "id"))  # at most the ring's or the memory's size
    numbered = fresh.withColumn("seq", place.cast("bigint")).join(F.broadcast(last), how="cross").withColumn("seq", F.col("seq") + F.col("last")).drop("last")
    ring = ring_buffer(logs.unionByName(numbered.select(*logs.columns)), most=most)
    memory = seen.select("id", "at").unionByName(fresh.select("id", "at")).orderBy(F.col("at").desc(), F.col("id").desc()).limit(remembered)
    return ring, memory


def key_lookup(keys: DataFrame, secret: str) -> DataFrame:
    """The enabled, unrevoked API key of a secret, by its SHA-256."""
    return keys.where((F.col("hash") == F.sha2(F.lit(secret).cast("binary"), 256)) & F.col("enabled") & F.col("revoked_at").isNull())


def merge_stores(ours: dict[str, DataFrame], theirs: dict[str, DataFrame], new_id=lambda c: F.concat(F.lit("m-"), c)) -> dict[str, DataFrame]:
    """documents, chunks, events, entities and links of our store with another's merged in; ids become strings.

    Their document takes the place of our live one of the same rel_path only if it is strictly
    newer, and then ours goes with its chunks, events and links; else what hangs on theirs hangs
    on ours.  Entities of one name and type are one.  Their rows get new ids, chunks and links
    without a parent go, events stay without a document.  Every step is a join on a key.

    documents: id, rel_path, updated_at, archived_at; chunks, events: id, document_id; entities:
    id, name, type; links: event_id, entity_id.  Other columns of ours and theirs must agree.
    """
    text = lambda t: {k: df.withColumns({c: F.col(c).cast("string") for c in df.columns if c == "id" or c.endswith("_id")}) for k, df in t.items()}
    ours, theirs = text(ours), text(theirs)
    live = ours["documents"].where("archived_at is null").select("rel_path", F.col("id").alias("__mine"), F.col("updated_at").alias("__at"))
    met = theirs["documents"].join(live, "rel_path", "left").withColumn("__stay", F.col("__mine").isNotNull() & (F.col("__at") >= F.col("updated_at")))
    met = met.withColumn("__new", F.when(F.col("__stay"), F.col("__mine")).otherwise(new_id(F.col("id"))))
    replaced = met.where("__mine is not null and not __stay").select(F.col("__mine").alias("document_id"))
    ids = met.select(F.col("id").alias("document_id"), F.col("__new").alias("__d"))
    brought = met.where("not __stay").withColumn("id", F.col("__new")).select(*ours["documents"].columns)
    out = {"documents": ours["documents"].join(replaced, F.col("id") == replaced["document_id"], "left_anti").unionByName(brought)}
    for name, how in (("chunks", "inner"), ("events", "left")):
        if name in ours:
            theirs_now = theirs[name].join(ids, "document_id", how).withColumns({"document_id": F.col("__d"), "id": new_id(F.col("id"))}).drop("__d")
            out[name] = ours[name].join(replaced, "document_id", "left_anti").unionByName(theirs_now)
    own = ours["entities"].groupBy("name", "type").agg(F.min("id").alias("__own"))
    first = theirs["entities"].groupBy("name", "type").agg(F.min("id").alias("__first")).join(own, ["name", "type"], "left")
    named = theirs["entities"].join(first, ["name", "type"]).withColumn("__e", F.coalesce("__own", new_id(F.col("__first"))))
    fresh = named.where("__own is null and id = __first").withColumn("id", F.col("__e")).select(*ours["entities"].columns)
    out["entities"] = ours["entities"].unionByName(fresh)
    gone = ours["events"].join(replaced, "document_id", "left_semi").select(F.col("id").alias("event_id"))
    known = theirs["events"].select(F.col("id").alias("event_id")).distinct()
    moved = theirs["links"].join(known, "event_id", "left_semi").join(named.select(F.col("id").alias("entity_id"), "__e"), "entity_id")
    moved = moved.withColumns({"event_id": new_id(F.col("event_id")), "entity_id": F.col("__e")}).drop("__e").dropDuplicates(["event_id", "entity_id"])
    out["links"] = ours["links"].join(gone, "event_id", "left_anti").unionByName(moved)
    return out
