"""Streams over the given tables, run to their end, and the batch side of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.plans.storage import new_folder
from tessera.streaming import folders, states

_TO = {"signup": "pending", "view": "syncing", "purchase": "synced", "click": "partial", "error": "failed"}
_AFTER = f"""WITH RECURSIVE q AS (SELECT user_id, event_id, ts, {"CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TO.items())} END AS want, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::bigint AS i, NULL::varchar AS status, NULL::bigint AS doc, NULL::bigint AS err, NULL::timestamp AS began, 0::bigint AS n FROM (SELECT DISTINCT user_id FROM q)
UNION ALL SELECT user_id, i, CASE WHEN ok THEN want ELSE status END, CASE WHEN ok AND want = 'syncing' THEN NULL WHEN ok AND want IN ('synced', 'partial') THEN event_id ELSE doc END,
  CASE WHEN ok AND want = 'syncing' THEN NULL WHEN ok AND want = 'failed' THEN event_id ELSE err END, CASE WHEN ok AND want = 'syncing' THEN ts ELSE began END, n + ok::bigint
  FROM (SELECT *, status IS NULL OR CASE want WHEN 'pending' THEN status IN ('failed', 'synced', 'partial') WHEN 'syncing' THEN status = 'pending' WHEN 'failed' THEN status IN ('pending', 'syncing') ELSE status = 'syncing' END AS ok
    FROM (SELECT q.user_id, q.i, q.ts, q.event_id, q.want, CASE WHEN old THEN 'pending' ELSE status END AS status, CASE WHEN NOT coalesce(old, false) THEN doc END AS doc, err, began, n
      FROM (SELECT s.*, q.ts AS now, status = 'syncing' AND q.ts - began > interval 60 minutes AS old FROM s JOIN q ON q.user_id = s.user_id AND q.i = s.i + 1) x JOIN q ON q.user_id = x.user_id AND q.i = x.i + 1))),
z AS (SELECT *, status = 'syncing' AND (SELECT max(ts) FROM events) - began > interval 60 minutes AS old FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id, CASE WHEN old THEN 'pending' ELSE status END AS status, CASE WHEN NOT coalesce(old, false) THEN doc END AS document_id, err AS last_error, n AS n_moved FROM z"""


def _requests(events):
    """Events as requests of one file for each user; their type is the state that they ask for."""
    to = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _TO.items()])
    own = F.col("event_id").cast("string")
    return events.select(F.lit("f").alias("folder_id"), F.col("user_id").cast("string").alias("rel_path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), to.alias("to"), own.alias("document_id"), own.alias("sha1"), own.alias("error"))


def _told(df):
    number = lambda c: F.col(c).cast("bigint").alias(c)
    return df.select(F.col("rel_path").cast("bigint").alias("user_id"), "status", number("document_id"), number("last_error"), "n_moved")


@query(_AFTER)
def file_states(spark, sf_dir):
    """The states that all requests lead to, in column functions."""
    e = table(spark, sf_dir, "events")
    until = F.lit(e.agg(F.max("ts").cast("timestamp")).first()[0]).cast("timestamp")
    return _told(states.states_after(_requests(e), until))


def _streamed(spark, path: str):
    """A table, a file or a folder of them, as a stream; the pattern names it alone, since the source takes no single file by its name."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query(_AFTER)
def file_states_stream(spark, sf_dir):
    """The same from a stream: keyed state and timers, each batch's moves folded into a table of states."""
    moves = states.file_states(_requests(_streamed(spark, f"{sf_dir}/events.parquet")))
    out = new_folder(spark, "file-states")
    order = [F.col("n_moved").desc(), F.col("seq").desc_nulls_first()]  # a sync given up counts after what led to it
    with states.state_store(spark):
        run = folders.upsert_stream(moves, f"{out}/table", ["folder_id", "rel_path"], order, f"{out}/checkpoint", ["status", "document_id", "sha1", "last_error", "n_moved"], 8)
        run.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return _told(folders.folded(spark, f"{out}/table"))


@query()
def folder_queues(spark, sf_dir):
    """Requests of users' files in a queue for each type of event; every third event ends the work on its user's file."""
    e = _streamed(spark, f"{sf_dir}/events.parquet")
    arrivals = e.select(F.col("event_type").alias("folder_id"), F.col("user_id").cast("string").alias("rel_path"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "finished").otherwise("updated").alias("kind"))
    out = new_folder(spark, "queues")
    with states.state_store(spark):
        run = states.folder_queues(arrivals, 20, 2).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.OUTCOME).parquet(f"{out}/table")
