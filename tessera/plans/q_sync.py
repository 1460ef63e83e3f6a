"""Synchronisation, merging, sessions and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import manifest, merge
from tessera.plans.registry import query, table
from tessera.sources import files
from tessera.streaming import folders

_CUT = "timestamp '2024-06-01 00:00:00'"


def _files(spark, sf_dir, text):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rel_path"), F.length(text).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("mtime_ms"), F.lit(0).cast("long").alias("inode"), F.sha1(text.cast("binary")).alias("sha1"))


@query("""WITH a AS (SELECT doc_id, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 2), b AS (SELECT doc_id, sha1(CASE WHEN doc_id % 10 = 1 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id AS rel_path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def file_diff(spark, sf_dir):
    """Two states of a folder made from one table: the later lacks every tenth file, has others anew and others changed."""
    old = _files(spark, sf_dir, F.col("text")).where("rel_path % 10 <> 2").withColumn("last_event", F.lit("synced"))
    new = _files(spark, sf_dir, F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).where("rel_path % 10 <> 0")
    return manifest.diff(old, new)


@query("SELECT coalesce(o.event_id // 2, n.event_id // 2) AS k, CASE WHEN n.event_id IS NULL THEN o.event_type ELSE nullif(n.event_type, 'view') END AS event_type, coalesce(nullif(n.event_type, 'click'), o.user_id::varchar) AS note FROM (SELECT * FROM events WHERE event_id % 2 = 0) o FULL JOIN (SELECT * FROM events WHERE event_id % 2 = 1) n ON o.event_id // 2 = n.event_id // 2")
def manifest_upsert(spark, sf_dir):
    """event_type is overwritten, with null too; note is only where the new row has one."""
    e = table(spark, sf_dir, "events").withColumn("k", F.expr("event_id div 2"))
    old = e.where("event_id % 2 = 0").select("k", "event_type", F.col("user_id").cast("string").alias("note"))
    new = e.where("event_id % 2 = 1").select("k", F.nullif("event_type", F.lit("view")).alias("event_type"), F.nullif("event_type", F.lit("click")).alias("note"))
    return manifest.upsert(old, new, ["k"], overwrite=["event_type"])


@query("SELECT event_type AS last_event, count(*)::bigint AS n FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'syncing' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def state_transition(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("view", "click"), "pending").otherwise(F.col("event_type")).alias("last_event"))
    return manifest.transition(e, "syncing")[0].groupBy("last_event").agg(F.count("*").alias("n"))


@query(f"SELECT status, count(*)::bigint AS n FROM (SELECT CASE WHEN event_type = 'view' AND epoch({_CUT}) - epoch(ts) > 1800 THEN 'abandoned' WHEN event_type = 'view' THEN 'running' ELSE event_type END AS status FROM events) GROUP BY status")
def stale_reaper(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("started_at"))
    return manifest.reap_runs(e, F.expr("timestamp_ntz'2024-06-01 00:00:00'")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT event_id FROM events WHERE NOT (event_type = 'error' AND ts < {_CUT})")
def tombstone_purge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "deleted").otherwise("synced").alias("last_event"), F.col("ts").alias("last_seen_at"))
    return manifest.purge(e, F.expr("timestamp_ntz'2024-06-01 00:00:00'")).select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_type IN ('error', 'purchase') THEN 'enqueued' ELSE 'skipped' END AS outcome FROM events""")
def retry_plan(spark, sf_dir):
    return _retries(table(spark, sf_dir, "events"))


def _retries(events):
    e = events.withColumnRenamed("event_id", "rel_path")
    states = e.select("rel_path", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "synced").otherwise("pending").alias("last_event"))
    out = manifest.retry_outcomes(e.select("rel_path"), states, e.where("rel_path % 7 <> 0").select("rel_path"))
    return out.select(F.col("rel_path").alias("event_id"), "outcome")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)) WHERE n = 1")
def keyed_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return manifest.queue(e, ["user_id"], "ts", "event_id", e.where("event_type = 'error' and value > 200").select("user_id").distinct()).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2, event_id) AS n FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id) AS m FROM events) WHERE m = 1) WHERE n = 1""")
def merge_lww(spark, sf_dir):
    from tessera.operators.rows import first_of

    side = lambda r: first_of(table(spark, sf_dir, "events").where(F.col("event_id") % 2 == r), ["user_id"], F.col("ts").desc(), "event_id").select("user_id", "event_id", "ts")
    return merge.last_writer_wins(side(0), side(1), ["user_id"], "ts").select("user_id", "event_id")


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_suppkey = 1), t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (FROM g)), s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey NOT IN (FROM g))
SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM t WHERE l_partkey NOT IN (FROM s))""")
def delete_unshared(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    gone = l.where("l_suppkey = 1").select(F.col("l_orderkey").alias("event_id"), F.lit(1).alias("document_id")).distinct()
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")).join(gone, "event_id", "left")
    links = l.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    return merge.delete_document(1, events, links, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")))[2]


@query("SELECT l_orderkey + 1000000 AS l_orderkey, count(*)::bigint AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def id_remap(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") + 1_000_000).alias("new"))
    return merge.remap(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), ids, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return merge.cascade(gone, (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey"))[0]


@query("SELECT min(c_custkey) AS id, c_nationkey::bigint AS source_id, c_mktsegment AS type FROM customer GROUP BY c_nationkey, c_mktsegment")
def dedupe_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("source_id"), F.col("c_mktsegment").alias("type"), F.lit("Same").alias("name"))
    return merge.dedupe_entities(c).drop("name")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::bigint AS started, count(*)::bigint AS n FROM s GROUP BY user_id, k""")
def session_debounce(spark, sf_dir):
    return folders.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes").select("user_id", F.unix_timestamp("started").alias("started"), "n")


@query("SELECT event_type, epoch(date_trunc('minute', ts))::bigint AS started, count(*)::bigint AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_window(spark, sf_dir):
    return folders.rate_limited(table(spark, sf_dir, "events"), "event_type", "ts", 1).select("event_type", F.unix_timestamp("started").alias("started"), "n")


@query("SELECT page_id, sha1(html) AS sha1, octet_length(encode(html))::bigint AS size_bytes FROM pages")
def content_hash(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("size_bytes"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def file_filter(spark, sf_dir):
    """Paths made from ids: a temporary file, an accepted and an excluded one in turn."""
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a/~$"), "doc_id", F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a/"), "doc_id", F.lit(".MD"))).otherwise(F.concat(F.lit("a/.git/"), "doc_id", F.lit(".md")))
    d = table(spark, sf_dir, "documents").select("doc_id", p.alias("path"))
    return d.where(files.included(F.col("path"), ["md", ".txt"]) & ~files.excluded(F.col("path"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def rebuild_index(spark, sf_dir):
    return merge.missing_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
