"""Filters, joins, aggregates, windows, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rows, stats
from tessera.plans.registry import query, table


@query("""SELECT source, count(*)::bigint AS documents, count_if(coalesce(toxic, 0) <> 1)::bigint AS live FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def live_filter_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    events = d.select(F.col("doc_id").alias("event_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("deleted_at"))
    documents = d.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, F.lit("x")).alias("archived_at"))
    sources = d.select(F.col("source").alias("id")).distinct().withColumn("archived_at", F.lit(None).cast("string"))
    alive = rows.live(events, documents, sources).groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("live"))
    return d.groupBy("source").agg(F.count("*").alias("documents")).join(alive, "source", "left").fillna(0, ["live"])


@query("SELECT c_nationkey::bigint AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def linked_sources(spark, sf_dir):
    part = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id"))
    return rows.union_distinct(part("customer", "c_nationkey"), part("supplier", "s_nationkey"), table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id")))


@query("""WITH s AS (SELECT DISTINCT source AS id FROM documents WHERE source < 'src3'), d AS (SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1 AND source IN (FROM s))
SELECT (SELECT count(*) FROM d)::bigint AS documents, (SELECT count(*) FROM conversations WHERE conv_id IN (SELECT doc_id FROM d))::bigint AS chunks,
(SELECT count(*) FROM events WHERE event_type <> 'error' AND user_id IN (SELECT doc_id FROM d))::bigint AS events, (SELECT count(DISTINCT lang || source) FROM documents WHERE source IN (FROM s))::bigint AS entities""")
def project_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    documents = d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.when(F.col("toxic") == 1, F.lit("x")).alias("archived_at"))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "error", F.lit("x")).alias("deleted_at"))
    entities = d.select(F.concat("lang", "source").alias("id"), F.col("source").alias("source_id"))
    return stats.project_stats(d.where("source < 'src3'").select(F.col("source").alias("id")).distinct(), documents, chunks, events, entities)


@query("""SELECT user_id, count_if(event_type = 'signup')::bigint AS signup, count_if(event_type = 'purchase')::bigint AS purchase, count_if(event_type = 'error')::bigint AS error, count(*)::bigint AS total FROM events GROUP BY user_id""")
def status_summary(spark, sf_dir):
    return stats.status_record(table(spark, sf_dir, "events"), "user_id", "event_type", ["signup", "purchase", "error"])


@query("""SELECT c_custkey, coalesce(n, 0)::bigint AS fallbacks FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def fallback_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return stats.filtered_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") == "F", "fallbacks")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_run(spark, sf_dir):
    return rows.latest_per(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


_PAGE = [("ts", True), ("event_id", True)]


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def keyset_page_1(spark, sf_dir):
    return rows.keyset_page(table(spark, sf_dir, "events"), _PAGE, 50).select("event_id", "user_id")


@query("WITH l AS (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 49) SELECT e.event_id, e.user_id FROM events e, l WHERE (e.ts, e.event_id) < (l.ts, l.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 50")
def keyset_page_2(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    page = rows.keyset_page(events, _PAGE, 50).collect()  # one page
    return rows.keyset_page(events, _PAGE, 50, rows.decode_cursor(rows.next_cursor(page, _PAGE, 50))).select("event_id", "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 25")
def keyset_by_id(spark, sf_dir):
    return rows.keyset_page(table(spark, sf_dir, "part"), [("p_partkey", False)], 25, {"p_partkey": 100}).select("p_partkey", "p_name")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return rows.offset_page(table(spark, sf_dir, "events"), [F.col("ts").desc(), "event_id"], 20, 40).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def recent_failures(spark, sf_dir):
    return rows.recent_failures(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "ts", 20, "event_id").select("event_id", "user_id")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END, n_regionkey DESC, n_nationkey LIMIT 1")
def priority_order(spark, sf_dir):
    return table(spark, sf_dir, "nation").orderBy(F.when(F.col("n_regionkey") == 2, 0).otherwise(1), F.col("n_regionkey").desc(), "n_nationkey").limit(1).select("n_nationkey", "n_name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def missing_ids(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("archived_at"))
    return rows.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), have)


@query("SELECT n_name, r_name, count(*)::bigint AS customers, round(avg(c_acctbal), 4) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_chain(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1""")
def latest_document_per_source(spark, sf_dir):
    return rows.latest_per(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id").select("source", "doc_id")


@query("""SELECT user_id, n_all::bigint AS total, n_bad::bigint AS failed, CASE WHEN n_all = 0 THEN -1 ELSE least(100, greatest(0, round(100 * n_bad / n_all)))::int END AS percent, CASE WHEN n_bad > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM (SELECT user_id, count(*) AS n_all, count_if(event_type = 'error') AS n_bad FROM events GROUP BY user_id)""")
def queue_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return e.select("user_id", "total", "failed", stats.progress(F.col("failed"), F.col("total")).alias("percent"), stats.run_status(F.lit(None), F.col("failed")).alias("status"))


@query("SELECT count(*)::bigint AS chunks, (SELECT count(*) FROM embeddings)::bigint AS vectors, count_if(doc_id NOT IN (SELECT vec_id FROM embeddings))::bigint AS missing FROM documents")
def index_drift(spark, sf_dir):
    return stats.index_drift(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("""SELECT user_id, count(*)::bigint AS n FROM (SELECT user_id, ts, event_type, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events) WHERE event_type IN ('error', 'click') GROUP BY user_id, i HAVING count(*) >= 3""")
def failure_streaks(spark, sf_dir):
    s = stats.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "click"))
    return s.where("n >= 3").select("user_id", "n")


@query("""SELECT c_custkey, r.event_type AS run_status, coalesce(r.event_id % 5, 0)::bigint AS stats_added, coalesce(r.event_id % 3, 0)::bigint AS stats_failed FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) r ON r.user_id = c_custkey""")
def folder_summary(spark, sf_dir):
    e = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(e.alias("id"), F.col("user_id").alias("folder_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), (e % 5).alias("stats_added"), F.lit(0).alias("stats_updated"), F.lit(0).alias("stats_deleted"), (e % 3).alias("stats_failed"))
    out = stats.folder_summary(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), runs.withColumnRenamed("id", "run").withColumn("id", F.col("run")))
    return out.select(F.col("id").alias("c_custkey"), "run_status", "stats_added", "stats_failed")
