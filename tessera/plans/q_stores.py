"""Updates, leases, logs, keys, sessions, containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import model_output as M
from tessera.operators import ingest, manifest, merge, rows, sequence, stats
from tessera.plans import q_text  # noqa: F401 - its SQL is used below
from tessera.plans.registry import ORACLE, query, table
from tessera.plans.storage import new_folder
from tessera.sources import files, readers, tree


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_id > 9700")
def ring_buffer(spark, sf_dir):
    logs = table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    return merge.ring_buffer(logs, after=9700).select(F.col("seq").alias("event_id"), "user_id")


@query("SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007' AND c_acctbal > -1000000")
def key_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", M.key_hash(F.col("c_name")).alias("hash"), F.lit(True).alias("enabled"), F.lit(None).alias("revoked_at"))
    return merge.key_lookup(keys, "Customer#000000007").select("c_custkey")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND (event_id % 3 = 0 OR ts < timestamp '2024-01-15 00:00:00' - interval 5 minutes) ORDER BY event_id LIMIT 100")
def claim_with_lease(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("locked_at"))
    return manifest.claim(e, 100, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select(F.col("id").alias("event_id"))


@query("SELECT o_orderstatus AS status, count(*)::bigint AS n, count_if(o_orderpriority IS NULL)::bigint AS cleared FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders) GROUP BY 1")
def partial_update(spark, sf_dir):
    o = manifest.partial_update(table(spark, sf_dir, "orders"), F.col("o_custkey") % 2 == 0, o_orderstatus=F.lit("X"), o_orderpriority=F.lit(None))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").isNull()).alias("cleared"))


@query("SELECT user_id, count(*)::bigint AS archived FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def archive_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("archived_at", F.when(F.col("event_type") == "click", F.col("ts")))
    return manifest.archive(e, F.col("event_type") == "error", F.expr("timestamp_ntz'2024-06-01 00:00:00'")).where("archived_at is not null").groupBy("user_id").agg(F.count("*").alias("archived"))


@query("SELECT event_id, map_extract_value(MAP {'k': props->>'$.k', 'type': event_type}, 'k') AS k, event_type AS type FROM events")
def merge_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = F.create_map(F.lit("k"), F.lit("old"), F.lit("type"), F.col("event_type"))
    got = manifest.merge_metadata(old, F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    return e.select("event_id", got["k"].alias("k"), got["type"].alias("type"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*)::bigint AS n FROM conversations GROUP BY conv_id")
def session_detail(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sessions = c.select(F.col("conv_id").alias("session_id")).distinct()
    messages = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    return ingest.session_detail(sessions, messages).select(F.col("session_id").alias("conv_id"), F.array_join("messages.role", ",").alias("roles"), F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, max(turn) AS updated FROM conversations GROUP BY conv_id")
def append_touch(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parents = c.select(F.col("conv_id").alias("id"), F.lit(0).cast("long").alias("updated_at")).distinct()
    return merge.append_touch(parents, c.select("conv_id", F.col("turn").alias("created_at")), "conv_id").select(F.col("id").alias("conv_id"), F.col("updated_at").alias("updated"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'zip' WHEN page_id % 3 = 1 THEN 'ole2' ELSE 'other' END AS container, page_id % 3 = 1 AS fake FROM pages")
def container_sniff(spark, sf_dir):
    head = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("504B0304"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.lit(b""))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.col("html").cast("binary")).alias("content"), F.when(F.col("page_id") % 3 == 2, "a.md").otherwise("a.docx").alias("path"))
    return p.select("page_id", files.container(F.col("content")).alias("container"), files.is_fake(F.col("path"), F.col("content")).alias("fake"))


@query("SELECT sum(l_quantity)::bigint AS added, 0::bigint AS updated, 0::bigint AS deleted, count_if(l_returnflag = 'A')::bigint AS failed_or_partial FROM lineitem")
def run_totals(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    zero = F.lit(0).cast("long")
    runs = l.select(F.col("l_quantity").cast("long").alias("stats_added"), zero.alias("stats_updated"), zero.alias("stats_deleted"), F.when(F.col("l_returnflag") == "A", "failed").otherwise("completed").alias("status"))
    return stats.run_totals(runs)


@query("SELECT doc_id, row_number() OVER (ORDER BY source, lang, n_chars, doc_id) - 1 AS place FROM documents")
def global_ranks(spark, sf_dir):
    return sequence.global_ranks(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "source", "lang", "n_chars", "doc_id").select("doc_id", "place")


@query("""WITH RECURSIVE d AS (SELECT doc_id, ceil(length(text) / 2)::bigint AS n, row_number() OVER (ORDER BY lang, doc_id) AS i FROM documents),
w AS (SELECT i, doc_id, n AS s, 0::bigint AS batch FROM d WHERE i = 1 UNION ALL SELECT d.i, d.doc_id, CASE WHEN s + n > 2000 THEN n ELSE s + n END, batch + (s + n > 2000)::bigint FROM w JOIN d ON d.i = w.i + 1)
SELECT doc_id, batch FROM w""")
def token_batches(spark, sf_dir):
    """Texts for an embedding service: batches of at most 2,000 estimated tokens over the whole table."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size"))
    return sequence.budget_batches(d, F.ceil(F.col("size") / 2), 2000, "lang", "doc_id").select("doc_id", "batch")


@query("SELECT lang, source, count(*) AS n_lines, md5(string_agg(md5(text), chr(10) ORDER BY doc_id) || chr(10)) AS content FROM documents GROUP BY ALL")
def files_read_back(spark, sf_dir):
    """The hashes of each language's and source's texts written as a file, listed as a tree, read by the reader that takes it."""
    d, out = table(spark, sf_dir, "documents"), new_folder(spark, "files")
    lines = d.select(F.col("lang").alias("l"), F.col("source").alias("s"), "doc_id", F.md5(F.col("text").cast("binary")).alias("value")).repartition("l", "s").sortWithinPartitions("l", "s", "doc_id")
    lines.select("value", "l", "s").write.partitionBy("l", "s").option("maxRecordsPerFile", 0).text(out)
    listed, _ = tree.list_tree(spark, out, ["txt"])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out)
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    found = found.join(listed.select("name"), name(F.col("path")) == F.col("name"), "left_semi")
    got = readers.read_files(found)
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1)
    return got.select(part("l").alias("lang"), part("s").alias("source"), F.regexp_count("text", F.lit("\n")).cast("bigint").alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("content"))


@query(f"SELECT * FROM ({ORACLE['chunk_documents']}) WHERE doc_id % 10 <> 0")
def ingested_chunks(spark, sf_dir):
    """Two commits of a store: all documents, a tenth of them in another state; then that tenth as it is, and another tenth removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    store = ingest.open_store(spark, new_folder(spark, "store"), "bigint", 4)
    ingest.ingest_batch(store, d.withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("# Old\n"), "text")).otherwise(F.col("text"))))
    version = ingest.ingest_batch(store, d.where("doc_id % 10 = 1"), d.where("doc_id % 10 = 0"))
    return store.read("chunks", version).select("doc_id", "rank", "heading", F.length("content").alias("size"), F.md5(F.col("content").cast("binary")).alias("content"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def optional_filters(spark, sf_dir):
    return rows.filters(table(spark, sf_dir, "customer"), rows.one_of("c_mktsegment", ["BUILDING", "MACHINERY"]), rows.one_of("c_nationkey", None), F.col("c_acctbal") >= 5000).select("c_custkey")


@query("""WITH d AS (SELECT c_custkey AS k, c_custkey % 3 AS r, c_acctbal >= 5000 AS newer FROM customer), gone AS (SELECT k FROM d WHERE r = 2 AND NOT newer),
ids AS (SELECT k, CASE WHEN r = 2 AND newer THEN k::varchar ELSE 'm-' || k END AS id FROM d WHERE r <> 1),
own AS (SELECT p_name, p_brand, min(p_partkey::varchar) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), fresh AS (SELECT p_name, p_brand, 'm-' || min(p_partkey::varchar) AS id FROM part GROUP BY ALL),
names AS (SELECT p_partkey, coalesce(o.id, f.id) AS id FROM part p JOIN fresh f ON f.p_name = p.p_name AND f.p_brand = p.p_brand LEFT JOIN own o ON o.p_name = p.p_name AND o.p_brand = p.p_brand)
SELECT 'document' AS kind, k::varchar AS id, NULL AS other FROM d WHERE r <> 0 AND k NOT IN (FROM gone) UNION ALL SELECT 'document', id, NULL FROM ids WHERE starts_with(id, 'm-')
UNION ALL SELECT 'event', o_orderkey::varchar, o_custkey::varchar FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (FROM gone) UNION ALL SELECT 'event', 'm-' || o_orderkey, ids.id FROM orders LEFT JOIN ids ON k = o_custkey WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'chunk', o_orderkey::varchar, o_custkey::varchar FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (FROM gone) UNION ALL SELECT 'chunk', 'm-' || o_orderkey, ids.id FROM orders JOIN ids ON k = o_custkey WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'entity', p_partkey::varchar, NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT 'entity', id, NULL FROM names WHERE starts_with(id, 'm-')
UNION ALL SELECT DISTINCT 'link', l_orderkey::varchar, l_partkey::varchar FROM lineitem WHERE l_orderkey % 2 = 1 AND l_partkey % 2 = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
UNION ALL SELECT DISTINCT 'link', 'm-' || l_orderkey, n.id FROM lineitem JOIN names n ON n.p_partkey = l_partkey WHERE l_orderkey % 2 = 0""")
def merged_stores(spark, sf_dir):
    """Ours: two thirds of the customers as documents, odd orders, even parts; theirs: another two thirds, even orders, all parts."""
    c, o, p, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "part", "lineitem"))

    def store(docs, at, odd: int, parts, links):
        hung = o.where(F.col("o_orderkey") % 2 == odd).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
        return {
            "documents": docs.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("rel_path"), at.alias("updated_at"), F.lit(None).cast("string").alias("archived_at")),
            "events": hung, "chunks": hung, "entities": parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type")),
            "links": links.where(F.col("l_orderkey") % 2 == odd).select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct(),
        }

    ours = store(c.where("c_custkey % 3 <> 0"), F.col("c_acctbal"), 1, p.where("p_partkey % 2 = 0"), l.where("l_partkey % 2 = 0"))
    got = merge.merge_stores(ours, store(c.where("c_custkey % 3 <> 1"), F.lit(5000.0), 0, p, l))
    shown = {"documents": ("document", "id", None), "events": ("event", "id", "document_id"), "chunks": ("chunk", "id", "document_id"), "entities": ("entity", "id", None), "links": ("link", "event_id", "entity_id")}
    parts = [got[t].select(F.lit(kind).alias("kind"), F.col(a).alias("id"), (F.col(b) if b else F.lit(None).cast("string")).alias("other")) for t, (kind, a, b) in shown.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 AND n_regionkey = 1 THEN 'new ' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 1 AND n_regionkey = 1 THEN 'a=1,b=3,c=4' ELSE 'a=1,b=2' END AS metadata, n_regionkey = 1 AND c_custkey % 2 = 1 AS touched FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def updated_documents(spark, sf_dir):
    """Customers as documents of nations as sources of regions as tenants: every second gets metadata, every fourth a title, if it is of region 1."""
    c = table(spark, sf_dir, "customer")
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    documents = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("title"), pairs("a", "1", "b", "2").alias("metadata"), F.lit(0).alias("updated_at"))
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("tenant_id"))
    updates = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" new "), "c_custkey")).otherwise("  ").alias("title"), pairs("b", "3", "c", "4").alias("metadata"))
    got = manifest.update_documents(documents, sources, updates, "1", F.lit(1))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return got.select("id", "title", told.alias("metadata"), (F.col("updated_at") == 1).alias("touched"))


@query("""WITH m AS (SELECT DISTINCT c_nationkey AS p, c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN 'upload' ELSE 'folder' END AS kind FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0), o AS (SELECT o_custkey AS s, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS s, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT n_nationkey AS project_id, coalesce(sum(o.n) FILTER (kind = 'folder'), 0)::bigint AS cached_documents, coalesce(sum(o.n) FILTER (kind = 'upload'), 0)::bigint AS cached_upload_documents,
coalesce(sum(l.n) FILTER (kind = 'folder'), 0)::bigint AS cached_chunks, coalesce(sum(l.n) FILTER (kind = 'upload'), 0)::bigint AS cached_upload_chunks FROM nation LEFT JOIN m ON p = n_nationkey LEFT JOIN o ON o.s = m.s LEFT JOIN l ON l.s = m.s GROUP BY 1""")
def project_counts(spark, sf_dir):
    """Nations as projects, customers as their folders and uploads, orders as documents, line items as chunks."""
    c = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), c.alias("source_id"), F.when(c % 3 == 0, "upload").otherwise("folder").alias("source_type"), (c % 2 == 0).alias("enabled"))
    o = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source_id")), "l_orderkey").select("source_id")
    projects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"))
    got = ingest.project_counts(projects, members, {"documents": o.select(F.col("o_custkey").alias("source_id")), "chunks": items}, F.current_timestamp())
    return got.drop("cached_updated_at")


@query("""WITH f AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) SELECT doc_id AS rel_path, CASE WHEN n > 2000 THEN 'synced' ELSE 'pending' END AS last_event, CASE WHEN n > 2000 THEN 'skipped: ' || n || ' bytes over 2000' WHEN doc_id % 2 = 0 THEN 'old' END AS last_error,
CASE WHEN n > 2000 THEN n ELSE -1 END::bigint AS size_bytes FROM f WHERE doc_id % 2 = 0 OR n > 2000""")
def skipped_in_manifest(spark, sf_dir):
    """Every second file is in the manifest; too large ones are put there as synced, with the reason."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel_path"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    old = d.where("rel_path % 2 = 0").select("rel_path", F.lit(-1).cast("bigint").alias("size_bytes"), F.lit("pending").alias("last_event"), F.lit("old").alias("last_error"))
    return manifest.record_skipped(old, d, files.skip_reason(F.col("size_bytes"), 2000, 5000), ["rel_path"])


@query("""WITH e AS (SELECT user_id, event_type IN ('error', 'click') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), g AS (SELECT user_id, coalesce(min(n) FILTER (NOT bad), count(*) + 1) - 1 AS n FROM e GROUP BY 1) SELECT user_id, n::bigint AS n FROM g WHERE n >= 2""")
def folders_to_stop(spark, sf_dir):
    """Users whose last two events or more are failures."""
    return stats.to_stop(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "click"), 2)
