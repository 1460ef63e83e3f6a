"""Details, listings, runs, repairs, answers, and the search of several routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import model_output as M
from tessera.operators import details, graph, pages, rows, stats
from tessera.plans import search as S
from tessera.plans.q_retrieval import _query_vector
from tessera.plans.registry import query, table


def _store(spark, sf_dir) -> dict:
    """Orders as events of customers (documents) of nations (sources); parts are entities, pages stand for chunks."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    of = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("source_id"))
    events = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 60).alias("chunk_id"), (F.col("o_orderkey") % 7).cast("int").alias("rank"), F.when(F.col("o_orderstatus") == "F", F.lit("x")).alias("deleted_at"))
    return {
        "events": events.join(of, "document_id"),
        "documents": c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") < 0, F.lit("x")).alias("archived_at")),
        "sources": n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, F.lit("x")).alias("archived_at")),
        "entities": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("int").alias("source_id"), F.col("p_brand").alias("type"), F.col("p_name").alias("name")),
        "links": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")),
        "chunks": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("heading"), F.col("html").alias("content")),
    }


_EV = """ev AS (SELECT o_orderkey AS id, o_custkey AS document_id, c_nationkey AS source_id, o_orderkey % 60 AS chunk_id, (o_orderkey % 7)::int AS rank, o_orderstatus = 'F' AS gone, c_acctbal < 0 AS filed, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey),
li AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem),
en AS (SELECT event_id, count(*)::bigint AS n, md5(string_agg(p_name || ':' || p_partkey, '|' ORDER BY p_brand, p_name, p_partkey)) AS names FROM li JOIN part ON p_partkey = entity_id GROUP BY event_id)"""


def _names():
    return F.md5(F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["name"], e["id"])), "|").cast("binary"))


@query(f"""WITH {_EV} SELECT ev.id, n_name AS source, title, url AS heading, coalesce(n, 0)::bigint AS n_entities, coalesce(names, md5('')) AS names
FROM ev JOIN nation ON n_nationkey = source_id LEFT JOIN pages ON page_id = chunk_id LEFT JOIN en ON event_id = ev.id WHERE NOT gone AND NOT filed AND n_regionkey <> 2""")
def event_details(spark, sf_dir):
    s = _store(spark, sf_dir)
    out = details.event_details(s["events"], s["sources"], s["documents"], s["chunks"], s["links"], s["entities"])
    return out.select("id", F.col("source_name").alias("source"), F.col("document_title").alias("title"), F.col("chunk_heading").alias("heading"), F.size("entities").cast("long").alias("n_entities"), _names().alias("names"))


@query(f"""WITH {_EV} SELECT p_partkey AS id, n_name AS source, count(*)::bigint AS event_count, md5(string_agg(rank || ':' || ev.id, '|' ORDER BY rank, ev.id)) AS events
FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN li ON entity_id = p_partkey JOIN ev ON ev.id = event_id WHERE NOT gone AND NOT filed AND n_regionkey <> 2 GROUP BY ALL""")
def entity_details(spark, sf_dir):
    s = _store(spark, sf_dir)
    out = details.entity_details(s["entities"], s["sources"], s["events"], s["documents"], s["links"])
    told = F.md5(F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["rank"], e["id"])), "|").cast("binary"))
    return out.select("id", F.col("source_name").alias("source"), "event_count", told.alias("events"))


@query("SELECT c_custkey AS id, c_name AS title, n_name AS source, c_acctbal < 0 AS archived FROM customer JOIN nation ON n_nationkey = c_nationkey")
def document_details(spark, sf_dir):
    s = _store(spark, sf_dir)
    return details.document_details(s["documents"], s["sources"]).select("id", "title", F.col("source_name").alias("source"), F.col("archived_at").isNotNull().alias("archived"))


@query(f"WITH {_EV} SELECT document_id, rank, ev.id, coalesce(n, 0)::bigint AS entity_count FROM ev LEFT JOIN en ON event_id = ev.id WHERE NOT gone")
def event_listing(spark, sf_dir):
    s = _store(spark, sf_dir)
    return details.event_listing(s["events"], s["links"], s["entities"]).select("document_id", "rank", "id", "entity_count")


@query(f"WITH {_EV} SELECT document_id, entity_id, p_name AS name, count(*)::bigint AS event_count FROM li JOIN ev ON ev.id = event_id JOIN part ON p_partkey = entity_id WHERE NOT gone GROUP BY ALL")
def entity_listing(spark, sf_dir):
    s = _store(spark, sf_dir)
    return details.entity_listing(s["entities"], s["links"], s["events"]).select("document_id", "entity_id", "name", "event_count")


@query("SELECT conv_id AS document_id, turn::int AS rank, conv_id * 1000 + turn AS id, role AS heading, len(embedding)::int AS dimension FROM conversations LEFT JOIN embeddings ON vec_id = conv_id * 1000 + turn")
def chunk_listing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("heading"), F.col("text").alias("content"))
    out = details.chunk_listing(c, table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"))
    return out.select("document_id", "rank", "id", "heading", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimension"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, (SELECT count(*) FROM events WHERE event_type = 'error')::bigint AS total FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50)")
def page_with_total(spark, sf_dir):
    mine = details.lookup(table(spark, sf_dir, "events"), event_type="error")
    page = rows.keyset_page(mine, [("ts", True), ("event_id", True)], 50)
    return details.page_with_total(mine, page).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "total")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_log(spark, sf_dir):
    return details.newest(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id")


@query("""SELECT event_id AS id, coalesce('n' || c_nationkey, 'unknown') AS tenant_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'completed' ELSE 'running' END AS status,
CASE WHEN event_type IN ('error', 'click') THEN event_id % 10 END::bigint AS stats_added, CASE WHEN event_type = 'error' THEN 'broke' END AS error, event_type IN ('error', 'click') AS ended FROM events LEFT JOIN customer ON c_custkey = user_id""")
def run_lifecycle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    folders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("tenant_id"))
    none = spark.createDataFrame([], "id bigint, folder_id bigint, trigger string, tenant_id string, status string, started_at timestamp, completed_at timestamp, stats_added bigint, error string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    begun = details.start_runs(none, e.select(F.col("event_id").alias("id"), F.col("user_id").alias("folder_id"), F.lit("scan").alias("trigger")), folders, now)
    failed = F.col("event_type") == "error"
    ended = e.where("event_type in ('error', 'click')").select(F.col("event_id").alias("id"), F.when(failed, "failed").otherwise("completed").alias("status"), (F.col("event_id") % 10).alias("stats_added"), F.when(failed, "broke").alias("error"))
    return details.finish_runs(begun, ended, now).select("id", "tenant_id", "status", "stats_added", "error", F.col("completed_at").isNotNull().alias("ended"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'never' WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'ok' END AS last_scan_status, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'gone' END AS last_scan_error FROM customer")
def folder_scans(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    folders = c.select("id", F.lit(None).cast("timestamp").alias("last_scan_at"), F.lit("never").alias("last_scan_status"), F.lit(None).cast("string").alias("last_scan_error"), F.lit(None).cast("timestamp").alias("updated_at"))
    scans = c.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "gone").alias("error"))
    return details.scanned(folders, scans, F.lit("2024-06-01 00:00:00").cast("timestamp")).select("id", "last_scan_status", "last_scan_error")


@query("SELECT o_orderkey AS id, o_custkey % 30 AS source_id, CASE WHEN c_custkey IS NOT NULL THEN o_orderkey % 200 END AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % 200 WHERE o_custkey % 30 < 25")
def repair_events(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("source_id"), (F.col("o_orderkey") % 200).alias("document_id"))
    return details.repair_events(e, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0 AND doc_id % 100 <> 0)")
def delete_members(spark, sf_dir):
    """Every fiftieth document is a member to go; every second of these is an upload and takes its source's documents with it."""
    d = table(spark, sf_dir, "documents")
    members = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 100 == 0, "folder").otherwise("upload").alias("source_type"), F.col("source").alias("upload_id"))
    docs = d.select("doc_id", F.col("source").alias("source_id"))
    return details.delete_members(members, docs, members.where("id % 50 = 0"))[1].select("doc_id", F.col("source_id").alias("source"))


@query("""SELECT c_nationkey AS tenant_id, sum(c_custkey % 4 + c_custkey % 3)::bigint AS done, sum(c_custkey % 9)::bigint AS total, CASE WHEN sum(c_custkey % 9) = 0 THEN -1 ELSE least(100, round(100.0 * sum(c_custkey % 4 + c_custkey % 3) / sum(c_custkey % 9))) END::int AS percent FROM customer GROUP BY c_nationkey""")
def tenant_overview(spark, sf_dir):
    c = F.col("c_custkey")
    zero = F.lit(0).cast("long")
    q = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"), (c % 4).alias("added"), zero.alias("updated"), zero.alias("deleted"), (c % 3).alias("failed"), (c % 9).alias("total"))
    return details.overview(q).select("tenant_id", "done", "total", "percent")


@query("SELECT n_nationkey, n_name, count(c_custkey)::bigint AS source_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def source_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return stats.filtered_counts(n, table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", F.lit(True), "source_count")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE source END AS relative, CASE WHEN doc_id % 3 = 0 THEN 'C:\in\' || lang || '\' ELSE '/in/' || lang || '/' END || CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id ELSE source END AS path FROM documents""")
def rewritten_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"relPath": "r'), "doc_id", F.lit('"}'))).otherwise('{"relPath": ""}')
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("C:\\in\\"), "lang", F.lit("\\old.md"))).otherwise(F.concat(F.lit("/in/"), "lang", F.lit("/old.md")))
    out = d.select("doc_id", details.relative_path(meta, F.col("source")).alias("relative"), path.alias("p"))
    return out.select("doc_id", "relative", details.rewritten_path(F.col("p"), F.col("relative")).alias("path"))


@query(r"""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' OR (lang = 'fr' AND len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 4) THEN source ELSE md5(trim(text)) END AS answer,
CASE WHEN lang = 'fr' THEN '一般事项' WHEN source = '' THEN 'general' ELSE source END AS category FROM documents""")
def answers(spark, sf_dir):
    """French stands for Chinese input here: answers without Han characters are in another language."""
    chinese = F.col("lang") == "fr"
    got = M.answer_text(F.col("text"), F.lit("\x00"), chinese)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(got == "\x00", F.col("source")).otherwise(F.md5(got.cast("binary"))).alias("answer"), M.answer_category(F.col("source"), chinese).alias("category"))


# --- search ------------------------------------------------------------------

_ASKED = ("src1", "the", "tion")
_LIVE = """ids AS (SELECT doc_id AS k, text, source, lang, embedding::double[] AS v, list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)) AS cos FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
ev AS (SELECT * FROM ids WHERE k NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source <> 'src2'),
li AS (SELECT k AS event_id, source AS entity_id FROM ev UNION SELECT k, 'b' || k % 97 FROM ev),
names AS (SELECT DISTINCT entity_id FROM li),
bytext AS (SELECT entity_id FROM names WHERE contains('src1 the tion', lower(entity_id)) OR contains(lower(entity_id), 'src1 the tion') ORDER BY CASE WHEN lower(entity_id) = 'src1 the tion' THEN 1.2 WHEN contains(lower(entity_id), 'src1 the tion') THEN 1.0 ELSE 0.6 END DESC, entity_id LIMIT 20),
byvector AS (SELECT n.entity_id FROM names n JOIN embeddings e ON n.entity_id = 'b' || e.vec_id WHERE list_cosine_similarity(e.embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)) >= 0.9),
known AS (SELECT entity_id FROM bytext UNION SELECT entity_id FROM byvector),
titled AS (SELECT k AS event_id FROM ev WHERE cos >= 0.4 ORDER BY cos DESC, k LIMIT 20),
seeds AS (SELECT event_id FROM li WHERE entity_id IN (FROM known) UNION SELECT event_id FROM titled),
fresh AS (SELECT DISTINCT entity_id FROM li WHERE event_id IN (FROM seeds) AND entity_id NOT IN (FROM known)),
one AS (SELECT DISTINCT event_id FROM li WHERE entity_id IN (FROM fresh) AND event_id NOT IN (FROM seeds)),"""
_RERANK = " + ".join(f"(CASE WHEN contains(lower(concat_ws(' ', lang, '', text)), '{t}') THEN 1 ELSE 0 END)" for t in _ASKED)


def _searchable(spark, sf_dir):
    """Documents, with or without a vector, as events of their source and of one of 97 groups; toxic ones and those of one source are archived."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text", "source", "lang").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding"), "k", "left")
    events = ids.select(F.col("k").alias("event_id"), F.col("k").alias("document_id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("deleted_at"), F.col("k").alias("chunk_id"), F.col("lang").alias("title"), F.lit("").alias("summary"), F.col("text").alias("content"), F.col("embedding").alias("title_vector"), F.col("embedding").alias("content_vector"))
    group = F.concat(F.lit("b"), F.col("k") % 97)
    links = ids.select(F.col("k").alias("event_id"), F.explode(F.array("source", group)).alias("entity_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("b"), "vec_id").alias("entity_id"), F.col("embedding").alias("vector"))
    entities = links.select("entity_id").distinct().withColumn("name", F.col("entity_id")).join(vectors, "entity_id", "left")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct().withColumn("archived_at", F.lit("x"))
    documents = ids.select(F.col("k").alias("id")).join(toxic, "id", "left")
    sources = ids.select(F.col("source").alias("id")).distinct().withColumn("archived_at", F.when(F.col("id") == "src2", F.lit("x")))
    chunks = ids.select(F.col("k").alias("chunk_id"), F.col("source").alias("document_id"), F.lit("").alias("heading"), F.col("text").alias("content"), F.lit(0).alias("rank"), "embedding")
    events, entities, links = S.live_tables(events, entities, links, documents, sources)
    return {"events": events, "entities": entities, "links": links, "chunks": chunks.join(events.select("chunk_id"), "chunk_id", "left_semi"), "query": " ".join(_ASKED), "query_vector": _query_vector(spark, sf_dir)}


def _sections(found):
    return found[0].select("chunk_id", "place", F.round("score", 6).alias("score"))


@query(f"""WITH {_LIVE} coarse AS (SELECT * FROM ev WHERE cos IS NOT NULL AND (k IN (FROM seeds) OR k IN (FROM one)) ORDER BY cos DESC, k LIMIT 100),
best AS (SELECT k, cos, {_RERANK} + cos AS r FROM coarse ORDER BY r DESC, k LIMIT 10)
SELECT k AS chunk_id, (row_number() OVER (ORDER BY r DESC, k) - 1)::int AS place, round(cos, 6) AS score FROM best""")
def multi_route_search(spark, sf_dir):
    """Entities by text and vector, titles, one hop, coarse rank, rerank, sections; live rows only."""
    return _sections(S.multi_search(**_searchable(spark, sf_dir), top_k=10))


@query(f"""WITH {_LIVE} fseeds AS (SELECT event_id FROM li WHERE entity_id IN (FROM bytext) UNION SELECT event_id FROM titled), ranked AS (SELECT * FROM ev WHERE cos IS NOT NULL AND (k IN (FROM fseeds) OR k IN (SELECT event_id FROM li WHERE entity_id IN (SELECT entity_id FROM li WHERE event_id IN (FROM fseeds) AND entity_id NOT IN (FROM bytext)))) ORDER BY cos DESC, k LIMIT 100),
best AS (SELECT k, cos, row_number() OVER (ORDER BY cos DESC, k) - 1 AS place FROM ranked ORDER BY cos DESC, k LIMIT 5), more AS (SELECT k, cos FROM ev WHERE cos IS NOT NULL AND k NOT IN (SELECT k FROM best) ORDER BY cos DESC, k LIMIT 3)
SELECT k AS chunk_id, place::int AS place, round(cos, 6) AS score FROM best UNION ALL SELECT k, (4 + row_number() OVER (ORDER BY cos DESC, k))::int, round(cos, 6) FROM more""")
def multi_route_search_fast(spark, sf_dir):
    """Entities by text alone; a reranker that answers nothing leaves the coarse order; vector hits fill up."""
    nothing = lambda coarse, *_: coarse.withColumn("rerank_score", F.lit(0.0)).where("false")
    return _sections(S.multi_search(**_searchable(spark, sf_dir), options=S.Options(mode="fast", rerank_top_k=5, max_sections=8), top_k=10, rerank=nothing))


def _expanded(spark, sf_dir, expansion: str):
    """Seeds: the events of one group of 97 with a small id; the second part asks for one event, so it stops with the first hop that has some."""
    s = _searchable(spark, sf_dir)
    groups = s["links"].where("entity_id like 'b%'")
    seeds = groups.where("event_id < 97 and event_id % 7 = 3").select("event_id").distinct()
    chain = groups.unionByName(groups.select("event_id", F.concat(F.lit("c"), (F.col("event_id") / 10).cast("long")).alias("entity_id")))
    first, second = S.expand(seeds, chain.select("entity_id").where("false"), chain, s["events"], s["query_vector"], S.Options(expansion=expansion, max_events_a=5, max_events_b=1))
    return first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)))


_CHAIN = _LIVE.split("names AS")[0] + """g AS (SELECT k AS event_id, 'b' || k % 97 AS entity_id FROM ev UNION ALL SELECT k, 'c' || k // 10 FROM ev),
s0 AS (SELECT k AS event_id FROM ev WHERE k < 97 AND k % 7 = 3), e1 AS (SELECT DISTINCT entity_id FROM g WHERE event_id IN (FROM s0)),
p1 AS (SELECT DISTINCT event_id FROM g WHERE entity_id IN (FROM e1) AND event_id NOT IN (FROM s0)),"""


@query(f"""WITH {_CHAIN} e2 AS (SELECT DISTINCT entity_id FROM g WHERE event_id IN (FROM p1) AND entity_id NOT IN (FROM e1)),
p2 AS (SELECT DISTINCT event_id FROM g WHERE entity_id IN (FROM e2) AND event_id NOT IN (FROM s0) AND event_id NOT IN (FROM p1)) SELECT event_id, 1 AS part FROM p1 UNION ALL SELECT event_id, 2 FROM p2""")
def expand_one_then_target(spark, sf_dir):
    return _expanded(spark, sf_dir, "multi1")


@query(f"""WITH {_CHAIN} a AS (SELECT k FROM ev WHERE cos IS NOT NULL AND (k IN (FROM s0) OR k IN (FROM p1)) ORDER BY cos DESC, k LIMIT 5), e2 AS (SELECT DISTINCT entity_id FROM g WHERE event_id IN (FROM a) AND entity_id NOT IN (FROM e1)),
p2 AS (SELECT DISTINCT event_id FROM g WHERE entity_id IN (FROM e2) AND event_id NOT IN (FROM s0) AND event_id NOT IN (FROM p1)) SELECT event_id, 1 AS part FROM p1 UNION ALL SELECT event_id, 2 FROM p2""")
def expand_reseeded(spark, sf_dir):
    return _expanded(spark, sf_dir, "hopllm")


# --- pages -------------------------------------------------------------------

_FILES = """f AS (SELECT o_orderkey, o_orderdate AS seen, lpad(o_orderkey::varchar, 9, '0') AS path, CASE WHEN o_orderpriority = '5-LOW' THEN 'deleted' ELSE 'synced' END AS status FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT l_orderkey AS k, count(*) AS n, count_if(l_returnflag = 'R') AS fallback FROM lineitem GROUP BY 1)"""
_PAGE = "SELECT path, coalesce(n, 0)::bigint AS event_count, coalesce(fallback, 0)::bigint AS fallback_event_count, (SELECT count(*) FROM f WHERE status <> 'deleted')::bigint AS total FROM f LEFT JOIN e ON k = o_orderkey WHERE status <> 'deleted'"


def _pages(spark, sf_dir, **options):
    """Orders of one status as files; line items as their events."""
    o = table(spark, sf_dir, "orders")
    manifest = o.select(F.col("o_orderstatus").alias("folder_id"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("rel_path"), F.col("o_orderdate").alias("last_seen_at"), F.when(F.col("o_orderpriority") == "5-LOW", "deleted").otherwise("synced").alias("last_event"), F.col("o_orderkey").alias("document_id"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", "regex-fallback").alias("extraction_source"))
    return pages.manifest_page(manifest, events, "F", **options)


def _paged(got):
    return got.rows.select(F.col("rel_path").alias("path"), "event_count", "fallback_event_count", F.lit(got.total).cast("bigint").alias("total"))


@query(f"WITH {_FILES} {_PAGE} ORDER BY seen DESC, path DESC LIMIT 500 OFFSET 100")
def manifest_page_recent(spark, sf_dir):
    """What follows a page of 100 by its cursor; more than 500 rows are not given."""
    return _paged(_pages(spark, sf_dir, limit=900, cursor=_pages(spark, sf_dir, limit=100, include_total=False).next_cursor))


@query(f"WITH {_FILES} {_PAGE} ORDER BY path LIMIT 50 OFFSET 120")
def manifest_page_by_path(spark, sf_dir):
    return _paged(_pages(spark, sf_dir, sort="path", offset=120))


@query("SELECT event_id, 20::bigint AS prev_offset, 200::bigint AS page_limit FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 220")
def runs_page(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("id"))
    got = pages.runs_page(runs, "error", limit=1000, offset=220)
    return got.rows.select(F.col("id").alias("event_id"), F.lit(got.prev_offset).cast("bigint").alias("prev_offset"), F.lit(got.limit).cast("bigint").alias("page_limit"))


_GRAPH = """l AS (SELECT DISTINCT l_orderkey AS v, l_partkey AS e FROM lineitem), c AS (SELECT p_partkey AS e, p_name AS name, count(v) AS n FROM part LEFT JOIN l ON e = p_partkey GROUP BY ALL),
se AS (SELECT e FROM (SELECT e FROM c ORDER BY n DESC, name, e LIMIT 8) UNION SELECT e FROM c WHERE e % 100 = 7 UNION SELECT e FROM l WHERE v % 500 = 1), sv AS (SELECT v FROM l WHERE e % 100 = 7)"""


def _graph(spark, sf_dir, places=True):
    """Orders as events of their parts; every hundredth part and every five-hundredth order is open."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("rank"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    return graph.visible_graph(events, entities, links, entities.where("entity_id % 100 = 7"), events.where("event_id % 500 = 1"), places=places)


@query(f"""WITH {_GRAPH}, nodes AS (SELECT 'entity' AS kind, e::varchar AS id, name AS label, -n AS a, name AS b, e % 100 = 7 AS open FROM c WHERE e IN (FROM se)
UNION ALL SELECT 'event', o_orderkey::varchar, o_orderpriority, o_custkey, '', o_orderkey % 500 = 1 FROM orders WHERE o_orderkey IN (FROM sv))
SELECT kind, id, label, open, (row_number() OVER (ORDER BY kind, a, b, id) - 1)::int AS place FROM nodes""")
def graph_nodes_in_order(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(f"WITH {_GRAPH} SELECT e AS entity_id, v AS event_id, v % 500 = 1 AND e % 100 <> 7 AS from_event, v % 500 = 1 OR e % 100 = 7 AS marked FROM l WHERE e IN (FROM se) AND v IN (FROM sv)")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir, places=False)[1]


@query("SELECT l_orderkey AS event_id, string_agg(DISTINCT l_partkey::varchar, ',' ORDER BY l_partkey::varchar) AS entities FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def graph_event_nodes(spark, sf_dir):
    """Each event of a project's graph with its entities."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    nodes = graph.project_graph(events, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")), links)[1]
    return nodes.select("event_id", F.array_join(F.array_sort(F.transform("entity_ids", lambda e: e.cast("string"))), ",").alias("entities"))


_NO_SEEDS = " + ".join(f"(CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END)" for t in ("zzq", "tion", "zzq tion"))


@query(f"""WITH {_LIVE.split("li AS")[0].rstrip().rstrip(",")}, v AS (SELECT k, cos AS v FROM ev WHERE cos IS NOT NULL ORDER BY cos DESC, k LIMIT 40), q AS (SELECT k, m / 9.0 AS w FROM (SELECT k, {_NO_SEEDS} AS m FROM ev) WHERE m > 0 ORDER BY m DESC, k LIMIT 40),
h AS (SELECT k, coalesce(v, w * 0.6) AS score FROM v FULL JOIN q USING (k)), r AS (SELECT k, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, k) AS n FROM h JOIN ev USING (k)),
b AS (SELECT * FROM r WHERE n <= 3 ORDER BY score DESC, k LIMIT 10) SELECT k AS chunk_id, (row_number() OVER (ORDER BY score DESC, k) - 1)::int AS place, round(score, 6) AS score FROM b""")
def multi_route_search_without_seeds(spark, sf_dir):
    """No entity and no title answers: the hybrid search over all chunks, those without a vector too."""
    given = _searchable(spark, sf_dir) | {"query": "zzq tion"}
    given["entities"] = given["entities"].where("false")
    given["chunks"] = given["chunks"].withColumn("rank", F.col("chunk_id"))
    return _sections(S.multi_search(**given, options=S.Options(title_similarity=2.0), top_k=10))
