"""Functions of text, entities, vectors, files, states and answers, one query each, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import model_output as M
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chunking, details, ingest, manifest, merge, recall, rows
from tessera.plans import search as S
from tessera.plans.q_retrieval import _query_vector
from tessera.plans.registry import query, table
from tessera.sources import files
from tessera.streaming import folders

#: Letters that stand for Han characters, so that the Chinese branches see whole texts too.
LATIN, HAN = "etaoinshrdlu", "风险内控建议整改制度违规"
_HAN = f"SELECT doc_id, translate(text, '{LATIN}', '{HAN}') AS t FROM documents"
_ENDS = "' ' || chr(9) || chr(10) || chr(13)"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _han(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.translate("text", LATIN, HAN).alias("t"))


def _digest(text):
    return F.md5(text.cast("binary"))


# --- text ----------------------------------------------------------------------

_ZH_RULES = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{label}'" for pattern, label in T.CATEGORIES_ZH)


@query(f"""SELECT doc_id, han > 2 * latin AS chinese, han >= 2 AND han / greatest(length(t), 1) >= 0.25 AS title, CASE {_ZH_RULES} ELSE '一般事项' END AS category
FROM (SELECT *, length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fa5}}]', '', 'g')) AS han, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) AS latin FROM ({_HAN}))""")
def chinese_texts(spark, sf_dir):
    t = F.col("t")
    return _han(spark, sf_dir).select("doc_id", T.is_mostly_chinese(t).alias("chinese"), T.is_chinese_title(t).alias("title"), T.classify_category(t, F.lit(True)).alias("category"))


@query(f"""SELECT doc_id, array_to_string(u[1:10], ',') AS keywords FROM (SELECT doc_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS u FROM
(SELECT doc_id, list_filter(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9_-]{{2,18}}'), lambda x: NOT regexp_matches(x, '^\\d+$')) AS k FROM ({_HAN})
WHERE length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fa5}}]', '', 'g')) > 2 * len(regexp_extract_all(t, '[A-Za-z]{{2,}}'))))""")
def chinese_keywords(spark, sf_dir):
    t = F.col("t")
    return _han(spark, sf_dir).where(T.is_mostly_chinese(t)).select("doc_id", F.array_join(T.keywords(t), ",").alias("keywords"))


_NAMES = ("", " 2", " Inc", " Group", " System", " API", " Report", " Plan", "公司", "平台", "报告")
_NAMED = f"SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '2024年' || (1 + p_partkey % 12) || '月' WHEN p_partkey % 13 = 1 THEN p_size || '%' ELSE p_name || ([{', '.join(repr(n) for n in _NAMES)}])[1 + p_partkey % 11] END AS name FROM part"
_TYPE_RULES = " ".join(f"WHEN regexp_matches(name, '{pattern}') THEN '{label}'" for pattern, label in T.ENTITY_TYPES)


@query(f"SELECT p_partkey, name, CASE {_TYPE_RULES} ELSE 'subject' END AS type FROM ({_NAMED})")
def entity_types(spark, sf_dir):
    """Parts with endings of each type, months and shares."""
    k = F.col("p_partkey")
    end = F.get(F.array(*[F.lit(n) for n in _NAMES]), (k % 11).cast("int"))
    name = F.when(k % 13 == 0, F.concat(F.lit("2024年"), (1 + k % 12).cast("string"), F.lit("月"))).when(k % 13 == 1, F.concat(F.col("p_size").cast("string"), F.lit("%"))).otherwise(F.concat("p_name", end))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("type", T.infer_entity_type(F.col("name")))


_SPAN_NAMES = ("银行", "省", "湖", "路", "山脉", "李四", " x", "")
_SPAN_RULES = " ".join(f"WHEN regexp_matches(trim(name), '{pattern}') THEN '{label}'" for pattern, label in T.NER_TYPES)


@query(f"SELECT c_custkey, CASE WHEN trim(name) = '' THEN NULL {_SPAN_RULES} END AS type FROM (SELECT c_custkey, CASE WHEN c_custkey % 16 < 8 THEN '' ELSE c_mktsegment END || ([{', '.join(repr(n) for n in _SPAN_NAMES)}])[1 + c_custkey % 8] AS name FROM customer)")
def span_types(spark, sf_dir):
    k = F.col("c_custkey")
    end = F.get(F.array(*[F.lit(n) for n in _SPAN_NAMES]), (k % 8).cast("int"))
    name = F.concat(F.when(k % 16 < 8, F.lit("")).otherwise(F.col("c_mktsegment")), end)
    return table(spark, sf_dir, "customer").select("c_custkey", T.entity_type_of_span(name).alias("type"))


#: Texts with a trigger word in the place of a common one.
_RISKY = "replace(text, ' the ', ' 风险 ')"
_FIRST = r"""coalesce(nullif(regexp_extract(trim(x), '^([\s\S]*?[.!?。！？])\s+', 1), ''), trim(x))[1:120]"""
_BEST = f"""s AS (SELECT doc_id, trim(p, {_ENDS}) AS p, i FROM (SELECT doc_id, unnest(regexp_extract_all(x, '[^.!?;]+[.!?;]?')) AS p, generate_subscripts(regexp_extract_all(x, '[^.!?;]+[.!?;]?'), 1) AS i FROM d)),
best AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(p, '风险') THEN 1 ELSE 0 END DESC, length(p) DESC, i) AS n FROM s WHERE length(p) BETWEEN 6 AND 240) WHERE n = 1)"""
_TITLED = r"""CASE WHEN length(trim(regexp_replace(t, '^#+\s*', ''))[1:160]) > 0 THEN trim(regexp_replace(t, '^#+\s*', ''))[1:160] ELSE 'Untitled event' END"""


@query(f"""WITH d AS (SELECT doc_id, {_RISKY} AS x FROM documents), {_BEST}
SELECT doc_id, coalesce(p, {_FIRST}) AS sentence, {_FIRST} AS first FROM d LEFT JOIN best USING (doc_id)""")
def representative_sentences(spark, sf_dir):
    x = F.replace("text", F.lit(" the "), F.lit(" 风险 "))
    return _documents(spark, sf_dir).select("doc_id", T.representative_sentence(x).alias("sentence"), T.first_sentence(x).alias("first"))


@query(f"SELECT doc_id, {_TITLED} AS title FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '## ' || text WHEN 1 THEN text ELSE '##  ' END AS t FROM documents)")
def clean_titles(spark, sf_dir):
    k = F.col("doc_id") % 3
    return _documents(spark, sf_dir).select("doc_id", T.clean_title(F.when(k == 0, F.concat(F.lit("## "), "text")).when(k == 1, F.col("text")).otherwise("##  ")).alias("title"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[^.!?;]+[.!?;]?'), lambda x: trim(x)), lambda x: x <> '') AS s FROM f),
n AS (SELECT *, CASE WHEN length(s[1]) + length(s[2]) > 360 THEN 1 WHEN length(s[1]) + length(s[2]) + length(s[3]) > 360 THEN 2 ELSE 3 END AS n FROM p),
j AS (SELECT doc_id, t, trim(array_to_string(s[1:n], ' ')) AS j FROM n)
SELECT doc_id, CASE WHEN length(t) <= 360 THEN t WHEN length(j) <= 360 THEN j ELSE trim(j[1:359]) || '…' END AS short FROM j""")
def concise_texts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.concise(F.col("text")).alias("short"))


@query(r"""SELECT doc_id, md5(CASE WHEN t = '' THEN t ELSE t || chr(10) END) AS lines, md5(trim(regexp_replace(regexp_replace(text || '|', '\|', '\\|', 'g'), '\r?\n', ' ', 'g'))) AS cell
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\s+$', '') AS t FROM documents)""")
def normalized_lines(spark, sf_dir):
    """Texts with a byte order mark, line ends of another system and blanks at the end."""
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(" \r\n "))
    return _documents(spark, sf_dir).select("doc_id", _digest(T.normalize_lines(raw)).alias("lines"), _digest(T.escape_cell(F.concat("text", F.lit("|")))).alias("cell"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS text FROM pages")
def xml_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _digest(T.decode_xml(F.col("html"))).alias("text"))


@query("SELECT page_id, md5(html) AS text FROM pages")
def xml_round_trip(spark, sf_dir):
    """What is escaped comes back as it was."""
    out = F.col("html")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return table(spark, sf_dir, "pages").select("page_id", _digest(T.decode_xml(out)).alias("text"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 700.0))::int AS pieces, md5(text) AS joined, least(length(text), 700)::int AS longest FROM documents")
def fixed_pieces(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", T.fixed_pieces(F.col("text"), 700).alias("p"))
    return d.select("doc_id", F.size("p").alias("pieces"), _digest(F.array_join("p", "")).alias("joined"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:16], '|') AS tokens FROM (SELECT conv_id, turn,
list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: length(x) >= 2) || CASE WHEN length(trim(text)) BETWEEN 2 AND 32 THEN [trim(text)] ELSE [] END AS t FROM conversations)""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.query_tokens(F.col("text")), "|").alias("tokens"))


@query("SELECT doc_id, md5((CASE WHEN doc_id % 2 = 0 THEN source || chr(10) ELSE '' END || text)[1:8000]) AS embedded, CASE WHEN doc_id % 3 = 0 THEN source || ' ' || lang ELSE source END AS relation, length(text[1:100])::int AS capped FROM documents")
def embedding_inputs(spark, sf_dir):
    """What an embedding model is given: it takes 8,000 characters of a chunk."""
    heading = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    relation = chunking.relation_text(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.col("source"), F.col("lang"))
    return _documents(spark, sf_dir).select("doc_id", _digest(chunking.embedding_text(heading, F.col("text"))).alias("embedded"), relation.alias("relation"), F.length(T.cap_for_embedding(F.col("text"), 100)).alias("capped"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}') AS p FROM documents), z AS (SELECT doc_id, p, list_transform(p, lambda x: CASE WHEN length(x) = 0 THEN 1 ELSE greatest(1, ceil(length(x) / 1.5))::int END) AS n FROM p),
r AS (SELECT doc_id, p, n, 1 AS i, n[1] AS s, 0 AS pack FROM z UNION ALL SELECT doc_id, p, n, i + 1, CASE WHEN s + n[i + 1] > 300 THEN n[i + 1] ELSE s + n[i + 1] END, CASE WHEN s + n[i + 1] > 300 THEN pack + 1 ELSE pack END FROM r WHERE i < len(n))
SELECT doc_id, pack::int AS rank, md5(string_agg(p[i], chr(10) || chr(10) ORDER BY i)) AS content FROM r GROUP BY doc_id, pack""")
def paragraph_packs(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraph_packs(d, 300).select("doc_id", "rank", _digest(F.col("content")).alias("content"))


# --- vectors and answers -------------------------------------------------------------


@query("SELECT vec_id, round(list_cosine_similarity(embedding[1:1 + vec_id % 64]::double[], (SELECT embedding FROM embeddings WHERE vec_id = 0)[1:1 + vec_id % 64]::double[]), 6) AS score FROM embeddings")
def cosine_of_shared(spark, sf_dir):
    """Vectors cut to 1 to 64 components against a whole one."""
    n = (1 + F.col("vec_id") % 64).cast("int")
    mine = F.slice("embedding", F.lit(1), n)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cosine_shared(mine, recall.vector_literal(_query_vector(spark, sf_dir))), 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN len(embedding) END::int AS dimension, CASE WHEN vec_id % 3 <> 0 THEN round(list_sum(embedding::double[]), 4) END AS total FROM embeddings")
def parsed_vectors(spark, sf_dir):
    """Vectors from their literals; every third has a null in it and is none."""
    written = V.literal(F.col("embedding"))
    v = V.parse(F.when(F.col("vec_id") % 3 == 0, F.replace(written, F.lit("["), F.lit("[null,"))).otherwise(written))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(v.isNotNull(), F.size(v)).alias("dimension"), F.round(total, 4).alias("total"))


@query("SELECT event_id, event_type AS kind, user_id AS first_user FROM events")
def repaired_answers(spark, sf_dir):
    """JSON in a fence, with a comma too many, or cut within its last list."""
    k = F.col("event_id") % 3
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "users": ['), F.col("user_id").cast("string"))
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(k == 1, F.concat(body, F.lit(",],}"))).otherwise(F.concat(body, F.lit(', 1')))
    e = table(spark, sf_dir, "events").select("event_id", M.repair_json(answer).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.kind").alias("kind"), F.get_json_object("j", "$.users[0]").cast("long").alias("first_user"))


@query("SELECT conv_id, turn, md5(trim(text)) AS answer FROM conversations")
def answers_without_thinking(spark, sf_dir):
    """Turns behind a thinking block, every other one in a fence."""
    t = F.col("text")
    inner = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(F.concat(F.lit("<|im_start|>think\nhm<|im_end|>"), t))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", _digest(F.trim(M.strip_thinking(F.concat(F.lit("<think>so\nso</think> "), inner)))).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_type || ',' || user_id ELSE event_type || user_id END || CASE WHEN event_id % 4 = 2 THEN '' ELSE ',end' END AS names FROM events")
def merged_spans(spark, sf_dir):
    """A type's tag and the one that goes on with it (of another type for each fourth event), then one of too low a score, or alone."""
    k = F.col("event_id") % 4
    tag = lambda e, w, s: F.struct(e.alias("entity"), w.alias("word"), s.alias("score"))
    tags = F.array(
        tag(F.lit("B-A"), F.col("event_type"), F.lit(0.9)), tag(F.when(k == 3, "I-B").otherwise("I-A"), F.concat(F.lit("##"), F.col("user_id").cast("string")), F.lit(0.9)),
        tag(F.lit("O"), F.lit("-"), F.lit(0.9)), tag(F.lit("S-A"), F.lit("end"), F.when(k == 2, 0.1).otherwise(0.9)),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(M.merge_spans(tags), ",").alias("names"))


@query("SELECT c_custkey, sha256(c_name) AS hash, sha256(c_name)[1:12] AS fingerprint, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS secret FROM customer")
def secrets_kept(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", M.key_hash(F.col("c_name")).alias("hash"), M.key_fingerprint(F.col("c_name")).alias("fingerprint"), ingest.keep_secret(F.col("c_name"), new).alias("secret"))


@query("SELECT event_id, user_id % 5 AS best, CASE WHEN user_id % 5 = 2 THEN 1 ELSE 2 END::int AS n FROM events")
def reranked_answers(spark, sf_dir):
    """A reranker's answer: one of five candidates twice, or one out of range."""
    u = F.col("user_id") % 5
    answer = F.concat(F.lit('[{"index":'), F.when(u == 2, 9).otherwise(0).cast("string"), F.lit(',"relevance_score":0.2},{"index":'), u.cast("string"), F.lit(',"relevance_score":0.7}]'))
    e = table(spark, sf_dir, "events").select("event_id", recall.rerank_response(answer, F.lit(5)).alias("r"))
    return e.select("event_id", F.get("r", F.lit(0))["index"].cast("long").alias("best"), F.size("r").alias("n"))


@query("SELECT doc_id, md5((source || chr(10) || text)[1:2400]) AS of_ten, md5((source || chr(10) || text)[1:560]) AS of_fifty FROM documents")
def rerank_inputs(spark, sf_dir):
    """A remote reranker's budget for one of ten and of fifty candidates."""
    return _documents(spark, sf_dir).select("doc_id", *[_digest(recall.rerank_document(F.col("source"), F.col("text"), n)).alias(name) for n, name in ((10, "of_ten"), (50, "of_fifty"))])


@query("""WITH e AS (SELECT user_id AS chunk_id, min(event_id) AS place, count(*) OVER () AS _n FROM events WHERE event_type = 'purchase' GROUP BY user_id),
s AS (SELECT chunk_id, place, 0 AS late FROM e WHERE chunk_id IN (SELECT c_custkey FROM customer) ORDER BY place LIMIT 20),
m AS (SELECT c_custkey AS chunk_id, c_custkey AS place, 1 AS late FROM customer WHERE c_custkey NOT IN (SELECT chunk_id FROM s))
SELECT chunk_id, place, late FROM (FROM s UNION ALL FROM m) ORDER BY late, place LIMIT 30""")
def sections_filled_up(spark, sf_dir):
    """Chunks (customers) of events in order, each once, twenty at most; then others by id up to thirty."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("place"), F.col("value").alias("score"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    found = recall.sections_for(e, chunks, 20)
    more = chunks.select("chunk_id", F.col("chunk_id").alias("place"), F.lit(0.0).alias("score"))
    return recall.supplement(found, more, 30).select("chunk_id", "place", F.col("late").cast("int").alias("late"))


@query("""SELECT event_id, stage, place FROM (SELECT user_id::varchar AS event_id, CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'coarse' ELSE 'rerank' END AS stage, event_id AS place,
row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END DESC, event_id) AS n FROM events) WHERE n = 1""")
def trace_snapshots(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "title").when(F.col("event_type") == "click", "coarse").otherwise("rerank")
    trace = table(spark, sf_dir, "events").select(stage.alias("stage"), F.col("event_id").alias("place"), F.col("user_id").cast("string").alias("event_id"))
    return S.snapshots(trace).select("event_id", "stage", "place")


# --- files, states, stores ---------------------------------------------------------


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 'skipped: ' || octet_length(encode(text)) || ' bytes over 2000' END AS reason FROM documents")
def skipped_files(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", files.skip_reason(F.octet_length("text"), 2000, 5000).alias("reason"))


@query("SELECT DISTINCT dir FROM (SELECT unnest(['in', 'in/' || lang, 'in/' || lang || '/' || source]) AS dir FROM documents)")
def watched_folders(spark, sf_dir):
    return files.watch_targets(_documents(spark, sf_dir).select(F.concat_ws("/", F.lit("in"), "lang", "source", F.concat("doc_id", F.lit(".md"))).alias("path")))


@query(r"SELECT doc_id, md5(CASE WHEN t = '' THEN t ELSE t || chr(10) END) AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\s+$', '') AS t FROM documents)")
def texts_of_files(spark, sf_dir):
    """Files in UTF-8 with a byte order mark, through the reader of texts."""
    got = files.read_text(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("﻿"), "text").cast("binary").alias("content")))
    return got.select(F.col("path").cast("long").alias("doc_id"), _digest(F.col("text")).alias("text"))


@query("""SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y DESC) - 1)::int AS line, text FROM (SELECT l_orderkey AS page, l_quantity AS y, string_agg(l_partkey::varchar, ' ' ORDER BY l_linenumber, l_partkey::varchar) AS text FROM lineitem GROUP BY l_orderkey, l_quantity)""")
def lines_of_runs(spark, sf_dir):
    """Orders as pages: parts at a height of their quantity, give or take, by line number."""
    l = table(spark, sf_dir, "lineitem")
    runs = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") + 0.01 * (F.col("l_linenumber") % 3)).alias("y"), F.col("l_partkey").cast("string").alias("str"))
    return files.lines_of_runs(runs)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'only .md and .txt' WHEN octet_length(encode(text)) > 3000 THEN 'too large' WHEN trim(text) = '' THEN 'empty' END AS problem FROM documents""")
def upload_problems(spark, sf_dir):
    name = F.when(F.col("doc_id") % 4 == 0, "a.exe").otherwise("a.MD")
    return _documents(spark, sf_dir).select("doc_id", ingest.upload_problem(name, F.col("text"), 3000).alias("problem"))


@query("SELECT doc_id AS rel_path, CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 <> 1 THEN sha1(text) END AS sha1 FROM documents")
def reused_hashes(spark, sf_dir):
    """Files of which some have another time, others no row in the manifest."""
    f = _documents(spark, sf_dir).select(F.col("doc_id").alias("rel_path"), F.col("n_chars").alias("size_bytes"), F.lit(1).alias("mtime_ms"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return manifest.reuse_hashes(f.where("rel_path % 7 <> 1"), f.withColumn("mtime_ms", F.when(F.col("rel_path") % 5 == 1, 2).otherwise(1))).select("rel_path", "sha1")


@query("SELECT doc_id AS rel_path FROM documents WHERE doc_id % 10 = 0 AND lang <> 'de'")
def deleted_but_ignored(spark, sf_dir):
    """Every tenth file is gone; those of one language are ignored, so they are not reported."""
    d = _documents(spark, sf_dir)
    facts = [F.lit(1).cast("long").alias(c) for c in ("size_bytes", "mtime_ms", "inode")] + [F.lit("x").alias("sha1")]
    old = d.select(F.concat_ws("/", "lang", "doc_id").alias("path"), F.col("doc_id").alias("rel_path"), *facts, F.lit("synced").alias("last_event"))
    new = old.where("rel_path % 10 <> 0")
    gone = manifest.diff(old, new, ["path", "rel_path"], ignore=F.col("path").startswith("de/"))
    return gone.where("change = 'deleted'").select("rel_path")


@query("""SELECT event_id, CASE WHEN stale THEN 'pending' ELSE state END AS last_event, stale AS reset FROM (SELECT event_id, state, state = 'syncing' AND (event_type = 'click' OR ts < timestamp '2024-01-20 00:00:00') AS stale
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'syncing' ELSE event_type END AS state FROM events))""")
def reaped_syncs(spark, sf_dir):
    """Views have a start, clicks none."""
    view = F.col("event_type") == "view"
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "syncing").otherwise(F.col("event_type")).alias("last_event"), F.when(view, F.col("ts")).alias("sync_started_at"), F.lit(1).alias("document_id"))
    now = F.lit("2024-01-20 01:00:00").cast("timestamp")
    return manifest.reap_syncing(e, now).select("event_id", "last_event", F.col("document_id").isNull().alias("reset"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'pending' ELSE event_type END AS last_event, event_type NOT IN ('error', 'click') AS told FROM events")
def reset_states(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", state.alias("last_event"), F.lit("why").alias("last_error"))
    return manifest.reset_for_retry(e).select("event_id", "last_event", F.col("last_error").isNotNull().alias("told"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 1")
def orphaned_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("synced").alias("last_event"), F.when(F.col("user_id") % 2 == 0, F.col("ts")).alias("sync_started_at"))
    return manifest.orphans(e).select("event_id")


@query("SELECT event_id, event_type, props->>'$.k' AS k, CASE WHEN event_type = 'view' THEN NULL ELSE 'seen' END AS mark FROM events")
def attributes(spark, sf_dir):
    """A key set, then taken away from views."""
    m = manifest.set_attribute(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")), "mark", F.lit("seen"))
    e = table(spark, sf_dir, "events").withColumn("m", m)
    e = e.withColumn("m", F.when(F.col("event_type") == "view", manifest.set_attribute(F.col("m"), "mark", None)).otherwise(F.col("m")))
    return e.select("event_id", "event_type", F.col("m")["k"].alias("k"), F.col("m")["mark"].alias("mark"))


@query("SELECT user_id, count(*)::bigint AS archived FROM events WHERE event_type = 'error' GROUP BY user_id")
def restored_rows(spark, sf_dir):
    """Errors and clicks are archived, clicks restored."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    e = table(spark, sf_dir, "events").withColumn("archived_at", F.lit(None).cast("timestamp"))
    e = manifest.restore(manifest.archive(e, F.col("event_type").isin("error", "click"), now), F.col("event_type") == "click")
    return e.where("archived_at is not null").groupBy("user_id").agg(F.count("*").alias("archived"))


@query("SELECT n_nationkey AS source_id, CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE (SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) FROM customer WHERE c_nationkey = n_nationkey) END AS document_id FROM nation")
def latest_documents(spark, sf_dir):
    """Every fourth source has a document; the others take the newest, here that of the greatest balance."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(-1).cast("long")).alias("document_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("created_at"))
    return merge.latest_document(n, docs).select("source_id", "document_id")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' || c_custkey WHEN c_custkey % 6 = 3 THEN c_mktsegment ELSE c_name END AS description FROM customer WHERE c_custkey % 6 <> 1")
def filled_entities(spark, sf_dir):
    """Entities with an empty description (k % 6 = 0), with one of their own (3, 5), or unknown so far (2, 4)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment").where("k % 6 <> 1")
    old = c.where("k % 6 in (0, 3, 5)").select("k", F.when(F.col("k") % 6 == 0, "").when(F.col("k") % 6 == 3, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("description"))
    return ingest.fill_entity(old, c.select("k", F.concat(F.lit("new"), "k").alias("description")), ["k"])


@query("""SELECT n_nationkey AS project_id, count(DISTINCT o_orderkey)::bigint AS n_documents FROM nation LEFT JOIN (SELECT c_nationkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0) ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def cached_counts(spark, sf_dir):
    """Projects (nations) with members (customers): uploads, and folders of which every other is enabled; orders are documents."""
    c = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), c.alias("source_id"), F.when(c % 3 == 0, "upload").otherwise("folder").alias("source_type"), (c % 2 == 0).alias("enabled"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("doc_id"))
    return ingest.cached_stats(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id")), members, docs)


@query("""SELECT n_nationkey::varchar AS project_id, n_nationkey::varchar AS source_id FROM nation UNION SELECT c_nationkey::varchar, 'f' || c_custkey FROM customer WHERE c_custkey % 3 <> 0""")
def project_sources(spark, sf_dir):
    """Nations as projects, customers as folders; every third is attached to none."""
    c = table(spark, sf_dir, "customer")
    meta = F.when(F.col("c_custkey") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"projectId": "'), "c_nationkey", F.lit('"}')))
    folders_ = c.select(meta.alias("metadata"), F.concat(F.lit("f"), "c_custkey").alias("source_id"))
    return ingest.project_sources(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("project_id")), folders_)


@query("SELECT session_id FROM (SELECT conv_id AS session_id, string_agg(role, ',') AS roles, max(turn) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, session_id LIMIT 100) WHERE session_id % 10 IN (1, 2)")
def sessions_of_sources(spark, sf_dir):
    """Of the newest hundred sessions those that name one of two sources."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("updated_at"))
    named = c.withColumn("source_ids", F.array((F.col("session_id") % 10).cast("string"), F.lit("x")))
    return ingest.sessions_on(named, ["1", "2"], 100).select("session_id")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR c_nationkey <> 3")
def missing_of_tenant(spark, sf_dir):
    """Asked for: all customers; there: those of one tenant that are not archived."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("tenant_id"), F.when(F.col("c_acctbal") < 0, "x").alias("archived_at"))
    return rows.missing(s.select("id"), s, "n3")


@query("SELECT c_nationkey::bigint AS id FROM customer UNION SELECT o_custkey FROM orders WHERE o_totalprice >= 100000")
def united_ids(spark, sf_dir):
    dear = rows.at_least(table(spark, sf_dir, "orders"), "o_totalprice", 100_000)
    return rows.union_distinct(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id")), dear.select(F.col("o_custkey").alias("id")))


@query("SELECT 'n' || min(n_nationkey) FILTER (n_regionkey = 1) AS id FROM nation")
def default_type(spark, sf_dir):
    """No nation's region is the one asked for, so the first that stands for the general one answers."""
    n = table(spark, sf_dir, "nation")
    types = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 1, "subject").otherwise("other").alias("type"), F.lit(True).alias("is_active"), (F.col("n_nationkey") == F.min("n_nationkey").over(_per_region())).alias("is_default"))
    return spark.createDataFrame([(details.default_entity_type(types, "absent"),)], "id string")


def _per_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey")


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, count(*)::bigint AS n FROM r WHERE bad GROUP BY user_id, g HAVING count(*) >= 2""")
def opened_circuits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return folders.circuit(e, "user_id", "ts", F.col("event_type") == "error", 2).select("user_id", "n")
