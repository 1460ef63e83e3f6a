"""Vectors, keywords, hybrid search, reranking, graph hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import graph, recall
from tessera.operators.gram_index import GramIndex, either_contains
from tessera.operators.rows import diversify, in_order, minus, ordered_union
from tessera.operators.vector_index import VectorIndex
from tessera.plans.registry import ORACLE, query, table
from tessera.plans.storage import new_folder

WORDS = ("tion", "the", "und")
_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]  # one row


def _links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    out = recall.by_vector(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 20, None, "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} WHERE {_COS} >= 0.2")
def cosine_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("score", V.cosine(F.col("embedding"), recall.vector_literal(_query_vector(spark, sf_dir))))
    return v.where("score >= 0.2").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(greatest(0, {_COS}), 6) AS score FROM embeddings e, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 20")
def l2_score_topk(spark, sf_dir):
    out = recall.by_vector_index(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 20, F.lit(True), "vec_id")
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id FROM (SELECT vec_id, label FROM embeddings e, {_Q} ORDER BY {_COS} DESC, vec_id LIMIT 50) WHERE label <> 3")
def knn_then_filter(spark, sf_dir):
    return recall.by_vector_index(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 50, F.col("label") != 3, "vec_id").select("vec_id")


@query("""SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_component, len(e)::int AS dimension
FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)""")
def vector_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.normalize(F.col("embedding")), F.lit(0)), 6).alias("first_component"), V.preview(F.col("embedding"))["dimension"].alias("dimension"))


@query("""SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS component FROM (SELECT vec_id, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1)::int - 1 AS i FROM embeddings)""")
def unit_components(spark, sf_dir):
    """Every component of every vector at unit length."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", "i", F.round("x", 6).alias("component"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding::double[], lambda x: printf('%.8f', x)), ',') || ']' AS literal FROM embeddings")
def vector_literal(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.literal(F.col("embedding")).alias("literal"))


_HIT = " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(source), '{w}') THEN 2 ELSE 0 END)" for w in WORDS)


@query(f"SELECT doc_id, ({_HIT})::int AS match_count, round(({_HIT}) / 9.0, 6) AS score FROM documents WHERE ({_HIT}) > 0 ORDER BY ({_HIT}) DESC, n_chars, doc_id LIMIT 50")
def keyword_search(spark, sf_dir):
    out = recall.by_keywords(table(spark, sf_dir, "documents"), list(WORDS), 50, "source", "text", "n_chars", "doc_id")
    return out.select("doc_id", "match_count", F.round("score", 6).alias("score"))


@query(ORACLE["keyword_search"])
def indexed_keyword_search(spark, sf_dir):
    """The same through a stored index of character grams; only texts that may hold a word are read."""
    index = GramIndex.build(table(spark, sf_dir, "documents"), new_folder(spark, "grams"), "doc_id", ["source", "text"])
    return index.search(list(WORDS), 50, "source", "text", "n_chars", "doc_id").select("doc_id", "match_count", F.round("score", 6).alias("score"))


@query(ORACLE["cosine_topk"])
def indexed_topk(spark, sf_dir):
    """The same through a stored index of cells; only cells that may hold one of the best are read."""
    index = VectorIndex.build(table(spark, sf_dir, "embeddings"), new_folder(spark, "cells"), "vec_id", "embedding")
    return index.search(_query_vector(spark, sf_dir), 20)[0].select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT DISTINCT source AS mine FROM documents UNION SELECT DISTINCT lang FROM documents UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT p_name FROM part UNION SELECT n_name FROM nation),
b AS (SELECT DISTINCT p_name AS theirs FROM part UNION SELECT DISTINCT source FROM documents UNION SELECT r_name FROM region) SELECT mine, theirs FROM a, b WHERE contains(lower(mine), lower(theirs)) OR contains(lower(theirs), lower(mine))""")
def name_containment(spark, sf_dir):
    """Names of which one holds the other, by their rarest grams: languages and sources, market segments, parts, nations; parts, sources, regions."""
    names = lambda t, c, to: table(spark, sf_dir, t).select(F.col(c).alias(to))
    a = names("documents", "source", "mine").union(names("documents", "lang", "mine")).union(names("customer", "c_mktsegment", "mine")).union(names("part", "p_name", "mine")).union(names("nation", "n_name", "mine")).distinct()
    b = names("part", "p_name", "theirs").union(names("documents", "source", "theirs")).union(names("region", "r_name", "theirs")).distinct()
    return either_contains(a, b, "mine", "theirs")


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'cold widget' THEN 1.2 WHEN contains(lower(p_name), 'cold widget') THEN 1.0 ELSE 0.6 END::double AS score FROM part
WHERE contains(lower(p_name), 'cold widget') OR (length(p_name) > 0 AND contains('cold widget', lower(p_name))) ORDER BY score DESC, p_name, p_partkey LIMIT 1000000""")
def entity_text_recall(spark, sf_dir):
    return recall.entities_by_text(table(spark, sf_dir, "part"), "p_name", "cold widget", 1_000_000).select("p_partkey", "p_name", F.col("score").cast("double").alias("score"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'cold') OR contains(lower(p_name), 'blue')")
def entity_name_recall(spark, sf_dir):
    return recall.entities_by_names(table(spark, sf_dir, "part"), "p_name", ["cold", "Blue"]).select("p_partkey")


_SECTIONS = """c AS (SELECT doc_id, e.embedding, d.text, d.n_chars FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


@query(f"""WITH {_SECTIONS}, q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
v AS (SELECT doc_id, list_cosine_similarity(embedding::double[], qv::double[]) AS v FROM c, q WHERE embedding IS NOT NULL ORDER BY v DESC, doc_id LIMIT 40),
k AS (SELECT doc_id, m / 9.0 AS w FROM (SELECT doc_id, n_chars, {" + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in WORDS)} AS m FROM c) WHERE m > 0 ORDER BY m DESC, n_chars, doc_id LIMIT 40),
h AS (SELECT doc_id, coalesce(v, w * 0.6) AS score FROM v FULL JOIN k USING (doc_id)),
r AS (SELECT h.doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, h.doc_id) AS n FROM h JOIN documents d ON d.doc_id = h.doc_id)
SELECT doc_id, round(score, 6) AS score FROM r WHERE n <= 3 ORDER BY r.score DESC, doc_id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    """Documents without a vector too: the keyword route asks all of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.lit("").alias("heading"), F.col("text").alias("content"), F.col("n_chars").alias("rank"))
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    out = recall.hybrid(chunks, _query_vector(spark, sf_dir), list(WORDS), 10)
    return out.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id, label FROM (SELECT vec_id, label, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM (SELECT vec_id, label, {_COS} AS s FROM embeddings e, {_Q})) WHERE n <= 3 ORDER BY s DESC, vec_id LIMIT 20""")
def diversify_per_group(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("score", V.cosine(F.col("embedding"), recall.vector_literal(_query_vector(spark, sf_dir))))
    return diversify(v, "label", "score", 3, 20, "vec_id").select("vec_id", "label")


_TERMS = ("the", "tion", "of", "der")


@query(f"""SELECT doc_id, ({" + ".join(f"(CASE WHEN contains(lower(source || ' ' || lang || ' ' || text), '{t}') THEN 1 ELSE 0 END)" for t in _TERMS)})::double AS rerank_score FROM documents ORDER BY rerank_score DESC, doc_id LIMIT 30""")
def lexical_rerank_fast(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("summary"), F.col("text").alias("content"), F.lit(0.0).alias("score"))
    return recall.rerank_fast(docs, "The tion, of der!", 30, "doc_id").select("doc_id", "rerank_score")


_KEYWORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s_-]', ' ', 'g'), '[\s]+'), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'for', 'with', 'from', 'that'))"


@query(rf"""WITH k AS (SELECT doc_id, {_KEYWORDS.format(x="text")} AS t FROM documents),
u AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:10] AS t FROM k)
SELECT doc_id, array_to_string(t, ',') AS keywords FROM u""")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), ",").alias("keywords"))


@query(rf"""WITH k AS (SELECT doc_id, {_KEYWORDS.format(x="source || ' ' || text")} AS t FROM documents),
u AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:10] AS t FROM k)
SELECT doc_id, len(list_intersect(t, ['src1', 'that', 'tion', 'des', 'her']))::double AS rerank_score FROM u ORDER BY rerank_score DESC, doc_id LIMIT 30""")
def lexical_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.lit(0.0).alias("score"))
    return recall.rerank_keywords(docs, "src1 that tion des her", 30, "doc_id").select("doc_id", "rerank_score")


_EDGES = "e AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem)"


@query(f"WITH {_EDGES} SELECT DISTINCT event_id, 1 AS hop FROM e WHERE entity_id IN (1, 2, 3)")
def graph_one_hop(spark, sf_dir):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "entity_id bigint")
    return graph.expand_once(seeds, _links(spark, sf_dir)).select("event_id", "hop")


_TWO = f"""WITH {_EDGES}, h1 AS (SELECT DISTINCT event_id FROM e WHERE entity_id = 1), n AS (SELECT DISTINCT entity_id FROM e WHERE event_id IN (FROM h1) AND entity_id <> 1),
h2 AS (SELECT DISTINCT event_id FROM e WHERE entity_id IN (FROM n) AND event_id NOT IN (FROM h1)) SELECT event_id, 1 AS hop FROM h1 UNION ALL SELECT event_id, 2 FROM h2"""


@query(_TWO)
def graph_two_hop(spark, sf_dir):
    return graph.expand_fixed(spark.createDataFrame([(1,)], "entity_id bigint"), _links(spark, sf_dir), 2)


@query(_TWO)
def graph_dynamic(spark, sf_dir):
    n_first = graph.expand_fixed(spark.createDataFrame([(1,)], "entity_id bigint"), _links(spark, sf_dir), 1).count()
    return graph.expand_until(spark.createDataFrame([(1,)], "entity_id bigint"), _links(spark, sf_dir), n_first + 1, 1)


@query("""SELECT o_orderkey AS event_id, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)), ','), '') AS entities FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def event_entities_agg(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    return graph.event_entity_lists(events, _links(spark, sf_dir)).select("event_id", F.array_join("entity_ids", ",").alias("entities"))


@query("SELECT p_partkey AS entity_id, count(DISTINCT l_orderkey)::bigint AS event_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def entity_event_counts(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"))
    return graph.project_graph(events, entities, _links(spark, sf_dir))[0].select("entity_id", "event_count")


@query(f"""WITH {_EDGES}, ev AS (SELECT 1 AS event_id UNION SELECT event_id FROM e WHERE entity_id IN (5, 6)), en AS (SELECT 5 AS entity_id UNION SELECT 6 UNION SELECT entity_id FROM e WHERE event_id = 1)
SELECT event_id, entity_id FROM e WHERE event_id IN (FROM ev) AND entity_id IN (FROM en)""")
def visible_subgraph(spark, sf_dir):
    open_entities = spark.createDataFrame([(5,), (6,)], "entity_id bigint")
    return graph.visible_subgraph(_links(spark, sf_dir), open_entities, spark.createDataFrame([(1,)], "event_id bigint"))


@query(f"WITH {_EDGES} SELECT event_id, entity_id FROM e WHERE entity_id = 7")
def node_neighbourhood(spark, sf_dir):
    return graph.neighbourhood(_links(spark, sf_dir), entity_id=7)


@query("SELECT * FROM (VALUES (0, 30::bigint), (1, 10::bigint), (2, 20::bigint)) t(place, o_orderkey) JOIN (SELECT o_orderkey, o_orderstatus FROM orders) USING (o_orderkey)")
def ordered_lookup(spark, sf_dir):
    return in_order([30, 10, 20], table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("""SELECT user_id, min(part)::int AS first_part FROM (SELECT user_id, 0 AS part FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'click') GROUP BY user_id""")
def ordered_set_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [e.where(F.col("event_type") == t).select("user_id", "event_id").withColumn("first_part", F.lit(i)) for i, t in enumerate(("purchase", "click"))]
    return ordered_union(parts, "user_id", "event_id").select("user_id", "first_part")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def set_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return minus(e.where("event_type = 'view'").select("user_id").distinct(), e.where("event_type = 'error' and value > 200").select("user_id"), "user_id")


@query("""SELECT conv_id, i::int AS index, chunk FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT conv_id, turn, role AS chunk, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1) WHERE i <= 5""")
def citations_dedupe(spark, sf_dir):
    from tessera.plans.search import citations

    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("call"), F.lit(0).alias("position"), F.col("role").alias("chunk_id"))
    return citations(calls).select(F.col("session").alias("conv_id"), "index", F.col("chunk_id").alias("chunk"))
