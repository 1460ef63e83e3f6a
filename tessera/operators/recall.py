"""Recall, merging and reranking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators.rows import diversify, top_k

#: Keyword hits that no vector hit confirms count for this much.
KEYWORD_WEIGHT = 0.6


def vector_literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def by_vector(df: DataFrame, vector: str, query: list[float], k: int, threshold: float | None = None, *ties: str) -> DataFrame:
    """The k rows of greatest cosine with the query, of at least the threshold, with score.

    Filters on df apply before the top k.  The query is a literal, so scoring is a
    projection of the scan and only k rows of each task are shuffled.
    """
    scored = df.where(F.col(vector).isNotNull()).withColumn("score", V.cosine(F.col(vector), vector_literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return top_k(scored, "score", k, *ties)


def by_vector_index(df: DataFrame, vector: str, query: list[float], k: int, keep: Column, *ties: str) -> DataFrame:
    """As an index answers that knows no filters: the k nearest first, then those that pass; score from the distance of unit vectors."""
    distance = V.l2_distance(V.normalize(F.col(vector)), V.normalize(vector_literal(query)))
    near = df.withColumn("distance", distance).orderBy("distance", *ties).limit(k)
    return near.where(keep).withColumn("score", V.score_from_l2(F.col("distance"))).drop("distance")


def entities_by_text(entities: DataFrame, name: str, query: str, k: int) -> DataFrame:
    """1.2 for equality, 1.0 if the query is in the name, 0.6 if the name is in the query; by score, then name."""
    own, wanted = F.lower(F.col(name)), F.lit(query.lower())
    score = F.when(own == wanted, 1.2).when(own.contains(wanted), 1.0).when((F.length(own) > 0) & wanted.contains(own), 0.6)
    return entities.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), name).limit(k)


def entities_by_names(entities: DataFrame, name: str, names: list[str]) -> DataFrame:
    """Entities whose name holds one of the names (of a model's answer: a few); score 1."""
    own = F.lower(F.col(name))
    wanted = F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>")
    return entities.where(F.exists(wanted, lambda n: own.contains(n))).withColumn("score", F.lit(1.0))


def query_tokens(spark, query: str) -> list[str]:
    """The tokens of one query string (a single row, so no data is collected)."""
    row = spark.range(1).select(T.query_tokens(F.lit(query)).alias("t")).first()
    return [t.lower() for t in row["t"]]


def keyword_hits(tokens: list[str], heading: str = "heading", content: str = "content") -> Column:
    """2 for each token in the heading and 1 for each in the content."""
    head, body = F.lower(F.coalesce(F.col(heading), F.lit(""))), F.lower(F.col(content))
    return sum((F.when(head.contains(t), 2).otherwise(0) + F.when(body.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))


def best_hits(hits: DataFrame, tokens: list[str], k: int, rank: str = "rank", *ties: str) -> DataFrame:
    """At most 50 rows of greatest match_count, then by rank, with their score."""
    return hits.orderBy(F.col("match_count").desc(), rank, *ties).limit(min(k, 50)).withColumn("score", F.col("match_count") / (3.0 * max(1, len(tokens))))


def by_keywords(chunks: DataFrame, tokens: list[str], k: int, heading: str = "heading", content: str = "content", rank: str = "rank", *ties: str) -> DataFrame:
    """match_count (2 for a token in the heading, 1 in the content) and score = match_count / (3 tokens); best first, then by rank."""
    found = chunks.withColumn("match_count", keyword_hits(tokens, heading, content)).where("match_count > 0")
    return best_hits(found, tokens, k, rank, *ties)


def merge_hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: str) -> DataFrame:
    """key, score, match_type: vector scores win; hits by keyword alone count 0.6."""
    v, w = vector_hits.select(key, F.col("score").alias("v")), keyword_hits.select(key, F.col("score").alias("w"))
    kind = F.when(F.col("v").isNull(), "keyword").when(F.col("w").isNull(), "vector").otherwise("hybrid")
    return v.join(w, key, "full_outer").select(key, F.coalesce("v", F.col("w") * KEYWORD_WEIGHT).alias("score"), kind.alias("match_type"))


def hybrid(chunks: DataFrame, query_vector: list[float], tokens: list[str], k: int, per_document: int = 3, key: str = "chunk_id", document: str = "document_id") -> DataFrame:
    """Vector and keyword hits (4k each) merged, at most per_document of a document, k best."""
    near = by_vector(chunks, "embedding", query_vector, 4 * k, None, key)
    words = by_keywords(chunks, tokens, 4 * k, "heading", "content", "rank", key)
    own = near.select(key, document).unionByName(words.select(key, document)).distinct()  # the hits bring their document: chunks are read once a recall
    merged = merge_hybrid(near, words, key).join(own, key)
    return diversify(merged, document, "score", per_document, k, key)


def lexical_terms(query: Column) -> Column:
    """Lower-case runs of letters and digits of two or more characters."""
    return F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def rerank_fast(df: DataFrame, query: str, k: int, *ties: str) -> DataFrame:
    """By the number of query terms in title, summary and content, plus the coarse score."""
    body = F.lower(F.concat_ws(" ", "title", "summary", "content"))
    hits = F.aggregate(lexical_terms(F.lit(query)), F.lit(0), lambda n, t: n + F.when(body.contains(t), 1).otherwise(0))
    return top_k(df.withColumn("rerank_score", hits + F.coalesce("score", F.lit(0.0))), "rerank_score", k, *ties)


def rerank_keywords(df: DataFrame, query: str, k: int, *ties: str) -> DataFrame:
    """By the number of keywords shared with the query, plus the coarse score."""
    shared = F.size(F.array_intersect(T.keywords(F.lit(query)), T.keywords(F.concat_ws(" ", "title", "content"))))
    return top_k(df.withColumn("rerank_score", shared + F.coalesce("score", F.lit(0.0))), "rerank_score", k, *ties)


def rerank_response(response: Column, n: Column) -> Column:
    """array<struct<index, score>> of a reranker's JSON answer by falling score; a missing score is minus the position; indexes out of range go."""
    items = F.from_json(response, "array<struct<index:int,relevance_score:double>>")
    scored = F.transform(items, lambda x, i: F.struct((-F.coalesce(x["relevance_score"], -i.cast("double"))).alias("order"), i.alias("i"), x["index"].alias("index")))
    able = F.filter(scored, lambda x: (x["index"] >= 0) & (x["index"] < n))
    return F.transform(F.array_sort(able), lambda x: F.struct(x["index"].alias("index"), (-x["order"]).alias("score")))


def rerank_document(title: Column, content: Column, n: int) -> Column:
    """What a reranker sees of one of n candidates."""
    return F.substring(F.concat_ws("\n", title, content), 1, max(500, min(2400, 28000 // max(1, n))))


def sections_for(events: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Chunks of events in the events' place order, each chunk once, with the event's score."""
    w = Window.partitionBy("chunk_id").orderBy("place")
    joined = events.select("chunk_id", "place", "score").join(chunks, "chunk_id").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return joined.orderBy("place").limit(k)


def supplement(sections: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """chunk_id, place, score, late: sections first (late 0), then chunks of more that are not among them, until there are k."""
    cols = ["chunk_id", "place", "score"]
    rest = more.select(*cols).join(sections.select("chunk_id"), "chunk_id", "left_anti").withColumn("late", F.lit(1))
    return sections.select(*cols).withColumn("late", F.lit(0)).unionByName(rest).orderBy("late", "place").limit(k)
