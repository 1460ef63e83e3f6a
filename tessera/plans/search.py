"""The search pipeline: routes, expansion, coarse and lexical ranking, sections, trace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, recall
from tessera.operators.rows import clamp, first_of, live
from tessera.plans.timing import Stages


@dataclass
class Options:
    """Bounds and thresholds of a multi-route search.

    expansion: `multi` (max_hops whole hops), `multi1` (one hop, then hops until max_events_b
    events are found), `hopllm` (as multi1, but the second part starts from the max_events_a
    events nearest to the query).  mode: `standard` (entities by text and by vector) or `fast`
    (by text alone).
    """

    entity_top_k: int = 20
    multi_top_k: int = 20
    entity_similarity: float = 0.9
    title_similarity: float = 0.4
    max_hops: int = 1
    max_events: int = 100
    max_events_a: int = 100
    max_events_b: int = 0
    max_hop_retries: int = 3
    rerank_top_k: int | None = None
    max_sections: int | None = None
    expansion: str = "multi"
    mode: str = "standard"


#: Most results of a search, and how many if no number is asked for.
MOST_RESULTS = 50


def search(strategy: str, **given) -> DataFrame:
    if strategy == "vector":
        return recall.hybrid(**given)
    if strategy == "multi":
        return multi_search(**given)[0]
    raise ValueError(f"unknown strategy: {strategy}")


def expand(seeds: DataFrame, known: DataFrame, links: DataFrame, events: DataFrame, query_vector: list[float], options: Options) -> tuple[DataFrame, DataFrame]:
    """(event_id of the first part, event_id of the second) by the expansion that the options name."""
    if options.expansion == "multi":
        found, _ = graph.expand_events(seeds, known, links, options.max_hops)
        return found.select("event_id"), found.select("event_id").where("false")
    if options.expansion not in ("multi1", "hopllm"):
        raise ValueError(f"unknown expansion: {options.expansion}")
    first, entities = graph.expand_events(seeds, known, links, 1)
    first = first.select("event_id")
    reached = seeds.select("event_id").unionByName(first)
    begin = first
    if options.expansion == "hopllm":
        mine = events.join(reached, "event_id", "left_semi")
        begin = recall.by_vector(mine, "content_vector", query_vector, options.max_events_a, None, "event_id").select("event_id")
    second, _ = graph.expand_events(begin, entities, links, options.max_hop_retries, reached, options.max_events_b)
    return first, second.select("event_id")


def multi_search(events: DataFrame, entities: DataFrame, links: DataFrame, chunks: DataFrame, query: str, query_vector: list[float], options: Options = Options(), top_k: int | None = None, rerank=recall.rerank_fast, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections: chunk_id, place, score; trace: stage, place, event_id, score).

    events, entities and links hold what is live (see `live_tables`).  Entities are recalled
    by text and vector; their events and those with a near title are the seeds, from which
    the expansion starts; all are ranked by content cosine, reranked (an empty answer of
    `rerank` leaves the coarse order), and the sections of the best follow in that order with
    the event's coarse score, filled up with vector hits.  Without seeds it is the hybrid search.
    stages, if given, is told the rows and milliseconds of entities, seeds, coarse and rerank.
    """
    kept = (stages or Stages()).kept
    spark, k = events.sparkSession, clamp(top_k, 1, MOST_RESULTS, MOST_RESULTS)
    best_k, n_sections = (k if v is None else clamp(v, 1, MOST_RESULTS, k) for v in (options.rerank_top_k, options.max_sections))
    known = recall.entities_by_text(entities, "name", query, options.entity_top_k).select("entity_id")
    if options.mode == "standard":
        known = known.unionByName(recall.by_vector(entities, "vector", query_vector, options.entity_top_k, options.entity_similarity, "name").select("entity_id"))
    elif options.mode != "fast":
        raise ValueError(f"unknown mode: {options.mode}")
    known = kept(known.distinct(), "entities")  # at most twice entity_top_k
    titled = recall.by_vector(events, "title_vector", query_vector, options.multi_top_k, options.title_similarity, "event_id").select("event_id", "score")
    seeds = kept(graph.events_of(known, links).unionByName(titled.select("event_id")).distinct(), "seeds")
    if seeds.isEmpty():
        out = recall.hybrid(chunks, query_vector, recall.query_tokens(spark, query), n_sections)
        return _placed(out, "score").select("chunk_id", "place", "score"), spark.createDataFrame([], TRACE)
    first, second = expand(seeds, known, links, events, query_vector, options)
    near = lambda ids, n: recall.by_vector(events.join(ids, "event_id", "left_semi"), "content_vector", query_vector, n, None, "event_id")
    if options.expansion == "multi":
        coarse = _placed(near(seeds.unionByName(first), options.max_events), "score")
    else:
        coarse = _placed(near(seeds.unionByName(first), options.max_events_a), "score")
        if options.max_events_b > 0:
            coarse = coarse.unionByName(_placed(near(second, options.max_events_b), "score").withColumn("place", F.col("place") + options.max_events_a))
    coarse = kept(coarse, "coarse")  # at most max_events rows
    best = kept(rerank(coarse, query, best_k, "event_id"), "rerank")
    if best.isEmpty():
        best = coarse.orderBy("place").limit(best_k).withColumn("rerank_score", -F.col("place").cast("double"))
    ranked = _placed(best, "rerank_score")
    sections = recall.sections_for(ranked.select("chunk_id", "place", "score"), chunks, n_sections)
    more = _placed(recall.by_vector(chunks, "embedding", query_vector, 2 * n_sections, None, "chunk_id"), "score")
    trace = _trace(titled, "title", "score").unionByName(_trace(coarse, "coarse", "score")).unionByName(_trace(best, "rerank", "rerank_score"))
    return _placed_in_order(recall.supplement(sections, more, n_sections)), trace


TRACE = "stage string, place int, event_id string, score double"


def live_tables(events: DataFrame, entities: DataFrame, links: DataFrame, documents: DataFrame, sources: DataFrame, source_ids: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, entities, links) that a search may see: live events, of the sources asked for; entities with such an event.

    events: event_id, document_id, source_id, deleted_at; documents, sources: id, archived_at.
    """
    mine = live(events, documents, sources)
    if source_ids is not None:
        mine = mine.where(F.col("source_id").isin(source_ids))
    seen = links.join(mine.select("event_id"), "event_id", "left_semi")
    return mine, entities.join(seen.select("entity_id"), "entity_id", "left_semi"), seen


def _placed_in_order(sections: DataFrame) -> DataFrame:
    """place from 0 over late, then place, of at most MOST_RESULTS rows."""
    from pyspark.sql import Window

    return sections.select("chunk_id", (F.row_number().over(Window.orderBy("late", "place")) - 1).alias("place"), "score")


def _placed(df: DataFrame, score: str) -> DataFrame:
    from pyspark.sql import Window

    tie = "event_id" if "event_id" in df.columns else "chunk_id"
    return df.drop("place").withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), tie)) - 1)  # at most a few hundred rows


def _trace(df: DataFrame, stage: str, score: str) -> DataFrame:
    return _placed(df, score).select(F.lit(stage).alias("stage"), "place", F.col("event_id").cast("string").alias("event_id"), F.col(score).cast("double").alias("score"))


def snapshots(trace: DataFrame) -> DataFrame:
    """The last stage's row of each event."""
    stages = F.when(F.col("stage") == "title", 0).when(F.col("stage") == "coarse", 1).otherwise(2)
    return first_of(trace.withColumn("__s", stages), ["event_id"], F.col("__s").desc(), "place").drop("__s")


def citations(calls: DataFrame, most: int = 5) -> DataFrame:
    """The first mention of each chunk over (session, call order, position), numbered from 1, at most five a session."""
    from pyspark.sql import Window

    first = first_of(calls, ["session", "chunk_id"], "call", "position")
    w = Window.partitionBy("session").orderBy("call", "position")
    return first.withColumn("index", F.row_number().over(w)).where(F.col("index") <= most)
