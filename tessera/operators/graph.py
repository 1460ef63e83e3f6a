"""Hops over the bipartite graph of events and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import global_ranks

MOST_HOPS = 10


def events_of(entities: DataFrame, links: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """event_id: distinct events of the entities (entity_id), without excluded ones."""
    out = links.join(entities.select("entity_id"), "entity_id", "left_semi").select("event_id").distinct()
    return out if exclude is None else out.join(exclude.select("event_id"), "event_id", "left_anti")


def entities_of(events: DataFrame, links: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    out = links.join(events.select("event_id"), "event_id", "left_semi").select("entity_id").distinct()
    return out if exclude is None else out.join(exclude.select("entity_id"), "entity_id", "left_anti")


def expand_fixed(seeds: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """event_id, hop: events reached from seed entities in up to `hops` steps, each at its least hop.

    The frontier of a hop is what no hop before has seen; checkpoints in the shared
    folder cut the lineage, and an empty frontier ends the walk.
    """
    frontier, seen_entities, found = seeds.select("entity_id").distinct(), seeds.select("entity_id").distinct(), None
    for hop in range(1, min(hops, MOST_HOPS) + 1):
        new = events_of(frontier, links, found).withColumn("hop", F.lit(hop))
        new = _cut(new)
        found = new if found is None else _cut(found.unionByName(new))
        if hop == hops or new.isEmpty():
            break
        frontier = _cut(entities_of(new, links, seen_entities))
        seen_entities = seen_entities.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def expand_once(seeds: DataFrame, links: DataFrame) -> DataFrame:
    return expand_fixed(seeds, links, 1)


def expand_until(seeds: DataFrame, links: DataFrame, target: int, retries: int = 3) -> DataFrame:
    """Whole hops until at least `target` events are found, or the retries or the graph end."""
    first = _cut(expand_fixed(seeds, links, 1))
    if first.count() >= target or not retries:
        return first
    known = seeds.select("entity_id").distinct()
    more, _ = expand_events(first, known, links, retries, first, target - first.count())
    return first.unionByName(more.withColumn("hop", F.col("hop") + 1))


def expand_events(seeds: DataFrame, known: DataFrame, links: DataFrame, hops: int, exclude: DataFrame | None = None, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(event_id and hop of events reached from seed events, entity_id of all entities seen).

    A hop takes the entities of the last hop's events that are not known, then their events
    that are neither seeds nor excluded nor found before.  It ends after `hops` of them, when
    nothing new comes, or with the hop that brings the found events to `target`.
    """
    current = seeds.select("event_id").distinct()
    seen_events = current if exclude is None else current.unionByName(exclude.select("event_id"))
    entities, found = known.select("entity_id").distinct(), links.select("event_id", F.lit(0).alias("hop")).where("false")
    if target == 0:
        return found, entities
    for hop in range(1, hops + 1):
        fresh = _cut(entities_of(current, links, entities))
        if fresh.isEmpty():
            break
        entities = entities.unionByName(fresh)
        current = _cut(events_of(fresh, links, seen_events))
        if current.isEmpty():
            break
        seen_events = seen_events.unionByName(current)
        found = _cut(found.unionByName(current.withColumn("hop", F.lit(hop))))
        if target is not None and found.count() >= target:
            break
    return found, entities


def _cut(df: DataFrame) -> DataFrame:
    from tessera.plans.storage import checkpointed

    return checkpointed(df)


def event_entity_lists(events: DataFrame, links: DataFrame) -> DataFrame:
    """events with entity_ids: sorted, empty for an event without entities."""
    lists = links.groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return events.join(lists, "event_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast(links.schema["entity_id"].dataType.simpleString().join(["array<", ">"]))))


def project_graph(events: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity nodes with their number of events, event nodes with entity ids, edges between the two)."""
    edges = links.join(events.select("event_id"), "event_id", "left_semi").join(entities.select("entity_id"), "entity_id", "left_semi").select("event_id", "entity_id").distinct()
    counts = edges.groupBy("entity_id").agg(F.count("*").alias("event_count"))
    nodes = entities.join(counts, "entity_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("long")))
    return nodes, event_entity_lists(events, edges), edges


def visible_subgraph(edges: DataFrame, open_entities: DataFrame, open_events: DataFrame) -> DataFrame:
    """Edges with both ends visible: open nodes and the neighbours of open nodes."""
    events = open_events.select("event_id").unionByName(events_of(open_entities, edges)).distinct()
    entities = open_entities.select("entity_id").unionByName(entities_of(open_events, edges)).distinct()
    return edges.join(events, "event_id", "left_semi").join(entities, "entity_id", "left_semi")


#: Entities that a graph shows before any is opened.
SHOWN_FIRST = 8


def visible_graph(events: DataFrame, entities: DataFrame, links: DataFrame, open_entities: DataFrame, open_events: DataFrame, first: int = SHOWN_FIRST, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes: kind, id, label, place, open; edges: entity_id, event_id, from_event, marked) of what is to be seen.

    To be seen are the `first` entities with the most events, open nodes and their neighbours.
    Entities come first, by events (most first), name and id; then events by rank and id.  An
    edge between two nodes leads from the event where that alone is open, and is marked where either is.
    Places come from sorted ranges that are written once; without `places` the nodes have none.
    """
    nodes, _, edges = project_graph(events, entities, links)
    order = [F.col("event_count").desc(), F.col("name"), F.col("entity_id")]
    initial = nodes.orderBy(*order).limit(first).select("entity_id")
    seen = initial.unionByName(open_entities.select("entity_id")).unionByName(entities_of(open_events, edges).select("entity_id")).distinct()
    shown = nodes.join(seen, "entity_id", "left_semi").join(open_entities.select("entity_id", F.lit(True).alias("open")).distinct(), "entity_id", "left")
    seen = events_of(open_entities, edges).select("event_id").distinct()
    told = events.join(seen, "event_id", "left_semi").join(open_events.select("event_id", F.lit(True).alias("open")).distinct(), "event_id", "left")
    text = lambda c: F.col(c).cast("string")
    first_ = shown.select(F.lit("entity").alias("kind"), text("entity_id").alias("id"), F.col("name").alias("label"), (-F.col("event_count")).alias("__a"), F.col("name").alias("__b"), "open")
    then = told.select(F.lit("event").alias("kind"), text("event_id").alias("id"), F.col("title").alias("label"), F.col("rank").cast("bigint").alias("__a"), F.lit("").alias("__b"), "open")
    out, shown_as = first_.unionByName(then), ["kind", "id", "label", F.coalesce("open", F.lit(False)).alias("open")]
    if places:
        out, shown_as = global_ranks(out, "kind", "__a", "__b", "id"), [*shown_as[:3], F.col("place").cast("int").alias("place"), shown_as[3]]
    out = out.select(*shown_as)
    there = edges.join(shown.select("entity_id", F.coalesce("open", F.lit(False)).alias("__e")), "entity_id").join(told.select("event_id", F.coalesce("open", F.lit(False)).alias("__v")), "event_id")
    return out, there.select("entity_id", "event_id", (F.col("__v") & ~F.col("__e")).alias("from_event"), (F.col("__v") | F.col("__e")).alias("marked"))


def neighbourhood(edges: DataFrame, event_id=None, entity_id=None) -> DataFrame:
    """Edges at the selected node."""
    return edges.where(F.col("event_id") == event_id if event_id is not None else F.col("entity_id") == entity_id)
