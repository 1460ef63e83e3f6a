"""Benchmark decontamination by a positional inverted index, in DataFrame functions.

Every run of `n` words of a benchmark item is a window.  A first pass counts how often
the benchmark's terms occur in the documents.  A second pass stores the posting lists
(term, document, position) of the `LISTS` rarest terms of each window.  Beginning with
the rarest, positions are adjusted by a term's offset to the start that the window would
have, and only starts that all of the window's lists hold are kept.  A third pass tests
these against the other words: all of them at their offsets for a phrase, a share of them
near it for a proximity match.

Term, window and start tables are broadcast only if their size is found to be small, and
joined by shuffles otherwise.  The first two passes shuffle no text; the third shuffles
texts only where the starts (20 bytes each) are too large for a broadcast.  In it the
words at a start are compared with the window by 128 bits of hashes.

Null texts and items have no words.  Rows that repeat both id and text share a result.
An item with fewer than n words, but some, is one window.  Only A-Z are folded: other letters
in either case are different, wherever they stand in a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.native_text import ascii_lower, held, if_small, unused, words
from tessera.llm.textkit import Scratch

WINDOW = 13
#: The rarest terms of a window whose posting lists are intersected.
LISTS = 3
#: Most rows of a table of terms or windows that is broadcast.
BROADCAST_ROWS = 200_000
#: Most bytes of the table of starts that is broadcast.
BROADCAST_BYTES = 32 << 20


def _hashes(window: Column) -> list[Column]:
    return [F.xxhash64(window).alias("x"), F.xxhash64(F.lit(1), window).alias("y")]


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """window (words joined by blanks), x, y (its hashes), words, items (ids as strings): the distinct windows."""
    own = items.select(F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.col("text"))).alias("own")).where(F.size("own") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("own") - (n - 1), F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda s: F.slice("own", s, n))).alias("cut"))
    per = cut.select("item", F.array_join("cut", " ").alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))
    return per.select("*", *_hashes(F.col("window")), F.split("window", " ").alias("words"))


def frequencies(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """term, n: how often each term of the windows occurs in the documents, if it does."""
    terms = wins.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select(F.explode(words(ascii_lower(F.col("text")))).alias("term"))
    return tokens.join(if_small(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, term: every place of the terms."""
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(words(ascii_lower(F.col("text")))).alias("at", "term"))
    return tokens.join(if_small(terms, BROADCAST_ROWS), "term")


def _same_document(left: str = "", right: str = "__") -> Column:
    return F.col(f"{left}doc_id").eqNullSafe(F.col(f"{right}doc_id")) & (F.col(f"{left}text_hash") == F.col(f"{right}text_hash"))


def phrase_starts(docs: DataFrame, wins: DataFrame, scratch: Scratch, lists: int = LISTS) -> DataFrame:
    """doc_id, text_hash, window, start: places where the lists of the window's rarest terms agree."""
    often = scratch.keep(frequencies(docs, wins), "often")
    at = wins.select("window", F.posexplode("words").alias("offset", "term")).join(often, "term", "left")
    ranked = at.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("rank"))
    ranked = scratch.keep(ranked.where("rank[0].n > 0").select("window", F.slice("rank", 1, lists).alias("rank")), "ranked")
    listed = scratch.keep(postings(docs, ranked.select(F.explode("rank.term").alias("term")).distinct()), "postings")
    rarest = ranked.select("window", F.col("rank")[0]["term"].alias("term"), F.col("rank")[0]["offset"].alias("offset"), F.slice("rank", 2, lists).alias("rest"))
    starts = listed.join(if_small(rarest, BROADCAST_ROWS), "term").where("at >= offset").select("doc_id", "text_hash", "window", (F.col("at") - F.col("offset")).alias("start"), "rest").distinct()
    alone = starts.where(F.size("rest") == 0).select("doc_id", "text_hash", "window", "start")
    asked = starts.select("doc_id", "text_hash", "window", "start", F.size("rest").alias("need"), F.inline("rest")).withColumn("at", F.col("start") + F.col("offset"))
    there = listed.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), F.col("at").alias("__at"), F.col("term").alias("__term"))
    agreed = asked.join(there, _same_document() & (F.col("at") == F.col("__at")) & (F.col("term") == F.col("__term")), "left_semi")
    agreed = agreed.groupBy("doc_id", "text_hash", "window", "start").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n = need")
    return agreed.select("doc_id", "text_hash", "window", "start").unionByName(alone)


def near_starts(docs: DataFrame, wins: DataFrame, scratch: Scratch, share: float, slack: int) -> DataFrame:
    """doc_id, text_hash, window, start: places within reach of one of a window's rarest words.

    A place lacks at most floor((1 - share) * d) of d distinct words, so it holds one of any
    floor((1 - share) * d) + 1 of them: the lists of the rarest are read, and each place that
    has one in reach is asked.  Words that no document holds count among them.
    """
    often = scratch.keep(frequencies(docs, wins), "near_often")
    each = wins.select("window", F.size("words").alias("length"), F.explode(F.array_distinct("words")).alias("term")).join(often, "term", "left")
    ranked = each.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("rank"), F.first("length").alias("length"))
    spare = F.floor((1 - share) * F.size("rank") + 1e-9).cast("int")
    chosen = ranked.select("window", "length", F.explode(F.slice("rank", F.lit(1), F.least(spare + 1, F.size("rank")))).alias("one")).where("one.n > 0")
    found_by = scratch.keep(chosen.select(F.col("one.term").alias("term"), "window", "length"), "found_by")
    listed = postings(docs, found_by.select("term").distinct())
    reach = F.sequence(F.greatest(F.col("at") - F.col("length") - slack + 1, F.lit(0)), F.col("at") + slack)
    return listed.join(if_small(found_by, BROADCAST_ROWS), "term").select("doc_id", "text_hash", "window", F.explode(reach).alias("start")).distinct()


def _asked(docs: DataFrame, starts: DataFrame, one: Column, size: int, scratch: Scratch, name: str) -> DataFrame:
    """doc_id, text, asked: the documents with their starts (`one` of each, of about `size` bytes)."""
    per = starts.groupBy(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")).agg(F.collect_list(one).alias("asked"))
    per = scratch.keep(per, name)
    held_bytes = per.select(F.sum(F.size("asked") * size + 40)).first()[0] or 0
    same = docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col("__text_hash"))
    return docs.join(F.broadcast(per) if held_bytes <= BROADCAST_BYTES else per, same).select("doc_id", "text", "asked")


def _same_words(own: Column, c: Column) -> Column:
    x, y = _hashes(F.array_join(F.slice(own, c["start"] + 1, c["length"]), " "))
    return (x == c["x"]) & (y == c["y"])


def _close(own: Column, c: Column, share: float, slack: int) -> Column:
    """Whether the share of the window's distinct words is there, from `slack` before to `slack` after."""
    low, wanted = F.greatest(c["start"] - slack, F.lit(0)), F.array_distinct(c["words"])
    around = F.slice(own, low + 1, c["start"] + c["length"] + slack - low)
    return (c["start"] < F.size(own)) & (F.size(F.array_intersect(wanted, around)) / F.size(wanted) >= share - 1e-9)


def matches(docs: DataFrame, items: DataFrame, n: int = WINDOW, proximity: float | None = None, slack: int = 4, lists: int = LISTS) -> DataFrame:
    """doc_id, text_hash, start, length, window, items, kind: occurrences of windows, in words from 0.

    kind is phrase; with proximity (a share of a window's distinct words, 0 to 1) also near,
    for every place (see near_starts) that overlaps no phrase of the window.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    wins = scratch.keep(windows(items, n), "windows")

    known = wins.select("x", "y", F.size("words").alias("length"), "window", "words", "items")

    def told(asked: DataFrame, own: Column, test, kind: str) -> DataFrame:
        found = held(own, lambda words_: F.filter("asked", lambda c: test(words_, c)))
        one = asked.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(found).alias("c")).select("doc_id", "text_hash", "c.start", "c.x", "c.y")
        full = one.join(if_small(known.drop("words"), BROADCAST_ROWS), ["x", "y"])
        return full.select("doc_id", "text_hash", "start", "length", "window", "items", F.lit(kind).alias("kind"))

    def full(starts: DataFrame, *more: str) -> DataFrame:
        return starts.join(if_small(known.select("window", "x", "y", "length", *more), BROADCAST_ROWS), "window")

    one = ["start", "length", "x", "y"]
    asked = _asked(docs, full(phrase_starts(docs, wins, scratch, lists)), F.struct(*one), 24, scratch, "phrases")
    found = told(asked, words(ascii_lower(F.col("text"))), _same_words, "phrase")
    if proximity is None:
        return found
    asked = _asked(docs, full(near_starts(docs, wins, scratch, proximity, slack), "words"), F.struct(*one, "words"), 24 + 16 * n, scratch, "near")
    near = told(asked, words(ascii_lower(F.col("text"))), lambda own, c: _close(own, c, proximity, slack), "near")
    at = found.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text_hash", "window", "start")])
    same_place = _same_document() & (F.col("window") == F.col("__window")) & (F.abs(F.col("start") - F.col("__start")) < F.col("length"))
    return found.unionByName(near.join(at, same_place, "left_anti"))


def _hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """__doc_id, __text_hash, n_hit, items: the words of each document that windows cover, and whose windows they are."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    per = matches(docs, items, n).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per = per.select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), covered.cast("long").alias("n_hit"), "items")
    return Scratch(docs.sparkSession).keep(per, "hits")


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), contaminated for every row of docs."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = own.join(_hits(docs, items, n), _same_document(), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs, any columns, without the rows of which windows of the benchmark cover a twentieth or more of the words."""
    hits = _hits(docs, items, n)
    names = {c: unused(docs, c) for c in ("__doc_id", "__text_hash", "n_hit")}
    hits = hits.select(*[F.col(c).alias(name) for c, name in names.items()])
    own, text_hash, n_hit = (F.col(name) for name in names.values())
    bad = docs["doc_id"].eqNullSafe(own) & (F.xxhash64(docs["text"]) == text_hash) & (20 * n_hit >= F.size(words(docs["text"])))
    return docs.join(hits, bad, "left_anti")


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return report(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS win FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM ds),
m AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw USING (win) WHERE dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
