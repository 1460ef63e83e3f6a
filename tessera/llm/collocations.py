"""Phrases that stand together more often than their parts would: Apriori passes over the texts.

Pass k reads the texts and counts runs of k words.  A run is only emitted where both runs of
k - 1 words that overlap in it are frequent; pass 1 counts words.  What the earlier pass
found frequent is broadcast as a bitmap of hashes: it never holds less than the frequent runs,
and its size is bounded by `BITS` whatever their number, so nothing is lost at any size and a
full bitmap only lets more runs be counted.  Passes count 64-bit hashes, summed in each task
first; where hashes collide a run may seem too frequent, never too rare.  A last pass emits the
words themselves of what is left, so the level tables hold exact counts.

Candidates are cut at every place, the parts looked up in the level tables, and the cut of
the least floor(1000 * a * n / (l * r)) counts.  A candidate goes if a candidate one word
longer holds it as often as it occurs: runs between two that occur equally often do so too.

Null texts are empty, null languages `und`.  Repeated rows count as often as they stand there;
a run never crosses a mark of `MARKS` or a text's end.  Ids and other columns are not looked
at.  Empty tables and languages without candidates give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.native_text import if_small
from tessera.llm.textkit import LOWER, SLICE_BYTES, Scratch, hash_spans, mix, slices, strings

LEAST = 100
LONGEST = 5
TOP = 2000
#: Most bits of a bitmap (its base-2 logarithm): 32 MB.
BITS = 28
#: Runs that a task gathers before it sums them.
GATHERED = 4_000_000
#: Bytes that end a piece of a text.
MARKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(MARKS)] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of a slice of texts: hashes (language included), the piece of each, and their bytes with one blank after each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: np.ndarray) -> None:
        data = LOWER[data]
        inside = _WORD[data].view(np.int8)
        cut = at[1:-1]
        edges = np.diff(np.concatenate(([0], inside, [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[(inside[cut - 1] & inside[cut]).astype(bool)]
        if len(cut):
            starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        self.rows = np.searchsorted(at, starts, side="right") - 1
        marks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        self.piece = marks[starts] + self.rows  # both only grow, so a change of either is a change of the sum
        sizes = ends - starts
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.flat = np.full(self.begin[-1], 32, np.uint8)
        place = np.repeat(self.begin[:-1] - starts, sizes)
        full = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(starts) else np.zeros(0, np.int64)
        self.flat[full + place] = data[full]
        self.langs = langs[self.rows]
        self.hashes = hash_spans(data, starts, ends)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of k words within a piece."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.langs[:n] + np.uint64(k)
        for j in range(k):
            h = h * _STEP + self.hashes[j : n + j]
        on = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])
        return on, mix(h[on])

    def text(self, first: np.ndarray, k: int) -> pa.Array:
        starts, ends = self.begin[first], self.begin[first + k] - 1
        sizes = ends - starts
        at = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])] if len(sizes) else self.flat[:0]
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())


def _language_hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    data, at = b"".join(s.encode() for s in coded.dictionary.to_pylist()), np.concatenate(([0], np.cumsum([len(s.encode()) for s in coded.dictionary.to_pylist()]))).astype(np.int64)
    own = hash_spans(np.frombuffer(data, np.uint8), at[:-1], at[1:]) if len(at) > 1 else np.zeros(0, np.uint64)
    return mix(own + np.uint64(1))[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[_Words, pa.Array, int]]:
    langs = strings(batch.column(1))
    hashed = _language_hashes(langs)
    for first, data, at in slices(strings(batch.column(0)), 2 * SLICE_BYTES):
        yield _Words(data, at, hashed[first : first + len(at) - 1]), langs, first


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = h & np.uint64(8 * len(bits) - 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[cut], np.add.reduceat(c, cut) if len(cut) else c


def run_counts(docs: DataFrame, k: int, shorter=None) -> DataFrame:
    """hash, n: the runs of k words and how often they occur; of those only whose two runs of k - 1 words are in the bitmap `shorter` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = [], 0
        row = lambda h, c: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["hash", "n"])
        for batch in batches:
            for words, _, _ in _sliced(batch):
                first, h = words.runs(k)
                if shorter is not None:
                    part, of_part = words.runs(k - 1)
                    frequent = np.zeros(len(words.hashes) + 1, bool)
                    frequent[part] = _has(shorter.value, of_part)
                    h = h[frequent[first] & frequent[first + 1]]
                hashes.append(h)
                held += len(h)
                if held >= GATHERED:
                    yield row(*_summed(hashes, [np.ones(len(x), np.int64) for x in hashes]))
                    hashes, held = [], 0
        if held:
            yield row(*_summed(hashes, [np.ones(len(x), np.int64) for x in hashes]))

    return docs.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, count: int, most: int = BITS):
    """The hashes as a broadcast bitmap of up to 2^most bits, 16 for each hash where that is less; tasks set the bits, and only set bytes come to the driver."""
    bits = min(most, max(10, (16 * count).bit_length()))
    spot = F.col("hash").bitwiseAND((1 << bits) - 1)
    per = hashes.select(F.shiftright(spot, 15).alias("page"), F.shiftright(spot, 3).bitwiseAND(4095).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1), spot.bitwiseAND(7).cast("int")).alias("bit"))
    per = per.groupBy("page", "at").agg(F.bit_or("bit").alias("bit"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set bytes of a task, as two packed arrays a batch."""
        for b in batches:
            at = b.column(0).to_numpy() * 4096 + b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([b.column(2).to_numpy().astype(np.uint8).tobytes()], pa.binary())], ["at", "bit"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in per.mapInArrow(pages, "at binary, bit binary").toLocalIterator():
        at = np.frombuffer(row["at"], np.uint32)
        out[at] |= np.frombuffer(row["bit"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def level_tables(docs: DataFrame, maps: list) -> DataFrame:
    """lang, k, phrase, f: the runs of 1 to len(maps) words that are in the bitmaps of their levels, with exact counts; k 0 has all words of the language."""
    schema = "lang string, k int, phrase string, f bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, langs, start in _sliced(batch):
                lang_of = lambda first: langs.take(pa.array(start + words.rows[first]))  # noqa: B023, E731
                row = lambda first, k, phrase, n: pa.RecordBatch.from_arrays([lang_of(first), pa.array(np.full(len(first), k, np.int32)), phrase, pa.array(n)], ["lang", "k", "phrase", "f"])  # noqa: B023, E731
                _, one, n = np.unique(words.langs, return_index=True, return_counts=True)
                yield row(one, 0, pa.array([""] * len(one), pa.string()), n)
                frequent = None
                for k, bits in enumerate(maps, 1):
                    first, h = words.runs(k)
                    on = _has(bits.value, h)
                    if frequent is not None:
                        on &= frequent[first] & frequent[first + 1]
                    first, h = first[on], h[on]
                    if not len(h):
                        break
                    frequent = np.zeros(len(words.hashes) + 1, bool)
                    frequent[first] = True
                    _, one, n = np.unique(h, return_index=True, return_counts=True)
                    yield row(first[one], k, words.text(first[one], k), n)

    return docs.mapInArrow(run, schema).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, scratch: Scratch | None = None) -> DataFrame:
    """lang, k, phrase, f: every run of 1 to `longest` words that occurs `least` times or more; k 0: the words of each language."""
    scratch = scratch or Scratch(docs.sparkSession)
    given = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    maps = []
    for k in range(1, longest + 1):
        found = scratch.keep(run_counts(given, k, maps[-1] if maps else None).where(F.col("n") >= least).select("hash"), f"level{k}")
        count = found.count()
        if not count:
            break
        maps.append(bitmap(found, count))
        scratch.drop(f"level{k}")
    tables = level_tables(given, maps).where((F.col("f") >= least) | (F.col("k") == 0))
    tables = scratch.keep(tables, "levels")
    for m in maps:
        m.unpersist()
    return tables


def _exact(*factors: Column) -> Column:
    return functools.reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [f.cast("decimal(19,0)") for f in factors])


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language, by score, a (both descending), phrase (bytes)."""
    scratch = Scratch(docs.sparkSession)
    levels = frequent_phrases(docs, least, longest, scratch)
    totals = levels.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = levels.where("k > 0")
    phrases = parts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ", -1)
    joined = lambda start, size: F.array_join(F.slice(word, start, size), " ")
    inner = phrases.where("k > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"))
    inner = scratch.keep(inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer")), "inner")
    alone = scratch.keep(phrases.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer"), "alone")
    cuts = alone.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = scratch.keep(cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")), "cuts")
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    told = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(if_small(totals, 10_000), "lang")
    score = F.call_function("div", _exact(F.col("a"), F.col("n"), F.lit(1000)), _exact(F.col("l"), F.col("r")))
    told = told.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return told.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST} + 1) AS ks(k) WHERE len(w) >= k),
g AS (SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, words, f AS a FROM g WHERE k > 1),
inner_ AS (SELECT DISTINCT lang, words[i:j] AS words, a AS longer FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (FROM inner_ WHERE inner_.lang = c.lang AND inner_.words = c.words AND 100 * longer >= 100 * a)),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scored AS (SELECT cut.lang, cut.words, a, l.f AS l, r.f AS r, n, j, (1000::hugeint * a * n) // (l.f::hugeint * r.f) AS score
           FROM cut JOIN g l ON l.lang = cut.lang AND l.words = cut.words[1:j] JOIN g r ON r.lang = cut.lang AND r.words = cut.words[j + 1:] JOIN t ON t.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
told AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM told QUALIFY rank <= {TOP}
"""
