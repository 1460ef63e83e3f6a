"""How far apart the sources of a language are, by joint count histograms.

Documents are read once: each task counts the terms of its texts by language and source,
with the documents that hold them, and Spark adds the counts up.  A language keeps the
terms that enough of its documents hold.

For the pairs of sources, terms are dealt to blocks by hash.  A block's task lays its counts
out as a matrix, terms by sources, and tallies for each pair which (count, count)
combinations occur among terms that both have; a term is never a row of a pair.  Cells in
which one count or both are zero are implied: a source's own histogram, less what the joint
one holds of each count.  Then f is evaluated once for each combination of a pair, times its
multiplicity.  Sources are dealt to columns of about `COLUMNS`, so that a block's matrix is bounded
whatever their number.

p = 1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)) in whole numbers; f = |p - q|.
Null texts, languages and sources are read as ''.  A group whose documents have no kept term
has N = 0 and is compared all the same.  Repeated rows count as often as they stand there; ids
and other columns are not looked at.  An empty table gives no rows.  Terms of one slice of a
task's texts are told apart by 64-bit hashes, across slices by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import by_group
from tessera.llm.native_text import if_small
from tessera.llm.textkit import LOWER, SLICE_BYTES, Scratch, hash_spans, slices, strings, words

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Counts in a block of terms, and sources in a column of blocks, on average.
BLOCK_COUNTS, COLUMNS = 20_000, 64
#: Most groups, or pairs of them, that are broadcast.
BROADCAST_ROWS = 100_000

#: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as a string."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])] if len(sizes) else data[:0]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = strings(batch.column(1)), strings(batch.column(2))
            group = np.unique(np.stack([c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (lang, source)]), axis=1, return_inverse=True)[1].reshape(-1)
            for first, data, at in slices(strings(batch.column(0)), 4 * SLICE_BYTES):
                data = LOWER[data]
                starts, ends, rows = words(data, at, LETTERS)
                if not len(starts):
                    continue
                h, g = hash_spans(data, starts, ends), group[first + rows]
                order = np.lexsort((rows, h, g))
                h, g, rows = h[order], g[order], rows[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
                in_doc = new | np.concatenate(([True], rows[1:] != rows[:-1]))
                cut = np.flatnonzero(new)
                one, row = order[cut], pa.array(first + rows[cut])
                yield pa.RecordBatch.from_arrays([lang.take(row), source.take(row), take_spans(data, starts[one], ends[one]).cast(pa.string()), pa.array(np.diff(np.append(cut, len(h)))), pa.array(np.add.reduceat(in_doc.astype(np.int64), cut))], ["lang", "source", "term", "n", "docs"])

    counted = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n of the terms that at least that many documents of their language hold."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")
    return counts.drop("docs").join(kept, ["lang", "term"])


def share(count: Column, total: Column, kept: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * kept)); products are decimals, so none overflows."""
    above = (count + smoothing).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)")
    return F.call_function("div", above, (total + smoothing * kept).cast("decimal(38,0)")) + 1


def joint_histograms(kept: DataFrame, n_rows: int, n_sources: int) -> DataFrame:
    """lang, left, right (sources, left < right), a, b, n: how many terms have count a in left and b in right, both over 0."""
    n_blocks, n_columns = max(1, -(-n_rows // BLOCK_COUNTS)), max(1, -(-n_sources // COLUMNS))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("source"), F.lit(n_columns)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1))))
    dealt = dealt.select("lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "source", "term", "n")

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        names = rows.column("source").combine_chunks().dictionary_encode()
        col, line = names.indices.to_numpy(), rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        own, across = rows.column("own").to_numpy(), rows.column("i")[0] != rows.column("j")[0]
        names = names.dictionary.to_pylist()
        matrix = np.zeros((len(names), int(line.max()) + 1), np.int64)
        matrix[col, line] = rows.column("n").to_numpy()
        column = np.zeros(len(names), np.int64)
        column[col] = own
        order = sorted(range(len(names)), key=lambda k: names[k].encode())
        out: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for x, s in enumerate(order):
            has = np.flatnonzero(matrix[s])
            for t in order[x + 1 :]:
                if across and column[s] == column[t]:
                    continue
                both = has[matrix[t, has] > 0]
                if len(both):
                    cells, n = np.unique(np.stack((matrix[s, both], matrix[t, both])), axis=1, return_counts=True)
                    out.append((s, t, cells[0], cells[1], n))
        if not out:
            return None
        sizes = [len(o[2]) for o in out]
        pick = lambda k: pa.array([names[o[k]] for o in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
        a, b, n = (pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (2, 3, 4))
        return pa.RecordBatch.from_arrays([pa.array([rows.column("lang")[0].as_py()] * sum(sizes), pa.string()), pick(0), pick(1), a, b, n], ["lang", "left", "right", "a", "b", "n"])

    tallied = by_group(dealt, ["lang", "block", "i", "j"], run, "lang string, left string, right string, a bigint, b bigint, n bigint")
    return tallied.groupBy("lang", "left", "right", "a", "b").agg(F.sum("n").alias("n"))


def combinations(pairs: DataFrame, joint: DataFrame, histograms: DataFrame) -> DataFrame:
    """lang, left, right, a, b, n: every combination of counts that occurs among a pair's terms, zeros included; n add up to the kept terms.

    pairs: lang, left, right, kept, left_terms, right_terms; histograms: lang, source, count, n.
    """
    zero = F.lit(0).cast("long")
    of = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    met = joint.select("lang", "left", "right", F.inline(F.array(of(a, b, n), of(a, zero, -n), of(zero, b, -n), of(zero, zero, n))))
    small = if_small(pairs, BROADCAST_ROWS)
    side = lambda name: histograms.withColumnRenamed("source", name).join(small, ["lang", name])
    lone = side("left").select("lang", "left", "right", F.col("count").alias("a"), zero.alias("b"), "n")
    lone = lone.unionByName(side("right").select("lang", "left", "right", zero.alias("a"), F.col("count").alias("b"), "n"))
    none = pairs.select("lang", "left", "right", zero.alias("a"), zero.alias("b"), (F.col("kept") - F.col("left_terms") - F.col("right_terms")).alias("n"))
    return met.unionByName(lone).unionByName(none).groupBy("lang", "left", "right", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms (kept ones that it has), kept, lang_total, of every group that occurs."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    lang = kept.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    there = docs.select(name("lang"), name("source")).distinct()
    return there.join(own, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP) -> dict[str, DataFrame]:
    """pairs: lang, left, right, value of each pair of sources once; terms: lang, source, term, value, rank of the `top` terms that a source has more of than its language."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(term_counts(docs), "counts")
    kept = scratch.keep(kept_counts(counts, min_docs), "kept")
    groups = scratch.keep(_groups(docs, kept), "groups")
    scratch.drop("counts")
    n_sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), F.col("terms").alias(f"{name}_terms"), *(["kept"] if name == "left" else []))
    pairs = scratch.keep(side("left").join(side("right"), "lang").where("left < right"), "pairs")
    joint = joint_histograms(kept, kept.count(), n_sources)
    histograms = kept.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("n"))
    cells = combinations(pairs, joint, histograms).join(if_small(pairs, BROADCAST_ROWS), ["lang", "left", "right"])
    p = lambda count, total: share(F.col(count), F.col(total), F.col("kept"), smoothing, scale)
    sums = cells.groupBy("lang", "left", "right").agg(F.sum(F.col("n") * F.abs(p("a", "left_total") - p("b", "right_total"))).alias("value"))
    told = pairs.select("lang", "left", "right").join(sums, ["lang", "left", "right"], "left").fillna(0, ["value"])
    whole = kept.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).join(if_small(groups, BROADCAST_ROWS), ["lang", "source"])
    more = whole.withColumn("value", p("n", "total") - p("lang_n", "lang_total")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term"))
    return {"pairs": told, "terms": more.select("lang", "source", "term", "value", rank.alias("rank")).where(F.col("rank") <= top)}


def source_report(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    got = divergence(docs)
    both = F.inline(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item"))))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = got["pairs"].select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(got["terms"].select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL),
gp AS (SELECT lang, source, term, n, 1 + ({SCALE}::hugeint * (n + {SMOOTHING})) // ((sum(n) OVER (PARTITION BY lang, source)) + {SMOOTHING} * v) AS p FROM grid JOIN v USING (lang)),
lp AS (SELECT lang, term, 1 + ({SCALE}::hugeint * (n + {SMOOTHING})) // ((sum(n) OVER (PARTITION BY lang)) + {SMOOTHING} * v) AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::bigint AS value
         FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::bigint AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
