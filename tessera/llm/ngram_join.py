"""Similarity self-join on word n-grams: MinHash bands, then exact verification.

Words are runs of letters, digits and non-ASCII characters, lower-cased; a text's
set holds its runs of `n` words (one shorter run if it has fewer words, none if it
has no words).  Texts with equal sets are one class; classes are joined, copies are
not expanded.  `BANDS` bands of `ROWS` rows find a pair of Jaccard similarity 0.8
with probability 1 - (1 - 0.8^6)^32 > 0.9999.

A bucket's members are compared by an estimate from their signatures, seven standard
errors below the threshold: first all with the least of them, a row for each member;
then, in buckets where that leaves more than one group, all with those outside of the
largest group, in blocks inside of tasks, which give at most a row for each member.
The groups that the estimates connect are verified pair by pair on full sets, in blocks
(see blocks.py), so every link between different texts is counted and no pair becomes a
row, whatever the size of a bucket or group.

Rows with null ids or without words link with nothing.  Rows that repeat an id are
rows of their own.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK, by_group, labels_of, pair_blocks, settle
from tessera.llm.graph import components
from tessera.llm.textkit import ALNUM, LOWER, Scratch, hash_spans, mix, shingles, slices, strings, words

BANDS, ROWS = 32, 6


def _salts() -> tuple[np.ndarray, np.ndarray]:
    at = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at[::2], at[1::2] | np.uint64(1)


def sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of a slice by row, offsets by row)."""
    for first, data, at in slices(strings(column)):
        low = LOWER[data]
        s, e, r = words(low, at, ALNUM)
        h, r = shingles(hash_spans(low, s, e), r, n)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        if len(h):
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
            h, r = h[new], r[new]
        yield first, h, np.searchsorted(r, np.arange(len(at)))


def _keys(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, alike for equal sets; None for empty ones."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        a = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[full]))
        b = mix(np.bitwise_xor.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), at[full]) + np.diff(at)[full].astype(np.uint64))
        both = np.stack([a, b], axis=1)
        for i, k in zip(full, both):
            out[i] = k.tobytes()
    return out


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The upper half of the least hash under each permutation, 16 bits each, for the rows that have shingles."""
    full = at[:-1][np.diff(at) > 0]
    xor, by = _salts()
    out = np.empty((len(full), BANDS * ROWS), np.uint16)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((h ^ xor[k]) * by[k], full)
        out[:, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def sign(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (the class), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            sigs: list[bytes | None] = []
            for _, h, at in sets(batch.column(1), n):
                got = _keys(h, at)
                rows = iter(_signatures(h, at)) if len(h) else iter(())
                keys += got
                sigs += [next(rows).tobytes() if k is not None else None for k in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, sig binary")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """key, shingles: the distinct shingle hashes of each text, sorted, as int64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for _, h, at in sets(batch.column(0), n):
                keys += _keys(h, at)
                out += [h[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles binary").where("key is not null")


def _signed(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _estimate(a, b):
    """Share of equal positions of two signatures."""

    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array((_signed(x) == _signed(y)).mean(axis=1) if len(x) else [], pa.float64())

    return share(a, b)


def _across(least: float):
    """Rows of one block pair of a bucket: those on the left against those on the right, of other labels."""

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        on_left = rows["left"].to_numpy()
        order = np.argsort(~on_left, kind="stable")
        n = int(on_left.sum())
        if not 0 < n < len(order):
            return None
        rows = rows.take(pa.array(order))
        sig = _signed(rows["sig"])
        label = np.unique(np.array(rows["label"].to_pylist(), object), return_inverse=True)[1]
        linked = np.zeros((len(sig), len(sig)), bool)
        for lo in range(0, n, 64):
            near = (sig[lo : min(lo + 64, n), None] == sig[None, n:]).mean(axis=2) >= least
            linked[lo : min(lo + 64, n), n:] = near & (label[lo : min(lo + 64, n), None] != label[None, n:])
        linked |= linked.T
        on = np.flatnonzero(linked.any(axis=1))
        if not len(on):
            return None
        names = rows["label"].combine_chunks()
        return pa.RecordBatch.from_arrays([names.take(pa.array(on)), names.take(pa.array(labels_of(linked)[on]))], ["a", "b"])

    return run


def candidate_groups(classes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """node (a key), label: groups that hold both ends of every pair that shares a band and is estimated at `least` or more.

    Of buckets with the same members only one is worked on.
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    entries = classes.select("key", F.explode(bands).alias("bucket"))
    alike = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]
    full = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("first"), *alike).where("size > 1")
    full = full.groupBy("size", "first", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "first")
    full = scratch.keep(entries.join(full, "bucket"), "buckets")
    sigs = classes.select("key", "sig")
    pairs = full.where(F.col("key") != F.col("first")).select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("y")), "b")
    labels = scratch.keep(components(pairs.where(_estimate(F.col("x"), F.col("y")) >= least).select("a", "b"), scratch), "hubs")
    scratch.drop("labels")

    named = full.select("bucket", "key").join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
    named = scratch.keep(named.select("bucket", "key", F.coalesce("label", "key").alias("label")), "named")
    per = named.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("n_labels"))
    mixed = per.where("n_labels > 1").select("bucket", F.col("most.label").alias("largest"), F.ceil((F.col("size") - F.col("most.n")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("int").alias("columns"))
    asked = named.join(mixed, "bucket")
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "key"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outside = F.when(F.col("label") != F.col("largest"), F.transform(every("columns"), lambda c: F.struct(F.lit(True).alias("left"), at(7, "rows").alias("i"), c.alias("j"))))
    against = F.transform(every("rows"), lambda r: F.struct(F.lit(False).alias("left"), r.alias("i"), at(11, "columns").alias("j")))
    tasks = asked.select("bucket", "key", "label", F.inline(F.concat(F.coalesce(outside, F.array().cast("array<struct<left:boolean,i:int,j:int>>")), against)))
    kind = classes.schema["key"].dataType.simpleString()
    more = scratch.keep(by_group(tasks.join(sigs, "key"), ["bucket", "i", "j"], _across(least), f"a {kind}, b {kind}").distinct(), "more")
    scratch.drop("buckets", "named")
    if more.isEmpty():
        return labels
    joined = components(more, scratch).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    alone = joined.join(labels, "label", "left_anti").select(F.col("label").alias("node"), "label")  # keys that no first comparison linked
    return labels.unionByName(alone).join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))


def overlaps(parts: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """How many members each two sets share: products of 0/1 matrices over columns of the shared members."""
    n = len(parts)
    every, owner = np.concatenate(parts), np.repeat(np.arange(n), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    everywhere = count == n
    shared = np.full((n, n), float(everywhere.sum()))
    useful = (count > 1) & ~everywhere
    place = np.cumsum(useful) - 1
    on = useful[column]
    column, owner = place[column[on]], owner[on]
    step = max(1, cells // n)
    for lo in range(0, int(useful.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, step), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        shared += m @ m.T
    return shared


def _verify(threshold: float):
    def run(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        parts = [np.frombuffer(b, np.uint64) for b in rows["shingles"].to_pylist()]
        size = np.array([len(p) for p in parts], float)
        shared = overlaps(parts)
        linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
        linked = settle(linked, rows["own"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py())
        if not linked.any():
            return None
        on = np.flatnonzero(linked.any(axis=1))
        links = linked.astype(np.int64) @ rows["weight"].to_numpy()
        label = labels_of(linked)
        key = rows["key"].combine_chunks()
        return pa.RecordBatch.from_arrays([key.take(pa.array(on)), key.take(pa.array(label[on])), pa.array(links[on], pa.int64())], ["a", "b", "links"])

    return run


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept for every row of docs (doc_id, text).

    class_id: the least doc_id with the same set.  n_links: other rows of at least that
    similarity, copies included.  component_id: the least doc_id reachable by links.
    kept: whether it is the row's own (rows that link with nothing are kept).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.keep(sign(docs.select("doc_id", "text"), n), "signed")
    classes = signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("weight"), F.min("sig").alias("sig"))
    classes = scratch.keep(classes, "classes")

    least = threshold - 7 * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5
    groups = scratch.keep(candidate_groups(classes, least, scratch), "groups")
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "label").join(classes.select(F.col("key").alias("node"), "class_id", "weight"), "node").select(F.col("node").alias("key"), F.col("label").alias("grp"), "size", "weight", "class_id")
    members = scratch.keep(members, "members")
    scratch.drop("groups", "hubs", "labels", "more")

    texts = docs.select("doc_id", "text").join(members.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = full_sets(texts, n).groupBy("key").agg(F.first("shingles").alias("shingles"))
    tasks = pair_blocks(members.select("key", "grp", "size", "weight"), "key", "size").drop("size")
    links = scratch.keep(by_group(tasks.join(known, "key"), ["grp", "i", "j"], _verify(threshold), "a binary, b binary, links bigint"), "links")

    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    reach = components(links.select("a", "b"), scratch)
    least = reach.join(classes.select(F.col("key").alias("node"), "class_id"), "node").groupBy("label").agg(F.min("class_id").alias("component_id"))
    linked = reach.join(least, "label").select(F.col("node").alias("key"), "component_id")
    per_class = classes.select("key", "class_id", "weight").join(counts, "key", "left").join(linked, "key", "left")
    per_class = per_class.select("key", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    per_class = scratch.keep(per_class, "per_class")
    scratch.drop("links", "labels", "members", "classes")
    own = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = own.join(per_class, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
