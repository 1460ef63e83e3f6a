"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Equal vectors are one class; classes are linked, copies are not expanded.  A rotation is
learned on a bounded sample so that the signs of the rotated, projected vectors are
balanced bits near the vectors themselves; further codes come from independent random
rotations of the same projection.  Every class is indexed: each of its codes is cut into
disjoint substrings, and each substring is a table.  Classes that share a substring meet
in a bucket, of which only their names and then their codes are shuffled; there, pairs
within a Hamming radius over all codes are found.  Only classes that have such a pair
bring their vectors, to be reranked by the cosine in double precision.

Rotations are added until pairs planted around the sample just at the threshold,
coded as the vectors are, share a substring with probability `recall` (see `plan`); the
length of the substrings is that of the least work, down to no bits at all, where all
pairs meet.  Buckets are worked on in blocks (see blocks.py): a pair is counted in the
first table in which it meets, no pair becomes a row, and no task holds a whole hot bucket.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing.  Vectors of each length are compared among themselves, since a cosine needs equal
lengths.  Every row is a vector of its own, whether its id repeats or not; rows with null
ids link with nothing.  Ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import by_group, labels_of, pair_blocks, settle
from tessera.llm.graph import components
from tessera.llm.textkit import Scratch

SAMPLE_ROWS = 4000
RECALL = 0.98
MOST_TABLES = 4096


def projection_of(sample: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The directions (dim x bits) of most variance around mean; bits: the dimension, 64 at most."""
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, : min(64, x.shape[1])]


def random_rotation(bits: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]


def itq(v: np.ndarray, rounds: int = 30, seed: int = 11) -> np.ndarray:
    """Rotation of the projected sample v whose signs are the code."""
    r = random_rotation(v.shape[1], seed)
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return r


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    on = ((x - mean) @ projection) >= 0
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bits_for(n: int, width: int) -> int:
    """Most bits of a substring: buckets of about 16 vectors if codes were uniform; a table's key has 31."""
    return min(width, math.ceil(math.log2(max(n, 2) / 16)) if n > 16 else 0, 31)


def planted(unit: np.ndarray, cosine: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (unit, partner) at the cosine: partners in any direction, and in directions in which the sample itself differs."""
    rng, out = np.random.default_rng(seed), []
    for step in (rng.normal(size=unit.shape), unit[rng.permutation(len(unit))] - unit[rng.permutation(len(unit))]):
        step = step - (step * unit).sum(axis=1)[:, None] * unit
        size = np.linalg.norm(step, axis=1)
        ok = size > 1e-9
        if ok.any():
            out.append((unit[ok], cosine * unit[ok] + math.sqrt(1 - cosine * cosine) * step[ok] / size[ok][:, None]))
    return out


def _share(apart: np.ndarray, width: int, bits: int) -> float:
    """Mean chance that codes with so many bits apart agree in a substring."""
    i = np.arange(bits)
    return float((np.maximum(width - apart[:, None] - i, 0) / (width - i)).prod(axis=1).mean())


@dataclass
class Plan:
    """mean; the projections of each code; (code, bit positions) of each table, by code; the Hamming radius over all codes."""

    mean: np.ndarray
    projections: list[np.ndarray]
    tables: list[tuple[int, np.ndarray]]
    radius: int


def plan(unit: np.ndarray, n: int, threshold: float, recall: float) -> Plan:
    """The tables for n vectors like the sample unit.

    Codes around the mean or around zero, and the bits of a substring, are chosen for the
    least work by the sample's own distances: entries, and pairs within buckets.  Where no
    number of tables up to `MOST_TABLES` is enough, substrings get shorter.
    """
    pairs = planted(unit, threshold)
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, len(unit), (2, 100_000))
    left, right = left[left != right], right[left != right]
    ways = []
    for mean in (unit.mean(axis=0), np.zeros(unit.shape[1])):
        base = projection_of(unit, mean)
        width = base.shape[1]
        first = base @ itq((unit - mean) @ base)
        code = encode(unit, mean, first)
        apart = [np.bitwise_count(encode(x, mean, first) ^ encode(y, mean, first)).astype(int) for x, y in pairs]
        chance = np.bitwise_count(code[left] ^ code[right]).astype(int) if len(left) else np.zeros(1, int)
        for bits in range(bits_for(n, width) + 1):
            share = min([_share(a, width, bits) for a in apart], default=1.0)
            want = max(1.0, math.log(1 - recall) / math.log1p(-min(share, 1 - 1e-9))) if share > 0 else math.inf
            ways.append((want * (1 + n * _share(chance, width, bits) / 64), bits, mean, base, first))
    for _, bits, mean, base, first in sorted(ways, key=lambda w: w[:2]):
        if made := _tables(pairs, bits, mean, base, first, recall, rng):
            return made
    raise AssertionError("a table of no bits holds all pairs")


def _tables(pairs, bits: int, mean: np.ndarray, base: np.ndarray, first: np.ndarray, recall: float, rng) -> Plan | None:
    width, projections, cut, apart = base.shape[1], [], [], []
    lost = [np.ones(len(x), bool) for x, _ in pairs]
    while not cut or any(1 - m.mean() < recall for m in lost):
        if len(cut) > MOST_TABLES:
            return None
        k = len(projections)
        projections.append(first if k == 0 else base @ random_rotation(width, 100 + k))
        order = rng.permutation(width)
        apart.append([encode(x, mean, projections[k]) ^ encode(y, mean, projections[k]) for x, y in pairs])
        for i in range(0, width - bits + 1, bits or width + 1):
            cut.append((k, order[i : i + bits]))
            mask = mask_of(cut[-1][1])
            for m, c in zip(lost, apart[k]):
                m &= (c & mask) != 0
            if all(1 - m.mean() >= recall for m in lost):
                break
    # well beyond all planted pairs: the cosine decides, the radius only spares work
    total = [np.sum([np.bitwise_count(a[i]).astype(int) for a in apart], axis=0) for i in range(len(pairs))]
    radius = max((max(math.ceil(t.mean() + 6 * t.std()), int(t.max()) + 2) for t in total), default=width)
    return Plan(mean, projections, cut, min(radius, width * len(projections)))


def mask_of(positions: np.ndarray) -> np.uint64:
    return np.uint64(sum(1 << int(b) for b in positions))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _entries(classes: DataFrame, dim: int, how: Plan) -> tuple[DataFrame, DataFrame]:
    """(key, bucket) for each table, and (key, codes)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                unit = _unit(_matrix(part.column(1), dim))
                code = np.column_stack([encode(unit, how.mean, p) for p in how.projections])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["key", "codes"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            for t, (k, sub) in enumerate(how.tables):
                key = np.zeros(len(code), np.int64)
                for b in sub:
                    key = (key << 1) | ((code[:, k] >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key | (t << 32))], ["key", "bucket"])

    codes = classes.select("key", "embedding").mapInArrow(coded, "key binary, codes binary")
    return codes, lambda kept: kept.mapInArrow(dealt, "key binary, bucket bigint")


def _met(rows: pa.Table, how: Plan, masks: list[tuple[int, np.uint64]]) -> np.ndarray:
    """Which rows of a bucket's two blocks are within the radius and met in no earlier table."""
    width = len(how.projections)
    code = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint64).reshape(-1, width)
    far = np.zeros((len(code), len(code)), np.uint16)
    for k in range(width):
        far += np.bitwise_count(code[:, None, k] ^ code[None, :, k])
    linked, of = far <= how.radius, -1
    for k, mask in masks[: rows["bucket"][0].as_py() >> 32]:
        if k != of:
            apart, of = code[:, None, k] ^ code[None, :, k], k
        linked &= (apart & mask) != 0
    return settle(linked, rows["own"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py())


def _near(how: Plan):
    """The rows of a block pair that are near some other, without vectors."""
    masks = [(k, mask_of(sub)) for k, sub in how.tables]

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        on = np.flatnonzero(_met(rows, how, masks).any(axis=1))
        return rows.take(pa.array(on)).combine_chunks().to_batches()[0] if len(on) else None

    return run


def _verify(threshold: float, how: Plan, dim: int):
    masks = [(k, mask_of(sub)) for k, sub in how.tables]

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        linked = _met(rows, how, masks)
        unit = _unit(_matrix(rows["embedding"], dim))
        linked &= unit @ unit.T >= threshold
        on = np.flatnonzero(linked.any(axis=1))
        if not len(on):
            return None
        key = rows["key"].combine_chunks()
        links = linked.astype(np.int64) @ rows["weight"].to_numpy()
        return pa.RecordBatch.from_arrays([key.take(pa.array(on)), key.take(pa.array(labels_of(linked)[on])), pa.array(links[on], pa.int64())], ["a", "b", "links"])

    return run


def _links(classes: DataFrame, dim: int, n: int, threshold: float, sample_rows: int, recall: float, scratch: Scratch) -> DataFrame | None:
    """a, b, links: for classes of one length, each row's links to others in a block pair, and the least that it reaches there."""
    sample = classes.select("embedding").orderBy("key").limit(sample_rows).toArrow()  # bounded by sample_rows; keys are hashes
    how = plan(_unit(_matrix(sample["embedding"], dim)), n, threshold, recall)
    codes, deal = _entries(classes, dim, how)
    codes = scratch.keep(codes, "codes")
    entries = scratch.keep(deal(codes), "entries")
    alike = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")]
    full = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("first"), *alike).where("size > 1")
    # buckets with the same members: one is enough, the first, in which their pairs meet unless they met before
    full = scratch.keep(full.groupBy("size", "first", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "full")
    tasks = pair_blocks(entries.join(full, "bucket"), "key", "size").drop("size")
    kind = "key binary, bucket bigint, own int, i int, j int, codes binary"
    near = scratch.keep(by_group(tasks.join(codes, "key").select("key", "bucket", "own", "i", "j", "codes"), ["bucket", "i", "j"], _near(how), kind), "near")
    scratch.drop("codes", "entries", "full")
    asked = near.join(classes.select("key", "embedding", "weight"), "key")
    links = scratch.keep(by_group(asked, ["bucket", "i", "j"], _verify(threshold, how, dim), "a binary, b binary, links bigint"), f"links{dim}")
    scratch.drop("near")
    return links


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession)
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    key = F.when(usable, F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), x)), 16, "0"))))
    own = vectors.select("vec_id", x, key.alias("key"))
    classes = own.where("key is not null").groupBy("key").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("class_id"), F.count("*").alias("weight"))
    classes = scratch.keep(classes, "classes")
    links = None
    for dim, n in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # as many as lengths
        if n > 1:
            got = _links(classes.where(F.size("embedding") == dim), dim, n, threshold, sample_rows, recall, scratch)
            links = got if links is None else links.unionByName(got)
    found = classes.select("key", "class_id", "weight")
    if links is None:
        found = found.select("key", (F.col("weight") - 1).alias("n_links"), F.col("class_id").alias("component_id"))
    else:
        counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
        reach = components(links.select("a", "b"), scratch).join(classes.select(F.col("key").alias("node"), "class_id"), "node")
        least = reach.groupBy("label").agg(F.min("class_id").alias("component_id"))
        linked = reach.join(least, "label").select(F.col("node").alias("key"), "component_id")
        found = found.join(counts, "key", "left").join(linked, "key", "left")
        found = found.select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    found = scratch.keep(found, "found")
    scratch.drop(*[name for name in scratch.paths if name != "found"])
    out = own.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
