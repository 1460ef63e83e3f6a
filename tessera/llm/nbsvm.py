"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (byte trigrams, words, word pairs, and runs of one
to four word shapes) are scaled by the log ratio of their class counts; a linear
model with hinge loss is then fitted by dual coordinate descent.

The fit uses at most `max_rows` labelled rows, those with the least hash of
their doc_id, and of these as many as have `MAX_BYTES` of indicators together; scoring covers every text in full, row by row, without a shuffle.
Null and empty texts have no indicators and get the score of the bias.  Without
rows of both labels the model is the constant 0.5.  Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textkit import ALNUM, LOWER, SLICE_BYTES, SOLID, Scratch, buffer_of, hash_spans, mix, slices, strings, words

BITS = 18
MAX_ROWS = 6000
MAX_BYTES = 256 << 20


def _fold(h: np.ndarray, bits: int, base: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) + base


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A symbol for each word: kinds of its first and last byte, whether the one before the last is upper case, whether it repeats the word before."""
    kind = np.zeros(256, np.uint64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    for i, b in enumerate(b".,;:!?-_'\"()[]{}|#$%&*+/<=>@~^`\\"):
        kind[b] = 5 + i
    same = np.zeros(len(starts), np.uint64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    before = kind[data[np.maximum(ends - 2, starts)]]
    return kind[data[starts]] * np.uint64(6400) + kind[data[ends - 1]] * np.uint64(80) + before * np.uint64(2) + same


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of all n-grams, with repeats."""
    bins, of = [], []
    if len(data) >= 3:
        d = data.astype(np.uint64)
        h = mix((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:])
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        keep = row[:-2] == row[2:]
        bins.append(_fold(h[keep], 16, 0)), of.append(row[:-2][keep])
    s, e, r = words(data, at, SOLID)
    if len(s):
        h = hash_spans(data, s, e)
        shape = _shapes(data, s, e, r, h)
        for n in range(1, 5):
            if len(s) >= n:
                keep = r[: len(s) - n + 1] == r[n - 1 :]
                g = np.full(len(s) - n + 1, n, np.uint64)
                for j in range(n):
                    g = g * np.uint64(1_000_003) + shape[j : len(s) - n + 1 + j]
                bins.append(_fold(mix(g[keep]), 15, 1 << 16)), of.append(r[: len(s) - n + 1][keep])
    low = LOWER[data]
    s, e, r = words(low, at, ALNUM)
    if len(s):
        h = hash_spans(low, s, e)
        bins.append(_fold(h, 16, 3 << 15)), of.append(r)
        keep = r[:-1] == r[1:]
        bins.append(_fold(mix(h[:-1] * np.uint64(31) + h[1:])[keep], 16, (3 << 15) + (1 << 16))), of.append(r[:-1][keep])
    if not bins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bins), np.concatenate(of)


def _by_row(column: pa.Array):
    """The distinct bins of each text, in order."""
    seen = np.zeros(1 << BITS, bool)
    for _, data, at in slices(strings(column), SLICE_BYTES // 2):
        bins, of = features(data, at)
        order = np.argsort(of, kind="stable")
        bins, ends = bins[order], np.searchsorted(of[order], np.arange(len(at)))
        for i in range(len(at) - 1):
            got = bins[ends[i] : ends[i + 1]]
            seen[got] = True
            yield got, seen
            seen[got] = False


def indicators(text: Column) -> Column:
    """binary: the distinct bins of a text as little-endian int32."""

    @F.arrow_udf("binary")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([np.flatnonzero(seen).astype("<i4").tobytes() for _, seen in _by_row(column)], pa.binary())

    return found(text)


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times weight, for each bin
    squares: np.ndarray  # squared ratios, for a text's norm
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for got, seen in _by_row(column):
            on = seen.view(np.uint8).astype(np.float32) if len(got) > 4096 else None
            if on is None:
                got = np.unique(got)
                total, norm = float(self.weights[got].sum()), float(self.squares[got].sum())
            else:
                total, norm = float(on @ self.weights), float(on @ self.squares)
            out.append(total / max(norm, 1e-12) ** 0.5 + self.bias)
        margin = np.clip(np.array(out, float), -30, 30)
        return 1 / (1 + np.exp(-2 * margin))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, costs: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum of costs * max(0, 1 - y (w x + b)) over its dual; x has values[bins], scaled to length one, and a constant for the bias."""
    w, bias, a = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    squares = np.array([(values[r] ** 2).sum() for r in rows])
    scale = 1 / np.maximum(np.sqrt(squares), 1e-6)  # rows are scaled as they are read: no second copy of them is held
    q = squares * scale * scale + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = values[rows[i]] * scale[i]
            gap = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(a[i] - gap / q[i], 0.0), costs[i])
            step = (new - a[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, smooth: float = 1.0) -> Model:
    n = 1 << BITS
    y = np.where(np.asarray(labels) == 1, 1, -1)
    if not len(y) or (y == y[0]).all():
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0)
    p, q = np.full(n, smooth), np.full(n, smooth)
    for r, sign in zip(rows, y):
        (p if sign > 0 else q)[r] += 1
    ratio = np.log(p / ((y > 0).sum() + 2 * smooth)) - np.log(q / ((y < 0).sum() + 2 * smooth))
    ratio[(p + q) <= 2 * smooth + 1] = 0  # seen once: no evidence
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w, bias = dual_coordinate_descent(rows, ratio, y, cost * share)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """docs (doc_id, text), labels (doc_id, label); null ids, texts and labels are not learned from.

    Only doc ids of a bounded sample are broadcast (max_rows * 12 bytes), and only max_bytes of their indicators reach the driver.
    """
    sample = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    scratch = Scratch(docs.sparkSession)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", indicators(F.col("text")).alias("bins"), "label")
    found = scratch.keep(found, "indicators")
    sizes = found.select("doc_id", F.octet_length("bins").cast("long").alias("size")).groupBy("doc_id").agg(F.sum("size").alias("size"))  # at most max_rows rows
    if (sizes.select(F.sum("size")).first()[0] or 0) > max_bytes:
        running = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        found = found.join(F.broadcast(sizes.withColumn("upto", running).where(F.col("upto") <= max_bytes).select("doc_id")), "doc_id")
    got = found.orderBy("doc_id", "bins").toArrow()
    scratch.drop()
    data, at = buffer_of(got["bins"].combine_chunks())
    labels_ = got["label"].to_numpy()
    del got
    return fit([data[a:b].view("<i4") for a, b in zip(at, at[1:])], labels_)


def score(text: Column, model: Model) -> Column:
    """double from 0 to 1: how likely label 1 is."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    return scored(text)


def held_out(doc_id: Column, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == remainder, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, learned from the rows that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id"), 3, 1))
    model = train(docs, known, max_rows)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
