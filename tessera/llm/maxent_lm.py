"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words between blanks, lower-cased, and one end per text.  The vocabulary is every
token with at least 1/`PREDICTED` of all occurrences, the `VOCABULARY` most frequent if there
are more, so it follows the corpus.  Its words are the leaves of a tree of classes with up to
`BRANCHES` children: the commonest two steps below the root, the next ones three and four.
All other tokens share a class of their own below the root and are told apart by their
smoothed counts, so the probabilities of all tokens, with one place for unseen ones, sum to
one.

Each step of a word's path is a softmax over the node's children.  Its features are the node,
and the node with the last word of the vocabulary before (which skips others); at the root
also the one before that (a skip feature) and the two words before together.  Features are
hashed to a table of rows of weights that grows with the corpus: one for each `BIN_TOKENS`
training tokens, as a power of two from `BINS` to `MOST_BINS` (a task holds four copies, 32 MB
each at most).  Weights are trained by distributed gradient updates: in
each of `ROUNDS` rounds every task takes AdaGrad steps over minibatches of its share of the
training tokens, from the weights of the round before; the tasks' changes, weighted by their
tokens, are summed in two levels and applied.  A round uses another share of the documents;
together they use each training document once.  A task takes about `TASK_TOKENS` tokens of a
round where there are enough, so what tasks send stays in proportion to the corpus.  Weights therefore depend, a little, on how
the documents are dealt to tasks; counts and base scores do not.

Counts cover all training tokens.  The table of counts stays distributed: only tokens
with at least 1/`FREQUENT` of all occurrences, so at most 262,144 (5 MB), reach the tasks; all others
meet their counts in a join whose keys are rare by that bound.

Null texts count as empty: one end.  Rows that repeat an id are scored each.  Rows with
null ids count as training rows.  Tokens are known by 64-bit hashes.  Memory of a task
follows the model (4 to 32 MB), not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import by_group
from tessera.llm.nbsvm import held_out
from tessera.llm.textkit import LOWER, SOLID, Scratch, hash_spans, slices, strings, words

#: Tokens of at least this share of all are looked up in the tasks, and those of at least that share are predicted.
FREQUENT, PREDICTED = 1 << 18, 1 << 16
BRANCHES = 16
#: Children of the root that have one, two and three more levels below them; one more is for all other tokens.
SHALLOW, MIDDLE, DEEP = 5, 5, 5
VOCABULARY = SHALLOW * BRANCHES + MIDDLE * BRANCHES**2 + DEEP * BRANCHES**3
BINS, MOST_BINS, BIN_TOKENS = 1 << 16, 1 << 19, 1 << 10
TASK_TOKENS = 8_000_000
ROUNDS, BATCH, RATE = 2, 32768, 0.3
START = 65535
END = np.uint64(0x9D5C8E7A1B3F2461)
PIECE = 1 << 14


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes of a slice of texts, offsets by row), ends included."""
    for first, data, at in slices(strings(column)):
        low = LOWER[data]
        s, e, r = words(low, at, SOLID)
        n = len(at) - 1
        count = np.bincount(r, minlength=n) + 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if n else 0, np.uint64)
        is_end = np.zeros(len(out), bool)
        is_end[ends - 1] = True
        out[is_end] = END
        out[~is_end] = hash_spans(low, s, e)
        yield first, out, np.concatenate(([0], ends))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, n: how often each token occurs in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

        for batch in batches:
            for _, h, _ in tokens(batch.column(0)):
                held.append(h)
                size += len(h)
                if size > 4_000_000:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The frequent tokens, sorted by hash, with counts and ids (0: not in the vocabulary), and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int

    @property
    def mass(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / self.mass)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent, -1 if it is not one."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def lexicon(counts: DataFrame) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    got = counts.where(F.col("n") * FREQUENT >= total).toArrow()  # at most FREQUENT rows
    h, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    ids = np.zeros(len(h), np.uint16)
    top = np.lexsort((h, -n))[: min(VOCABULARY, int((n * PREDICTED >= total).sum()))]
    ids[top] = np.arange(1, len(top) + 1)
    return Lexicon(h, n, ids, int(total), int(distinct))


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, held_out, row (a number of its own), n_tokens, n_frequent, base_known, base_other, ids (uint16), rare (hashes to look up)."""
    fields = "doc_id {}, held_out boolean, row bigint, n_tokens bigint, n_frequent bigint, base_known double, base_other double, ids binary, rare array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = lex.log10(lex.counts)
        for batch in batches:
            for first, h, at in tokens(batch.column(3)):
                part = batch.slice(first, len(at) - 1)
                place = lex.find(h)
                on = place >= 0
                ids = np.where(on, lex.ids[place], 0).astype(np.uint16) if len(lex.ids) else np.zeros(len(h), np.uint16)
                base = np.where(on, logs[place], 0.0) if len(logs) else np.zeros(len(h))
                starts = at[:-1]
                other = np.add.reduceat(np.where(ids == 0, base, 0.0), starts)
                known = np.add.reduceat(np.where(ids > 0, base, 0.0), starts)
                seen = np.add.reduceat(on.astype(np.int64), starts)
                size = np.diff(at)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size - seen))).astype(np.int32)), pa.array(h[~on].view(np.int64)))
                raw = pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size), pa.array(seen), pa.array(known), pa.array(other), raw, rare], ["doc_id", "held_out", "row", "n_tokens", "n_frequent", "base_known", "base_other", "ids", "rare"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, fields.format(docs.schema["doc_id"].dataType.simpleString()))


def tree(words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """depth (steps), nodes and children (id x step) of the ids 0 (all others), 1, 2, ... by falling count; and the number of nodes."""
    depth, node, child = np.ones(words + 1, np.int64), np.zeros((words + 1, 4), np.int64), np.zeros((words + 1, 4), np.int64)
    ids, root, nodes = np.arange(1, words + 1), 1, 1
    for children, levels in ((SHALLOW, 1), (MIDDLE, 2), (DEEP, 3)):
        of, ids = ids[: children * BRANCHES**levels], ids[children * BRANCHES**levels :]
        place = np.arange(len(of))
        depth[of] = levels + 1
        child[of, 0] = root + place // BRANCHES**levels
        for step in range(1, levels + 1):
            node[of, step] = nodes + place // BRANCHES ** (levels - step + 1)
            child[of, step] = place // BRANCHES ** (levels - step) % BRANCHES
            nodes += children * BRANCHES ** (step - 1)
        root += children
    return depth, node, child, nodes


def bins_for(total: int) -> int:
    """Rows of hashed weights for a corpus of that many training tokens."""
    return min(MOST_BINS, max(BINS, 1 << max(0, total // BIN_TOKENS - 1).bit_length()))


def _hash(feature: int, *parts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of the weights (a power of two of them, 2^16 or more) for each combination of parts."""
    h = np.uint32(feature * 0x9E3779B1 & 0xFFFFFFFF)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(33 - bins.bit_length())).astype(np.uint16 if bins == 1 << 16 else np.uint32)


class Model:
    """Weights as one float32 vector with views: a bias for each node's children, and the hashed rows."""

    def __init__(self, word_counts: np.ndarray, other: float, bins: int = BINS) -> None:
        """word_counts: of ids 1, 2, ... by falling count; other: the count of all other tokens; bins: hashed rows."""
        self.words, self.bins = (m := len(word_counts)), bins
        self.depth, self.node, self.child, self.n_nodes = tree(m)
        self.flat = np.zeros((self.n_nodes + bins) * BRANCHES, np.float32)
        counts = np.concatenate(([max(other, 0.5)], np.maximum(word_counts, 0.5)))
        mass = np.zeros(self.n_nodes * BRANCHES)
        for step in range(4):
            on = self.depth > step
            mass += np.bincount(self.node[on, step] * BRANCHES + self.child[on, step], weights=counts[on], minlength=len(mass))
        mass = mass.reshape(-1, BRANCHES)
        share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
        self.views()[0][:] = np.where(share > 0, np.log(np.maximum(share, 1e-26)), -60)

    def views(self, flat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        flat = self.flat if flat is None else flat
        cut = self.n_nodes * BRANCHES
        return flat[:cut].reshape(-1, BRANCHES), flat[cut:].reshape(-1, BRANCHES)

    @staticmethod
    def contexts(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the last id of the vocabulary before it, the one before that, and the two ids before it as one number."""
        n = len(ids)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        begin = at[row]
        spot = np.where(ids > 0, np.arange(n), -1)
        last = np.concatenate(([-1], np.maximum.accumulate(spot)[:-1])) if n else spot
        one = np.where(last >= begin, ids[last], START).astype(np.uint32)
        second = last[np.maximum(last, 0)]
        two = np.where((last >= begin) & (second >= begin), ids[second], START).astype(np.uint32)
        place = np.arange(n)
        p1 = np.where(place - 1 >= begin, ids[np.maximum(place - 1, 0)], START).astype(np.uint32)
        p2 = np.where(place - 2 >= begin, ids[np.maximum(place - 2, 0)], START).astype(np.uint32)
        return one, two, (p1 << np.uint32(16)) | p2

    def step(self, ids, one, two, pair, views, grad=None, touched: list | None = None) -> np.ndarray:
        """Natural log probability of each token's path; adds the gradient of their sum to grad, and the rows of both its views that it changed to touched."""
        bias, weights = views
        n, depth = len(ids), self.depth[ids]
        of, node, child = [np.arange(n)], [np.zeros(n, np.int64)], [self.child[ids, 0]]
        for step in range(1, 4):
            on = np.flatnonzero(depth > step)
            of.append(on), node.append(self.node[ids[on], step]), child.append(self.child[ids[on], step])
        of, node, child = np.concatenate(of), np.concatenate(node), np.concatenate(child)
        near, skip, both = _hash(1, node, one[of], bins=self.bins), _hash(2, two, bins=self.bins), _hash(3, pair, bins=self.bins)
        z = weights.take(near, axis=0)
        z += bias.take(node, axis=0)
        z[:n] += weights.take(skip, axis=0)
        z[:n] += weights.take(both, axis=0)
        np.clip(z, -80, 80, out=z)
        every = np.arange(len(of))
        chosen = z[every, child]
        np.exp(z, out=z)
        total = z @ np.ones(BRANCHES, np.float32)
        out = np.bincount(of, weights=chosen - np.log(total), minlength=n)
        if grad is not None:
            z *= (-1 / total)[:, None]
            z[every, child] += 1
            nodes = _scatter(grad[0], node.astype(np.uint16), z, every)
            rows = _scatter(grad[1], np.concatenate((near, skip, both)), z, np.concatenate((every, every[:n], every[:n])))
            if touched is not None:
                touched += [nodes, rows]
        return out


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order by key, by radix: half of a wide key at a time."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    return order if key.itemsize == 2 else order.take(np.argsort((key >> np.uint32(16)).astype(np.uint16).take(order), kind="stable"))


def _scatter(table: np.ndarray, key: np.ndarray, g: np.ndarray, of: np.ndarray) -> np.ndarray:
    """table[key] += g[of], with repeated keys; the rows that it changed."""
    if not len(key):
        return key
    order = _order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    table[key[first]] += np.add.reduceat(g.take(of.take(order), axis=0), first, axis=0)
    return key[first]


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, offsets) of runs of documents with about four minibatches of tokens."""
    parts = column.to_pylist()
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j]) <= 8 * BATCH):
            size += len(parts[j])
            j += 1
        at = np.concatenate(([0], np.cumsum([len(p) // 2 for p in parts[i:j]])))
        yield i, np.frombuffer(b"".join(parts[i:j]), np.uint16), at
        i = j


def train_round(encoded: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """The mean change of the weights by the steps of that many tasks at most over encoded (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = model.flat.copy()
        squares, grad = np.ones_like(flat), np.zeros_like(flat)
        views, grads, sums, seen = model.views(flat), model.views(grad), model.views(squares), 0
        for batch in batches:
            for _, ids, at in _documents(batch.column(0)):
                one, two, pair = model.contexts(ids, at)
                for lo in range(0, len(ids), BATCH):
                    part = slice(lo, lo + BATCH)
                    touched: list[np.ndarray] = []
                    model.step(ids[part], one[part], two[part], pair[part], views, grads, touched)
                    for weights, slopes, total, rows in zip(views, grads, sums, touched):
                        g = slopes.take(rows, axis=0)
                        square = total.take(rows, axis=0) + g * g
                        total[rows] = square
                        weights[rows] += RATE * g / np.sqrt(square)
                        slopes[rows] = 0
                seen += len(ids)
        if seen:
            change = (flat - model.flat).astype(np.float16)  # what a task learns needs no more digits
            pieces = [change[i : i + PIECE].tobytes() for i in range(0, len(change), PIECE)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, seen, np.int64)), pa.array(pieces, pa.binary())], ["piece", "seen", "change"])

    def mean(rows: pa.Table) -> pa.RecordBatch:
        seen = rows["seen"].to_pylist()
        both = sum(np.frombuffer(b, np.float16).astype(float) * n for b, n in zip(rows["change"].to_pylist(), seen)) / sum(seen)
        return pa.RecordBatch.from_arrays([rows["piece"].combine_chunks()[:1], pa.array([sum(seen)], pa.int64()), pa.array([both.astype(np.float16).tobytes()], pa.binary())], ["piece", "seen", "change"])

    kind = "piece int, seen bigint, change binary"
    changes = encoded.select("ids").coalesce(tasks).mapInArrow(run, kind).withColumn("part", F.spark_partition_id() % 64)
    sums = by_group(changes, ["piece", "part"], mean, kind)
    got = by_group(sums, ["piece"], mean, kind).toArrow().sort_by("piece")  # the size of the model
    if not got.num_rows:
        return np.zeros_like(model.flat)
    return np.concatenate([np.frombuffer(b, np.float16) for b in got["change"].to_pylist()]).astype(np.float32)


def fit(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    top = np.argsort(np.where(lex.ids > 0, lex.ids, 1 << 20))[: int((lex.ids > 0).sum())]
    counts = lex.counts[top].astype(float)
    model = Model(counts, float(lex.total - counts.sum()), bins_for(lex.total))
    tasks = max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-lex.total // (rounds * TASK_TOKENS)))
    known = encoded.where("not held_out")
    for r in range(rounds):
        model.flat = model.flat + train_round(known.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r), model, tasks)
    return model


def context_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded without ids and rare, with context (the sum of natural logs) and n_other (tokens outside the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = model.views()
        for batch in batches:
            sums, others = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, ids, at in _documents(batch.column("ids")):
                one, two, pair = model.contexts(ids, at)
                logs = np.concatenate([model.step(ids[lo : lo + BATCH], one[lo : lo + BATCH], two[lo : lo + BATCH], pair[lo : lo + BATCH], views) for lo in range(0, len(ids), BATCH)])
                sums[first : first + len(at) - 1] = np.add.reduceat(logs.astype(float), at[:-1])
                others[first : first + len(at) - 1] = np.add.reduceat((ids == 0).astype(np.int64), at[:-1])
            keep = [batch.column(i) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums), pa.array(others)], [*batch.schema.names[:7], "context", "n_other"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.drop("rare").mapInArrow(run, f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, n_frequent bigint, base_known double, base_other double, context double, n_other bigint")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(count_tokens(docs.where(~held_out(F.col("doc_id"), 10, 0))), "counts")
    lex = lexicon(counts)
    encoded = scratch.keep(encode(docs, lex), "encoded")
    model = fit(encoded, lex)
    vocabulary = lex.counts[lex.ids > 0]
    other_mass = lex.total - int(vocabulary.sum()) + 0.1 * (lex.distinct - len(vocabulary) + 1)
    shift = float(np.log10(lex.mass / other_mass))

    rare = encoded.select("row", F.explode("rare").alias("token"))
    looked = rare.join(counts.where(F.col("n") * FREQUENT < lex.total), "token", "left")
    n = F.coalesce("n", F.lit(0))
    rare_sums = looked.groupBy("row").agg(F.sum(F.log10((n + 0.1) / lex.mass)).alias("base_rare"), F.sum((n > 0).cast("long")).alias("known_rare"))
    out = context_scores(encoded, model).join(rare_sums, "row", "left")
    base_rare, known_rare = F.coalesce("base_rare", F.lit(0.0)), F.coalesce("known_rare", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + known_rare).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base_known") + F.col("base_other") + base_rare).alias("base_score"),
        (F.col("context") / float(np.log(10)) + F.col("base_other") + base_rare + F.col("n_other") * shift).alias("score"),
    )
