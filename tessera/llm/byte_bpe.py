"""Byte-level BPE over length-bucketed, padded numpy matrices.

Every distinct piece of a batch is one row of a matrix of its length bucket.
Each round merges, in every row at once, the leftmost pair of the least rank;
ranks of pairs come from an open-addressing hash table, and the merged cell is
closed by compaction.  A row leaves the matrix when no pair of it has a rank.

Nulls and empty texts have no tokens.  Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import buffer_of, strings

#: Pieces of more bytes are merged with a heap: a matrix row costs the square of its length.
LONG_PIECE = 1024
#: Distinct pieces that a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED = 120_000
NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> rank by linear probing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        left, step = np.arange(len(keys)), 0
        home = self.home(keys)
        while len(left):
            slot = (home[left] + step) & self.mask
            free = self.keys[slot] < 0
            at, who = np.unique(slot[free], return_index=True)
            won = left[free][who]
            self.keys[at], self.ranks[at] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            step += 1
        self.steps = step

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO_RANK where there is none or where either side is padding (negative)."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 20) | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NO_RANK, np.int32)
        open_ = np.flatnonzero(keys >= 0)
        slot = self.home(keys[open_])
        for _ in range(self.steps):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            open_, slot = open_[on], (slot[on] + 1) & self.mask
            if not len(open_):
                break
        return out.reshape(shape)


def gather(which: np.ndarray, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of table[starts[i] : starts[i] + sizes[i]] for i of which."""
    size = sizes[which]
    begin = np.cumsum(size) - size
    return table[np.arange(int(size.sum())) + np.repeat(starts[which] - begin, size)]


def _strung(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable((np.array(left, np.int64) << 20) | np.array(right, np.int64), np.array(rank, np.int32))
        self.known: dict[str, bytes] = {}
        self.bytes_of = _strung(self.vocab)
        self.decimals = _strung([b"%d " % i for i in range(len(self.vocab))])

    def merge_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of like length, one after the other, and how many each piece has."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rows, flat, count = [], [], np.zeros(len(pieces), np.int64)
        row = np.arange(len(pieces))
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            best = rank[every, at]
            done = best == NO_RANK
            if done.any():
                cells = ids[done]
                inside = cells >= 0
                rows.append(row[done]), flat.append(cells[inside])
                count[row[done]] = inside.sum(axis=1)
                on = ~done
                row, ids, rank, at, best = row[on], ids[on], rank[on], at[on], best[on]
                if not len(row):
                    break
                width = max(2, int((ids >= 0).sum(axis=1).max()) + 1)
                ids, rank, every = ids[:, :width], rank[:, : width - 1], np.arange(len(row))
            ids[every, at] = best
            cells = np.arange(ids.shape[1] - 1)
            ids[:, :-1] = np.take_along_axis(ids, cells + (cells > at[:, None]), axis=1)
            ids[:, -1] = -1
            cells = cells[:-1]
            rank[:, :-1] = np.take_along_axis(rank, cells + (cells >= at[:, None]), axis=1)
            rank[:, -1] = NO_RANK
            rank[every, at] = self.pairs.get(ids[every, at], ids[every, at + 1])
            on = at > 0
            rank[every[on], at[on] - 1] = self.pairs.get(ids[every[on], at[on] - 1], ids[every[on], at[on]])
        return _in_order(rows, flat, count), count

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r != NO_RANK]
        current = [*first, NO_RANK]
        heapq.heapify(heap)

        def renew(i: int) -> None:
            j = after[i]
            current[i] = self.ranks.get(self.vocab[ids[i]] + self.vocab[ids[j]], NO_RANK) if j >= 0 else NO_RANK
            if current[i] != NO_RANK:
                heapq.heappush(heap, (current[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r or ids[i] < 0:
                continue
            j = after[i]
            ids[i], ids[j], current[j] = r, -1, NO_RANK
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each piece has."""
        rows, flat, count = [], [], np.zeros(len(pieces), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        for power in np.unique(np.frexp(np.maximum(size - 1, 0))[1][size <= LONG_PIECE]).tolist():
            of = np.flatnonzero((np.frexp(np.maximum(size - 1, 0))[1] == power) & (size <= LONG_PIECE))
            step = max(1, (1 << 18) >> power)
            for i in range(0, len(of), step):
                part = of[i : i + step]
                ids, n = self.merge_matrix([pieces[k] for k in part.tolist()])
                count[part] = n
                rows.append(part), flat.append(ids)
        for k in np.flatnonzero(size > LONG_PIECE).tolist():
            ids = self.merge_long(pieces[k])
            count[k] = len(ids)
            rows.append(np.array([k])), flat.append(ids)
        return _in_order(rows, flat, count), count

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(ids, *self.bytes_of).tobytes()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and how many each text has."""
        found = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [*set(chain.from_iterable(found)).difference(known)]
        if new:
            flat, count = self.encode_pieces([p.encode() for p in new])
            raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(count)).tolist()
            known.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        parts = [b"".join([known[p] for p in pieces]) for pieces in found]
        return np.frombuffer(b"".join(parts), "<i4"), np.array([len(p) // 4 for p in parts], np.int64)

    def digests(self, texts: list[str]):
        """(ids, their decimals joined by blanks, the bytes that they decode to) of each text."""
        ids, count = self.ids(texts)
        told, back = gather(ids, *self.decimals).tobytes(), self.decode(ids)
        ends, told_ends, back_ends = np.cumsum(count), np.cumsum(self.decimals[2][ids]), np.cumsum(self.bytes_of[2][ids])
        at, told_at, back_at = 0, 0, 0
        for end in ends.tolist():
            told_end, back_end = (int(told_ends[end - 1]), int(back_ends[end - 1])) if end else (0, 0)
            yield ids[at:end], told[told_at : max(told_at, told_end - 1)], back[back_at:back_end]
            at, told_at, back_at = end, told_end, back_end


def _in_order(rows: list[np.ndarray], flat: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    """The ids of each row, given group by group, in the order of rows."""
    if not rows:
        return np.zeros(0, np.int32)
    row = np.concatenate(rows)
    starts = np.empty(len(count), np.int64)
    starts[row] = np.cumsum(count[row]) - count[row]
    return gather(np.arange(len(count)), np.concatenate(flat), starts, count)


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _runs(texts: pa.Array, most: int = 1 << 19):
    """Lists of texts of about that many bytes: a whole batch is never a list of Python objects."""
    texts = strings(texts)
    _, at = buffer_of(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield texts.slice(i, j - i).to_pylist()
        i = j


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """array<int> of (ids, ids of each row) parts."""
    sizes = np.concatenate([np.zeros(1, np.int64), *[count for _, count in parts]])
    flat = np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in parts]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """array<int> of token ids; empty for null and empty texts."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path, pattern)
        return _lists([bpe.ids(run) for run in _runs(column)])

    return ids_of.asNondeterministic()(text)  # so that several uses of the ids share one encoding


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """binary: the bytes that the ids stand for; empty for null."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path, pattern)
        return pa.array([bpe.decode(row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)) for row in column], pa.binary())

    return bytes_of(ids)


def encode_checked(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """struct<ids array<int>, decoded_sha256 string>: encode() and the digest of decode() in one Python worker."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    @F.arrow_udf("struct<ids: array<int>, decoded_sha256: string>")
    def both(column: pa.Array) -> pa.Array:
        bpe, parts, back = tokenizer(path, pattern), [], []
        for run in _runs(column):
            ids, count = bpe.ids(run)
            decoded, ends = bpe.decode(ids), np.cumsum(np.concatenate(([0], bpe.bytes_of[2][ids])))[np.concatenate(([0], np.cumsum(count)))].tolist()
            back += [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
            parts.append((ids, count))
        return pa.StructArray.from_arrays([_lists(parts), pa.array(back, pa.string())], ["ids", "decoded_sha256"])

    return both.asNondeterministic()(text)  # so that several uses share one encoding


def round_trip(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>: encodes, then decodes the ids."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(column: pa.Array) -> pa.Array:
        bpe, n, ids, back = tokenizer(path, pattern), [], [], []
        for run in _runs(column):
            for own, told, decoded in bpe.digests(run):
                n.append(len(own))
                ids.append(hashlib.sha256(told).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text)."""
    got = docs.select("doc_id", round_trip(F.col("text"), path, pattern).alias("got"))
    return got.select("doc_id", "got.*")
