"""Substring deduplication: content-defined chunks cut by a gear rolling hash.

A cut follows a byte where the gear hash of the last 32 bytes has its upper bits
zero, so cuts move with the text and an insertion disturbs only the chunks that it
touches.  Where none comes within `MOST` bytes, as in text that repeats a word or two,
the cut follows the least hash in the latter half of them.  Chunks hold `LEAST` to `MOST`
bytes, 35 or so on average.  Digests are 96 bits.  A chunk is a repeat if a document with a smaller doc_id has it, or it comes
earlier in its own; runs of repeats of at least `RUN` bytes, or a whole text of
repeats, are removed, and the first owner keeps them.  Shorter runs, as common
phrases make, stay.

Cuts fall between characters.  Null texts count as empty.  Rows that share an id do
not see each other's chunks; rows with a null id see only their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import earlier_owners
from tessera.llm.textkit import Scratch, hash_spans, mix, slices, strings

LEAST, MOST, RUN = 8, 96, 64
#: One byte in 2^5 ends a chunk.
CUT_BITS = 5
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + GEAR[byte] modulo 2^32 after each byte, by doubling the span."""
    h = _GEAR[data]
    span = 1
    while span < 32 and span < len(h):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks in order, and their rows."""
    h = gear(data)
    ok = (h >> np.uint32(32 - CUT_BITS)) == 0
    inside = (data[1:] & 0xC0) == 0x80  # a character goes on after the byte
    ok[:-1] &= ~inside
    h[:-1][inside] = np.uint32(0xFFFFFFFF)
    cand = np.flatnonzero(ok) + 1
    begin = at[np.searchsorted(at, cand - 1, side="right") - 1]
    cand = cand[cand - begin >= 32].tolist()
    out: list[int] = []
    k, n = 0, len(cand)
    for lo, hi in zip(at.tolist(), at[1:].tolist()):
        last = lo
        while last < hi:
            while k < n and cand[k] - last < LEAST:
                k += 1
            end = cand[k] if k < n and cand[k] < hi else hi
            if end - last > MOST:
                end = last + MOST // 2 + int(h[last + MOST // 2 - 1 : last + MOST].argmin())
            out.append(end)
            last = end
    ends = np.array(out, np.int64)
    return ends, np.searchsorted(at, ends - 1, side="right") - 1


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of two unlike hashes of each chunk."""
    a = hash_spans(data, starts, ends)
    twisted = (data ^ np.uint8(0xA5)) * np.uint8(167)
    b = hash_spans(twisted, starts, ends)
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2: the distinct chunks of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(strings(batch.column(1))):
                if not len(data):
                    continue
                ends, rows = cuts(data, at)
                starts = np.concatenate(([0], ends[:-1]))
                a, b = digests(data, starts, ends)
                order = np.lexsort((b, a, rows))
                rows, a, b = rows[order], a[order], b[order]
                new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[new] + first)), pa.array(a[new]), pa.array(b[new])], ["doc_id", "d1", "d2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, d1 bigint, d2 int")


def _strip(text: str, d1: list[int], d2: list[int], owners: list[int], least_run: int) -> tuple[str, int, int, int, list[int]]:
    """What stays of a text, its chunks, repeated chunks, removed bytes, and the owners of what is removed."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return text, 0, 0, 0, []
    ends, _ = cuts(data, np.array([0, len(data)]))
    starts = np.concatenate(([0], ends[:-1]))
    a, b = digests(data, starts, ends)
    owner_of = dict(zip(zip(d1, d2), owners))
    seen: set[tuple[int, int]] = set()
    repeat, owner = np.zeros(len(a), bool), []
    for i, key in enumerate(zip(a.tolist(), b.tolist())):
        repeat[i] = key in owner_of or key in seen
        seen.add(key)
        owner.append(owner_of.get(key))
    if not repeat.any():
        return text, len(a), 0, 0, []
    edge = np.diff(np.concatenate(([0], repeat.view(np.int8), [0])))
    out, last, found = [], 0, set()
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo >= least_run or hi - lo == len(data):
            out.append(data[last:lo])
            last = hi
            found.update(o for o in owner[i:j] if o is not None)
    out.append(data[last:])
    kept = np.concatenate(out).tobytes()
    return kept.decode(), len(a), int(repeat.sum()), len(data) - len(kept), sorted(found)


def dedup(docs: DataFrame, least_run: int = RUN) -> DataFrame:
    """doc_id, text (what stays; null stays null), n_bytes, n_chunks, n_repeats, removed_bytes, owners (ids that keep what is removed here)."""
    scratch = Scratch(docs.sparkSession)
    seen = scratch.keep(earlier_owners(chunks(docs), scratch, ["d1", "d2"]).withColumnRenamed("doc_id", "own_id"), "seen")
    scratch.drop("pieces", "owners")
    kind = docs.schema["doc_id"].dataType.simpleString()

    @F.arrow_udf(f"struct<text: string, n_bytes: bigint, n_chunks: bigint, n_repeats: bigint, removed_bytes: bigint, owners: array<{kind}>>")
    def stripped(texts: pa.Array, d1: pa.Array, d2: pa.Array, owners: pa.Array) -> pa.Array:
        rows = [_strip(t or "", a.as_py() or [], b.as_py() or [], o.as_py() or [], least_run) for t, a, b, o in zip(texts.to_pylist(), d1, d2, owners)]
        text, n, again, gone, found = zip(*rows) if rows else ((), (), (), (), ())
        size = pa.array([len(t.encode()) + g for t, g in zip(text, gone)], pa.int64())
        text = pa.array([None if old is None else t for old, t in zip(texts.to_pylist(), text)], pa.string())
        return pa.StructArray.from_arrays([text, size, pa.array(n, pa.int64()), pa.array(again, pa.int64()), pa.array(gone, pa.int64()), pa.array(found, owners.type)], ["text", "n_bytes", "n_chunks", "n_repeats", "removed_bytes", "owners"])

    joined = docs.select("doc_id", "text").join(seen, F.col("doc_id") == F.col("own_id"), "left")
    return joined.select("doc_id", stripped("text", "d1", "d2", "owners").alias("got")).select("doc_id", "got.*")


def chunk_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeats, removed_bytes, kept_sha256, owners."""
    return dedup(docs).select("doc_id", "n_bytes", "n_chunks", "n_repeats", "removed_bytes", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "owners")
