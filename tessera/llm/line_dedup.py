"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that are not blank.  From every window of
`WINDOW` lines the position with the least hash is a fingerprint (the rightmost of
equal ones), so two runs of at least that many equal lines share one.  Only these
positions are written, 2 in WINDOW + 1 of them on average, each with the lines (hashes) up
to WINDOW - 1 before and after it.  Positions whose fingerprint occurs once are dropped.
The others are joined with the first position of their fingerprint, by doc_id and line, and
the match is extended line by line both ways; where it reaches WINDOW lines and the first
position is an earlier document's, the run is deleted.  A longer run is deleted whole, since
every window in it holds a fingerprint whose match covers the window.

A fingerprint's first position need not have the lines of all others around it.  Windows that
chose a position and that its match does not cover are told apart by their lines among each
other, and the later ones deleted: the result is that of comparing all windows with all.  A
line of at least `LONG_LINE` characters is a window of its own (with LONG_LINE 0 none is).

A hot fingerprint is one row of the table of first positions, never joined with its other
positions.  The order is by doc_id, then line.  Rows that share an id do not see each other's
lines; rows with a null id are only deduplicated within themselves.  Null texts stay null,
blank lines stay; the text of a document that repeats nothing is unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.native_text import unused
from tessera.llm.textkit import Scratch, hash_spans, mix, slices, strings

WINDOW = 2
LONG_LINE = 200
#: Most bytes of the table of lines to delete that is broadcast; beyond it the texts are shuffled to theirs.
BROADCAST_BYTES = 32 << 20


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row, hash and length in characters of all lines that are not blank."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((at[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    rows = np.searchsorted(at, starts, side="right") - 1
    ends = np.minimum(at[rows + 1], np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    ink = np.concatenate(([0], np.cumsum((data != 32) & (data != 9) & (data != 13) & (data != 10))))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    keep = ink[ends] > ink[starts]
    starts, ends, rows = starts[keep], ends[keep], rows[keep]
    return starts, ends, rows, hash_spans(data, starts, ends), chars[ends] - chars[starts]


def _fingerprints(h: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """For each start of a window of w lines the chosen position, -1 where the text ends before."""
    n = len(h) - w + 1
    if n <= 0:
        return np.full(len(h), -1)
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, w):
        less = h[j : j + n] <= best
        best[less], at[less] = h[j : j + n][less], np.arange(n)[less] + j
    at[rows[:n] != rows[w - 1 :]] = -1
    return np.concatenate((at, np.full(w - 1, -1)))


def _windows(h: np.ndarray, w: int) -> np.ndarray:
    """The hash of the w lines from each position on."""
    out = np.zeros(len(h), np.uint64)
    padded = np.concatenate((h, np.zeros(w, np.uint64)))
    for j in range(w):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(h)]
    return mix(out)


def _found(h: np.ndarray, rows: np.ndarray, size: np.ndarray, w: int, long_line: int) -> tuple[np.ndarray, ...]:
    """Of every window, long lines too: its first line, width, and the hash of its lines."""
    on = np.flatnonzero(rows[: max(0, len(h) - w + 1)] == rows[w - 1 :]) if len(h) >= w else np.zeros(0, np.int64)
    big = np.flatnonzero(size >= long_line) if long_line else np.zeros(0, np.int64)
    width = np.concatenate((np.full(len(on), w), np.ones(len(big), np.int64)))
    return np.concatenate((on, big)), width, np.concatenate((mix(_windows(h, w)[on]), mix(h[big] + np.uint64(1))))


def _around(h: np.ndarray, rows: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """The line hashes from w - 1 before to w - 1 after each position, 0 beyond its text."""
    spot = at[:, None] + np.arange(1 - w, w)
    inside = (spot >= 0) & (spot < len(h))
    spot = np.clip(spot, 0, max(0, len(h) - 1))
    return np.where(inside & (rows[spot] == rows[at][:, None]), np.maximum(h[spot], np.uint64(1)), np.uint64(0))


def positions(docs: DataFrame, w: int, long_line: int) -> DataFrame:
    """doc_id, text_hash, at (line), fingerprint, around (line hashes), chose (bit j: the window that begins j lines before chose it; 0: a long line)."""
    if not 1 <= w < 63:
        raise ValueError("windows have 1 to 62 lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(strings(batch.column(2))):
                _, _, rows, h, size = _lines(data, at)
                chosen = _fingerprints(h, rows, w)
                on = np.flatnonzero(chosen >= 0)
                place, of = np.unique(chosen[on], return_inverse=True)
                chose = np.zeros(len(place), np.int64)
                np.bitwise_or.at(chose, of.reshape(-1), np.int64(1) << (chosen[on] - on))
                big = np.flatnonzero(size >= long_line) if long_line else on[:0]
                marks = np.concatenate((h[place], mix(h[big])))
                around = np.concatenate((_around(h, rows, place, w), np.zeros((len(big), 2 * w - 1), np.uint64)))
                place, chose = np.concatenate((place, big)), np.concatenate((chose, np.zeros(len(big), np.int64)))
                row, line = pa.array(first + rows[place]), place - np.searchsorted(rows, rows[place])
                wide = 8 * (2 * w - 1)
                packed = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(np.arange(0, wide * len(place) + 1, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(line.astype(np.int64)), pa.array(marks.view(np.int64)), packed, pa.array(chose)], ["doc_id", "text_hash", "at", "fingerprint", "around", "chose"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, text_hash bigint, at bigint, fingerprint bigint, around binary, chose bigint")


def _extended(joined: DataFrame, w: int) -> DataFrame:
    """doc_id, text_hash, low, high, span: where span is null, lines to delete, as the match with the first position has them; else a window that this match does not cover, by its lines."""

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), 2 * w - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, first = matrix(b.column("around")), matrix(b.column("first_around"))
            at, chose = b.column("at").to_numpy(), b.column("chose").to_numpy()
            later = b.column("later").to_numpy(zero_copy_only=False).astype(bool)
            same = (own == first) & (own != 0)
            before = np.cumprod(same[:, w - 2 :: -1], axis=1).sum(axis=1) if w > 1 else np.zeros(len(at), np.int64)
            after = np.cumprod(same[:, w:], axis=1).sum(axis=1) if w > 1 else before
            long_ = chose == 0
            gone = np.flatnonzero(later & (long_ | (before + after + 1 >= w)))
            row, low, high, span = [gone], [at[gone] - before[gone] * ~long_[gone]], [at[gone] + after[gone] * ~long_[gone]], [np.zeros(len(gone), np.uint64)]
            for j in range(w):  # windows that begin j lines before their position
                rest = np.flatnonzero(((chose >> j) & 1).astype(bool) & ~((before >= j) & (after >= w - 1 - j)))
                h = np.zeros(len(rest), np.uint64)
                for k in range(w):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + own[rest, w - 1 - j + k]
                row.append(rest)
                low.append(at[rest] - j)
                high.append(at[rest] - j + w - 1)
                span.append(np.maximum(mix(h), np.uint64(1)))
            row, span = pa.array(np.concatenate(row)), np.concatenate(span)
            spans = pa.array(span.view(np.int64), mask=span == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("text_hash").take(row), pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), spans], ["doc_id", "text_hash", "low", "high", "span"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text_hash bigint, low bigint, high bigint, span bigint")


def repeated_lines(docs: DataFrame, w: int, long_line: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, low, high: the lines (from, to) of each text that came in an earlier document."""
    marks = scratch.keep(positions(docs, w, long_line), "marks")
    firsts = marks.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "around")).alias("first")).where("n > 1")
    firsts = scratch.keep(firsts.select("fingerprint", F.col("first.doc_id").alias("first_id"), F.col("first.around").alias("first_around")), "firsts")
    joined = marks.join(firsts, "fingerprint").select("doc_id", "text_hash", "at", "around", "chose", "first_around", (F.col("doc_id") > F.col("first_id")).alias("later"))
    got = scratch.keep(_extended(joined, w), "matches")
    rest = got.where("span is not null")
    owners = scratch.keep(rest.groupBy("span").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "owners")
    again = rest.join(owners, "span").where("doc_id > owner").select("doc_id", "text_hash", "low", "high")
    return got.where("span is null").select("doc_id", "text_hash", "low", "high").unionByName(again)


def _keep(text: str, low: np.ndarray, high: np.ndarray, w: int, long_line: int) -> tuple[str, int, int]:
    """The text without those lines and without windows that came in it before, its lines, the lines deleted."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, rows, h, size = _lines(raw, np.array([0, len(raw)]))
    begin, width, span = _found(h, rows, size, w, long_line)
    first = np.zeros(len(span), bool)
    first[np.unique(span, return_index=True)[1]] = True
    edges = np.zeros(len(h) + 1, np.int64)
    np.add.at(edges, np.concatenate((low, begin[~first])), 1)
    np.add.at(edges, np.concatenate((high + 1, (begin + width)[~first])), -1)
    drop = np.cumsum(edges[:-1]) > 0
    if not drop.any():
        return text, len(h), 0
    out, last = [], 0
    for s, e in zip(starts[drop].tolist(), ends[drop].tolist()):
        out.append(raw[last:s])
        last = min(e + 1, len(raw))
    out.append(raw[last:])
    kept = np.concatenate(out).tobytes()
    if last == len(raw) and kept.endswith(b"\n") and not text.endswith("\n"):
        kept = kept[:-1]
    return kept.decode(), len(h), int(drop.sum())


def dedup(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """docs (doc_id, text and any others) with text replaced by what stays, and n_lines, n_deleted after the other columns.

    Columns of docs named n_lines or n_deleted are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    own_id, own_hash, gone_name, got_name = (unused(docs, c) for c in ("__id", "__hash", "__gone", "__got"))
    seen = repeated_lines(docs, window, long_line, scratch).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    seen = scratch.keep(seen.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.struct(F.col("gone.low").alias("low"), F.col("gone.high").alias("high")).alias(gone_name)), "seen")
    scratch.drop("marks", "firsts", "matches", "owners")

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_deleted: bigint>")
    def kept(texts: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        out = []
        for text, low, high in zip(texts.to_pylist(), lows, highs):
            low, high = (np.array(x.as_py() or [], np.int64) for x in (low, high))
            got, n, dropped = _keep(text, low, high, window, long_line) if text else (text, 0, 0)
            out.append((got, n, dropped))
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["text", "n_lines", "n_deleted"])

    mine = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    got = kept.asNondeterministic()(docs["text"], F.col(f"{gone_name}.low"), F.col(f"{gone_name}.high"))  # so that a filter above does not run it again
    held_bytes = seen.select(F.sum(F.size(f"{gone_name}.low") * 16 + 64)).first()[0] or 0
    seen = F.broadcast(seen) if held_bytes <= BROADCAST_BYTES else seen.hint("merge")
    same = (docs["doc_id"] == F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_hash))
    joined = docs.join(seen, same, "left").select(*[docs[c] for c in mine], got.alias(got_name))
    return joined.select(*[F.col(f"{got_name}.text").alias("text") if c == "text" else c for c in mine], f"{got_name}.n_lines", f"{got_name}.n_deleted")


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, kept_md5 (of the text that stays; of an empty one for null)."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLE = f"""
WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
ink AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM cut WHERE regexp_matches(line, '[^ \\t\\r]')),
wide AS (SELECT doc_id, i, 2 AS width, md5(line) || md5(lead(line) OVER w) AS span FROM ink WINDOW w AS (PARTITION BY doc_id ORDER BY i)
         UNION ALL SELECT doc_id, i, 1, md5(line) FROM ink WHERE length(line) >= {LONG_LINE}),
later AS (SELECT doc_id, i, width FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS nth FROM wide WHERE span IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest([0, 1]) AS k) WHERE k < width),
stays AS (SELECT c.doc_id, c.pos, c.line, k.i IS NOT NULL AS inked, g.i IS NOT NULL AS deleted FROM cut c LEFT JOIN ink k USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i)
SELECT doc_id, count(*) FILTER (inked) AS n_lines, count(*) FILTER (deleted) AS n_deleted,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT deleted), '')) AS kept_md5
FROM stays GROUP BY doc_id
"""
