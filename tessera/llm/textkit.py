"""Vectorised text primitives over Arrow string buffers, and storage helpers.

Nothing here walks over rows in Python: a batch of texts is one byte buffer, and
words, word hashes and shingles are numpy arrays over it.  A batch is cut into
slices of about `SLICE_BYTES`, so memory depends on that and on the longest text.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Everything but blanks, tabs and line ends.
SOLID = np.ones(256, dtype=bool)
SOLID[32] = SOLID[9:14] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        if size > 64 * SLICE_BYTES:  # a giant text: not kept
            return _series(_P, size), _series(_P_INV, size)
        _POWERS["up"], _POWERS["down"] = _series(_P, size), _series(_P_INV, size)
    return _POWERS["up"], _POWERS["down"]


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of texts with about `most` bytes; a longer text is a run of its own."""
    data, at = buffer_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes of that kind; runs do not cross texts."""
    inside = kind[data]
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    cut = np.unique(at[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut - 1] & inside[cut]]
    if len(cut):
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    rows = np.searchsorted(at, starts, side="right") - 1
    return starts, ends, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from prefix sums of one polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of k words; a text of fewer words, but some, is one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes)
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    count = np.diff(np.append(first, n))
    out, of = [], []
    if n >= k:
        whole = rows[: n - k + 1] == rows[k - 1 :]
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(_P) + hashes[j : n - k + 1 + j]
        out.append(mix(h[whole]))
        of.append(rows[: n - k + 1][whole])
    short = count < k
    if short.any():
        h = np.zeros(int(short.sum()), np.uint64)
        left, f = count[short], first[short]
        for j in range(k - 1):
            on = left > j
            h[on] = h[on] * np.uint64(_P) + hashes[f[on] + j]
        out.append(mix(h ^ left.astype(np.uint64)))
        of.append(rows[f])
    h, r = np.concatenate(out), np.concatenate(of)
    if short.any():
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def binary_rows(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# --- storage -------------------------------------------------------------

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessera-"))


def _delete(jvm, conf, path: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor loses no lineage.

    drop() removes the named ones.  Those that a result still reads stay until the driver
    ends, which removes them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.paths, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{name}-{self.count}"
        if not _MADE:
            atexit.register(_sweep, self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration())
        _MADE.add(self.base)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                _delete(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), path)


def _sweep(jvm, conf) -> None:
    with contextlib.suppress(Exception):  # the Java side may have ended first
        for base in _MADE:
            _delete(jvm, conf, base)
