"""Keyed state on streams: the states of files, and bounded queues of requests.

Both are stateful processors: Spark deals the rows out by key, keeps each key's state in its
state store and restores it from the query's checkpoint, so a restart neither loses nor
repeats a move.  Rows of a micro-batch are taken in the order of (at, seq) or seq, and what
comes of them does not depend on how a stream is cut into batches.
"""

from __future__ import annotations

import contextlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.manifest import TRANSITIONS

#: Minutes after which a sync that has not ended is given up.
REAP_MINUTES = 60
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries that start within it keep state by column families, which the processors here need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# --- states of files -----------------------------------------------------

REQUEST = "folder_id string, rel_path string, at timestamp, seq bigint, to string, document_id string, sha1 string, error string"
MOVES = "folder_id string, rel_path string, at_us bigint, seq bigint, to string, moved boolean, status string, document_id string, sha1 string, last_error string, n_moved bigint"
_FILE = "folder_id string, rel_path string"
#: Groups of files whose states a task works on together.
SHARDS = 1024
_STATE = "status string, document_id string, sha1 string, last_error string, started_us bigint, n_moved bigint"


def moved(state: tuple | None, to: str, at_us: int, document_id, sha1, error, reap_us: int) -> tuple[tuple, bool]:
    """(state after the request, whether it moved): compare and swap by TRANSITIONS, from no state to any.

    A sync that began more than reap_us before the request is pending again first, without a
    document.  Starting clears document and error, ending sets document and hash, failing sets the error.
    """
    status, doc, known, err, started, n = state or (None, None, None, None, None, 0)
    if status == "syncing" and (started is None or at_us - started > reap_us):
        status, doc = "pending", None
    if status is not None and status not in TRANSITIONS[to]:
        return (status, doc, known, err, started, n), False
    if to == "syncing":
        doc, err, started = None, None, at_us
    elif to in ("synced", "partial"):
        doc, known = document_id, sha1
    elif to == "failed":
        err = error
    elif to == "deleted":
        doc = None
    return (to, doc, known, err, started, n + 1), True


class FileStates(StatefulProcessor):
    """The states of a shard's files; a timer gives up syncs that have not ended when the watermark is `minutes` past their start.

    A batch takes the state of each file that it has a row for from the state store once and
    writes it back once.  Files that are syncing are kept by themselves with the time of their
    end, and the shard has a timer for the first of them.
    """

    def __init__(self, minutes: int = REAP_MINUTES) -> None:
        self.reap_us = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", _FILE, _STATE)
        self.syncing = handle.getMapState("syncing", _FILE, "until_ms bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, soonest = [], None
        for (_, *file), asked in _by_file(rows):
            file = tuple(file)
            before, started = self.states.getValue(file), False
            state = before = before and tuple(before)
            for _, _, _, at_us, seq, to, document_id, sha1, error in asked:
                state, did = moved(state, to, at_us, _given(document_id), _given(sha1), _given(error), self.reap_us)
                started |= did and to == "syncing"
                out.append((*file, at_us, _given(seq), to, did, *state[:4], state[5]))
            self.states.updateValue(file, state)
            if state[0] != "syncing":
                if before and before[0] == "syncing":
                    self.syncing.removeKey(file)
            elif started:
                until = (state[4] + self.reap_us) // 1000 + 1
                self.syncing.updateValue(file, (until,))
                soonest = until if soonest is None else min(soonest, until)
            if len(out) >= SLICE:
                yield _moves(out)
                out = []
        self._wake(soonest)
        if out:
            yield _moves(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms, out, soonest = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], None
        for file, (until,) in [(tuple(k), v) for k, v in self.syncing.iterator()]:
            if until > now_ms:
                soonest = until if soonest is None else min(soonest, until)
                continue
            state = ("pending", None, *tuple(self.states.getValue(file))[2:])
            self.states.updateValue(file, state)
            self.syncing.removeKey(file)
            out.append((*file, until * 1000, None, "pending", True, *state[:4], state[5]))
        if self.timer.exists() and self.timer.get()[0] <= now_ms:
            self.timer.clear()
        self._wake(soonest)
        if out:
            yield _moves(out)

    def _wake(self, at_ms: int | None) -> None:
        """A timer at that time, unless there is one before it."""
        if at_ms is not None and not (self.timer.exists() and self.timer.get()[0] <= at_ms):
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _given(value):
    """None for what pandas has for null."""
    return None if value is None or value is pd.NaT or value != value else value


def _by_file(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(number, folder_id, rel_path) of each file and its rows, from these three on, by (at_us, seq)."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return
    asked = pd.concat(frames, ignore_index=True)
    asked["number"] = asked.groupby(["folder_id", "rel_path"], sort=False, dropna=False).ngroup()
    asked = asked.sort_values(["number", "at_us", "seq"], kind="stable")
    columns = [asked[c].tolist() for c in ("number", "folder_id", "rel_path", "at_us", "seq", "to", "document_id", "sha1", "error")]
    columns[1:3] = ([_given(x) for x in c] for c in columns[1:3])
    yield from groupby(zip(*columns), key=lambda r: r[:3])


def _moves(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(MOVES)).astype({"seq": "Int64"})


def file_states(requests: DataFrame, minutes: int = REAP_MINUTES, late: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """MOVES of a stream of REQUEST rows, with at: one for each request, moved or refused, and one (without seq) for each sync given up.

    The files are dealt to `shards` by the hash of their names, which a checkpoint fixes; a task
    takes a shard's rows of a batch at once.  Start the query within `state_store`.
    """
    shard = F.pmod(F.xxhash64("folder_id", "rel_path"), F.lit(shards))
    keyed = requests.withWatermark("at", late).withColumn("at_us", F.unix_micros("at")).withColumn("shard", shard).groupBy("shard")
    return keyed.transformWithStateInPandas(FileStates(minutes), MOVES, "Update", "EventTime").withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def states_after(requests: DataFrame, until: Column, minutes: int = REAP_MINUTES) -> DataFrame:
    """folder_id, rel_path, status, document_id, sha1, last_error, n_moved: the states that all requests of a table lead to, syncs given up as of `until`.

    The batch side of `file_states`, in column functions.  The requests of one file lie in one row.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    asked = requests.groupBy("folder_id", "rel_path").agg(F.array_sort(F.collect_list(F.struct(us(F.col("at")).alias("at"), "seq", "to", "document_id", "sha1", "error"))).alias("asked"))
    empty = F.lit(None).cast("struct<status:string,document_id:string,sha1:string,last_error:string,started:bigint,n_moved:bigint>")
    able = lambda s, to: s.isNull() | F.arrays_overlap(F.array(s), F.coalesce(*[F.when(to == t, F.array(*map(F.lit, by))) for t, by in TRANSITIONS.items()]))

    def reaped(s: Column, now: Column) -> Column:
        stale = (s["status"] == "syncing") & (s["started"].isNull() | (now - s["started"] > minutes * 60_000_000))
        return F.when(stale, s.withField("status", F.lit("pending")).withField("document_id", F.lit(None).cast("string"))).otherwise(s)

    def step(state: Column, r: Column) -> Column:
        s, to = reaped(state, r["at"]), r["to"]
        did = able(s["status"], to)
        starts, ends = did & (to == "syncing"), did & to.isin("synced", "partial")
        document = F.when(ends, r["document_id"]).when(~(starts | (did & (to == "deleted"))), s["document_id"])
        error = F.when(did & (to == "failed"), r["error"]).when(~starts, s["last_error"])
        return F.struct(
            F.when(did, to).otherwise(s["status"]).alias("status"), document.alias("document_id"), F.when(ends, r["sha1"]).otherwise(s["sha1"]).alias("sha1"),
            error.alias("last_error"), F.when(starts, r["at"]).otherwise(s["started"]).alias("started"), (F.coalesce(s["n_moved"], F.lit(0)) + did.cast("bigint")).alias("n_moved"),
        )

    last = asked.select("folder_id", "rel_path", reaped(F.aggregate("asked", empty, step), us(until)).alias("s"))
    return last.select("folder_id", "rel_path", "s.status", "s.document_id", "s.sha1", "s.last_error", "s.n_moved")


# --- queues --------------------------------------------------------------

ARRIVAL = "folder_id string, rel_path string, seq bigint, kind string"
OUTCOME = "folder_id string, rel_path string, seq bigint, kind string, outcome string"
#: Waiting requests of a folder, and running ones.
MOST_WAITING, MOST_RUNNING = 100_000, 2
#: Rows of a frame that a queue returns, and of what is taken from the order at once.
SLICE = 20_000


def _arrivals(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
    """(path, seq, kind) of all frames in the order of seq; each distinct path and kind is kept once."""
    names: dict = {}
    number = lambda column: np.fromiter((names.setdefault(x, len(names)) for x in column), np.int32, len(column))
    parts = [(f["seq"].to_numpy(np.int64), number(f["rel_path"]), number(f["kind"])) for f in frames if len(f)]
    if not parts:
        return
    seq, path, kind = (np.concatenate(p) for p in zip(*parts))
    del parts
    order, known = np.argsort(seq, kind="stable"), list(names)
    for i in range(0, len(order), SLICE):
        at = order[i : i + SLICE]
        yield from ((known[p], s, known[k]) for p, s, k in zip(path[at].tolist(), seq[at].tolist(), kind[at].tolist()))


class FolderQueue(StatefulProcessor):
    """The queue of one folder: the last request of a file waits in the place of its first, the oldest goes where too many wait.

    A batch takes the queue (at most `most` files) from the state store once and writes back
    what has changed; its rows are kept as numbers, some 13 bytes each, until they are in order.
    """

    def __init__(self, most: int = MOST_WAITING, running: int = MOST_RUNNING) -> None:
        self.most, self.most_running = most, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "rel_path string", "place bigint, seq bigint, kind string")
        self.places = handle.getMapState("places", "place bigint", "rel_path string")
        self.running = handle.getMapState("running", "rel_path string", "seq bigint")
        self.sizes = handle.getValueState("sizes", "head bigint, tail bigint, waiting bigint, running bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, tail, *_ = self.sizes.get() if self.sizes.exists() else (0, 0, 0, 0)
        before = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        was_running = {k[0]: v[0] for k, v in self.running.iterator()}
        waiting, running, out = OrderedDict(sorted(before.items(), key=lambda kv: kv[1][0])), dict(was_running), []
        for path, seq, kind in _arrivals(rows):
            if kind == "finished":
                running.pop(path, None)
            elif path in running:
                out.append((*key, path, seq, kind, "skipped"))
            elif path in waiting:
                place, *old = waiting[path]
                out.append((*key, path, *old, "replaced"))
                waiting[path] = (place, seq, kind)
            else:
                if len(waiting) >= self.most:
                    old, (_, *was) = waiting.popitem(last=False)
                    out.append((*key, old, *was, "dropped"))
                waiting[path] = (tail, seq, kind)
                tail += 1
            while waiting and len(running) < self.most_running:
                old, (_, *was) = waiting.popitem(last=False)
                running[old] = was[0]
                out.append((*key, old, *was, "started"))
            if len(out) >= SLICE:
                yield pd.DataFrame(out, columns=_names(OUTCOME))
                out = []
        for path, (place, *_) in before.items():
            if path not in waiting:
                self.waiting.removeKey((path,))
            if path not in waiting or waiting[path][0] != place:
                self.places.removeKey((place,))
        for path, value in waiting.items():
            if before.get(path) != value:
                self.waiting.updateValue((path,), value)
                if path not in before or before[path][0] != value[0]:
                    self.places.updateValue((value[0],), (path,))
        for path in was_running.keys() - running.keys():
            self.running.removeKey((path,))
        for path, seq in running.items():
            if was_running.get(path) != seq:
                self.running.updateValue((path,), (seq,))
        self.sizes.update((next(iter(waiting.values()))[0] if waiting else tail, tail, len(waiting), len(running)))
        if out:
            yield pd.DataFrame(out, columns=_names(OUTCOME))

    def close(self) -> None:
        pass


def folder_queues(arrivals: DataFrame, most: int = MOST_WAITING, running: int = MOST_RUNNING) -> DataFrame:
    """OUTCOME of a stream of ARRIVAL rows (requests, or kind `finished` for a file that was started).

    started, in the order of places while fewer than `running` files of the folder are being
    worked on; skipped, as the file is being worked on; replaced by a later request of the
    same file; dropped, as `most` wait.  Start the query within `state_store`.
    """
    return arrivals.groupBy("folder_id").transformWithStateInPandas(FolderQueue(most, running), OUTCOME, "Append", "None")
