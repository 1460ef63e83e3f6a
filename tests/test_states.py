"""States of files and queues on streams, with restarts, against the batch side and plain Python."""

import random
from collections import OrderedDict, defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.manifest import TRANSITIONS
from tessera.plans.catalogue import QUERIES
from tessera.streaming import folders, states



def _requests(spark, rows):
    """rows: (path, minute, seq, to); ids, hashes and errors follow from seq."""
    frame = spark.createDataFrame([("f", p, float(m), s, to, f"d{s}", f"h{s}", f"e{s}") for p, m, s, to in rows], "folder_id string, rel_path string, minute double, seq bigint, to string, document_id string, sha1 string, error string")
    return frame.withColumn("minute", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)).withColumnRenamed("minute", "at")


def _by_hand(rows, until):
    out = {}
    for p, m, s, to in sorted(rows, key=lambda r: (r[1], r[2])):
        status, doc, sha, err, began, n = out.get(p, (None,) * 5 + (0,))
        if status == "syncing" and m - began > 60:
            status, doc = "pending", None
        if status is None or status in TRANSITIONS[to]:
            n += 1
            doc, sha = (f"d{s}", f"h{s}") if to in ("synced", "partial") else (None if to in ("syncing", "deleted") else doc, sha)
            err = None if to == "syncing" else f"e{s}" if to == "failed" else err
            began, status = (m if to == "syncing" else began), to
        out[p] = (status, doc, sha, err, began, n)
    return {p: ("pending", None, v[2], v[3], v[5]) if v[0] == "syncing" and until - v[4] > 60 else (*v[:4], v[5]) for p, v in out.items()}


LITERAL = [
    ("a", 0, 1, "pending"), ("a", 1, 2, "syncing"), ("a", 2, 3, "syncing"), ("a", 3, 4, "synced"),  # the second start loses
    ("b", 0, 5, "pending"), ("b", 1, 6, "syncing"),  # given up in the end
    ("c", 0, 7, "syncing"), ("c", 5, 8, "failed"), ("c", 6, 9, "synced"), ("c", 7, 10, "pending"), ("c", 8, 11, "syncing"), ("c", 80, 12, "synced"), ("c", 81, 13, "syncing"),  # late: given up before it ended
    ("d", 10, 14, "deleted"), ("d", 11, 15, "pending"), ("e", 100, 16, "pending"), ("e", 100, 17, "syncing"),
]


def test_states_of_a_literal_stream(spark):
    until = F.timestamp_seconds(F.lit(1_700_000_000 + 100 * 60))
    got = {r["rel_path"]: tuple(r)[2:] for r in states.states_after(_requests(spark, LITERAL), until).collect()}
    assert got == _by_hand(LITERAL, 100)
    assert got["a"] == ("synced", "d4", "h4", None, 3) and got["b"] == ("pending", None, None, None, 2) and got["d"] == ("deleted", None, None, None, 1)
    assert got["c"][:2] == ("syncing", None) and got["e"][0] == "syncing"


@pytest.mark.parametrize("cuts", [[20], [0, 40], [13, 55, 90]])
def test_a_restarted_stream_ends_in_the_same_states(spark, tmp_path, cuts):
    """Files arrive between runs of one checkpoint; every run begins with the state that the last one left."""
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 9)}", m, m, rng.choice(list(TRANSITIONS))) for m in sorted(rng.sample(range(0, 1000), 110))] + [("late", 2000, 5000, "pending")]
    given, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        _requests(spark, rows[lo:hi]).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(states.REQUEST).parquet(given)
        moves = states.file_states(stream)
        with states.state_store(spark):
            folders.upsert_stream(moves, f"{out}/table", ["folder_id", "rel_path"], [F.col("n_moved").desc(), F.col("seq").desc_nulls_first()], f"{out}/checkpoint", ["status", "document_id", "sha1", "last_error"], 4).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r["rel_path"]: (r["status"], r["document_id"], r["sha1"], r["last_error"], r["n_moved"]) for r in folders.folded(spark, f"{out}/table").collect()}
    want = _by_hand(rows, 2000)
    batch = states.states_after(_requests(spark, rows), F.timestamp_seconds(F.lit(1_700_000_000 + 2000 * 60)))
    assert {r["rel_path"]: tuple(r)[2:] for r in batch.collect()} == want
    given_up = {p for p, v in want.items() if v[0] == "pending" and got[p][0] == "pending"}
    assert {p: v[:4] for p, v in got.items()} == {p: v[:4] for p, v in want.items()}
    assert given_up  # the watermark gave some up


def _queue(rows, most, running):
    """Outcomes, in order, of one folder's arrivals."""
    waiting, active, out = OrderedDict(), {}, []
    for path, seq, kind in rows:
        if kind == "finished":
            active.pop(path, None)
        elif path in active:
            out.append((path, seq, kind, "skipped"))
        elif path in waiting:
            out.append((path, *waiting[path], "replaced"))
            waiting[path] = (seq, kind)
        else:
            if len(waiting) >= most:
                old, was = waiting.popitem(last=False)
                out.append((old, *was, "dropped"))
            waiting[path] = (seq, kind)
        while waiting and len(active) < running:
            old, was = waiting.popitem(last=False)
            active[old] = was
            out.append((old, *was, "started"))
    return out


def test_queue_of_a_literal_stream(spark, tmp_path):
    """Two files run, three wait, and so on, over three runs of one checkpoint."""
    rows = [("a", 1, "added"), ("b", 2, "added"), ("a", 3, "updated"), ("c", 4, "added"), ("d", 5, "added"), ("c", 6, "updated"), ("e", 7, "added"), ("f", 8, "added"), ("b", 9, "finished"), ("x", 10, "finished"), ("a", 11, "finished"), ("b", 12, "deleted"), ("g", 13, "added")]
    got = []
    for k, part in enumerate((rows[:4], rows[4:9], rows[9:])):
        spark.createDataFrame([("one", *r) for r in part], states.ARRIVAL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = states.folder_queues(spark.readStream.schema(states.ARRIVAL).parquet(f"{tmp_path}/in"), 3, 2)
        with states.state_store(spark):
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r)[1:] for r in spark.read.schema(states.OUTCOME).parquet(f"{tmp_path}/out").collect()]
    want = _queue(rows, 3, 2)
    assert sorted(got) == sorted(want)
    assert ("c", 4, "added", "replaced") in got and ("c", 6, "updated", "dropped") in got and ("a", 3, "updated", "skipped") in got
    assert [r for r in want if r[3] == "started"][:4] == [("a", 1, "added", "started"), ("b", 2, "added", "started"), ("d", 5, "added", "started"), ("e", 7, "added", "started")]


def test_queues_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    by = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: r["event_id"]):
        by[r["event_type"]].append((str(r["user_id"]), r["event_id"], "finished" if r["event_id"] % 3 == 0 else "updated"))
    want = sorted((folder, *o) for folder, rows in by.items() for o in _queue(rows, 20, 2))
    got = sorted(tuple(r) for r in QUERIES["folder_queues"](spark, sf).collect())
    assert got == want and {o[4] for o in got} >= {"started", "replaced"}


class _Kept:
    """A state variable in memory that counts what is asked of it."""

    calls = 0

    def __init__(self):
        self.kept = {}

    def __getattr__(self, name):
        kept = self.kept
        _Kept.calls += 1
        return {
            "updateValue": kept.__setitem__, "removeKey": kept.__delitem__, "iterator": lambda: iter(list(kept.items())), "containsKey": kept.__contains__,
            "getValue": kept.get, "update": lambda v: kept.__setitem__((), v), "exists": lambda: () in kept, "get": lambda: kept[()],
        }[name]


def test_a_batch_asks_the_state_store_by_the_size_of_the_queue():
    """Some calls for a batch of thousands of rows, over several batches, frames out of order."""
    rng = random.Random(5)
    rows = [(f"p{rng.randint(0, 60)}", i, "finished" if i % 3 == 0 else "updated") for i in range(24_000)]
    queue, got, _Kept.calls = states.FolderQueue(20, 2), [], 0
    queue.waiting, queue.places, queue.running, queue.sizes = (_Kept() for _ in range(4))
    for part in (rows[:9_000], rows[9_000:9_010], rows[9_010:]):
        mixed = rng.sample(part, len(part))
        frames = [pd.DataFrame([("f", *r) for r in mixed[i : i + 2_500]], columns=["folder_id", "rel_path", "seq", "kind"]) for i in range(0, len(mixed), 2_500)]
        for frame in queue.handleInputRows(("f",), iter(frames), None):
            got += [tuple(r)[1:] for r in frame.itertuples(index=False)]
        assert queue.places.kept == {(v[0],): k for k, v in queue.waiting.kept.items()}
    assert got == _queue(rows, 20, 2)
    assert _Kept.calls < 500


class _Cleared(_Kept):
    def clear(self):
        self.kept.clear()


def test_a_batch_asks_for_a_file_once_and_sets_one_timer_for_a_shard():
    """Hundreds of files in a shard, over several batches, frames out of order, timers between batches."""
    rng, zero = random.Random(7), 1_700_000_000_000
    rows = [(f"p{rng.randint(0, 200)}", m, m, rng.choice(list(TRANSITIONS))) for m in range(6_000)]
    shard, timers = states.FileStates(), set()
    shard.states, shard.syncing, shard.timer = kept = [_Cleared() for _ in range(3)]
    shard.handle = SimpleNamespace(registerTimer=timers.add)
    for part in (rows[:3_000], rows[3_000:3_010], rows[3_010:]):
        mixed = rng.sample([("f", p, (zero + m * 60_000) * 1000, s, to, f"d{s}", f"h{s}", f"e{s}") for p, m, s, to in part], len(part))
        frames = [pd.DataFrame(mixed[i : i + 700], columns=["folder_id", "rel_path", "at_us", "seq", "to", "document_id", "sha1", "error"]) for i in range(0, len(mixed), 700)]
        _Kept.calls, before = 0, len(timers)
        assert sum(len(f) for f in shard.handleInputRows((0,), iter(frames), None)) == len(part)
        assert _Kept.calls <= 3 * len({r[0] for r in part}) + 4 and len(timers) <= before + 1
        now = zero + part[-1][1] * 60_000
        for at in sorted(t for t in timers if t <= now):
            timers.discard(at)
            list(shard.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
        held, syncing, timer = (k.kept for k in kept)
        want = _by_hand(rows[: part[-1][1] + 1], part[-1][1])
        assert {p: (*v[:4], v[5]) for (_, p), v in held.items()} == want
        assert {p for _, p in syncing} == {p for p, v in want.items() if v[0] == "syncing"}
        assert not syncing or (timer[()][0] <= min(v for v, in syncing.values()) and timer[()][0] in timers)


def test_files_without_a_name_and_requests_without_a_number_have_states(spark, tmp_path):
    rows = [(None, 0, 1, "pending"), (None, 1, 2, "syncing"), ("a", 0, None, "pending"), ("a", 1, 4, "syncing"), ("b", 500, 5, "pending")]
    _requests(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    moves = states.file_states(spark.readStream.schema(states.REQUEST).parquet(f"{tmp_path}/in"), shards=1)
    with states.state_store(spark):
        moves.writeStream.format("memory").queryName("moves").outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = [(r["rel_path"], r["seq"], r["to"], r["moved"], r["n_moved"]) for r in spark.table("moves").collect()]
    given_up = [(None, None, "pending", True, 2), ("a", None, "pending", True, 2)]
    assert sorted(got, key=str) == sorted([(None, 1, "pending", True, 1), (None, 2, "syncing", True, 2), ("a", None, "pending", True, 1), ("a", 4, "syncing", True, 2), ("b", 5, "pending", True, 1), *given_up], key=str)
