"""What the stages of a search and the batches of streams took: rows, milliseconds, own metrics."""

from __future__ import annotations

import contextlib
import json
import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tessera.plans.storage import checkpointed


class Stages:
    """Times stages that end in a checkpoint and counts their rows while they run, without another pass."""

    def __init__(self) -> None:
        self.done: list[dict] = []

    def kept(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """df checkpointed; its rows, milliseconds and aggregates of its columns are told under the stage's name."""
        seen, began = Observation(stage), time.monotonic()
        out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]))
        self.done.append({"stage": stage, "ms": round(1000 * (time.monotonic() - began)), **seen.get})
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """place, stage, rows, ms of the stages so far."""
        return spark.createDataFrame([(i, d["stage"], d["rows"], d["ms"]) for i, d in enumerate(self.done)], "place int, stage string, rows bigint, ms bigint")


class _Listener(StreamingQueryListener):
    def __init__(self, most: int) -> None:
        self.most, self.lock, self.batches, self.ended = most, threading.Lock(), [], {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        told = {"query": p["name"] or p["id"], "batch": p["batchId"], "rows": p.get("numInputRows", 0), "ms": dict(p["durationMs"]), "metrics": dict(p.get("observedMetrics") or {}), "state": [{"rows": s["numRowsTotal"], "updated": s["numRowsUpdated"]} for s in p.get("stateOperators", [])]}
        with self.lock:
            self.batches = [*self.batches, told][-self.most :]

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended[str(event.id)] = event.exception

    def onQueryIdle(self, event) -> None:
        pass


@contextlib.contextmanager
def listening(spark: SparkSession, most: int = 10_000):
    """Collects each batch of all streams that run within it (the last `most`): .batches (query, batch, rows, ms of each step, observed metrics, state) and .ended."""
    listener = _Listener(most)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
