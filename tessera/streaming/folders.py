"""Structured Streaming: file arrivals, debounced scans, state machine, rate limits."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import cap_for_embedding
from tessera.operators.manifest import claim, upsert
from tessera.operators.rows import first_of
from tessera.plans.storage import checkpointed


def watch(spark: SparkSession, root: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files under root as a stream (deletions show in a periodic diff, not here)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(root)


def debounce(events: DataFrame, key: str, at: str, gap: str = "1 second") -> DataFrame:
    """One row per burst: events of a key less than the gap apart; batch or stream (a stream needs a watermark)."""
    w = F.session_window(F.col(at).cast("timestamp"), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def rate_limited(events: DataFrame, key: str, at: str, most: int, width: str = "1 minute") -> DataFrame:
    """Tumbling windows of a key with more requests than allowed: key, started, n, over."""
    w = F.window(F.col(at).cast("timestamp"), width)
    counts = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("started"), "n", (F.col("n") - most).alias("over"))


#: Parts of a folded table by the hash of its keys; a batch rewrites those that it touches.
BUCKETS = 64


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str, overwrite: list[str] | None = None, buckets: int = BUCKETS):
    """A query that folds each micro-batch, last row of a key, into the table at path (read by `folded`).

    The table lies in `buckets` parts by the hash of its keys, which stay as they were unless
    the batch has a row for them.  A log entry, moved into place after its parts are written,
    names the version of each part, so readers see whole batches and a restart repeats
    nothing.  Parts that an entry replaced are removed by the entry after it.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        spark, log = batch.sparkSession, _Log(batch.sparkSession, path)
        before = log.newest()
        if before is not None and before["number"] >= number:
            return
        parts = before["parts"] if before else {}
        batch = batch.persist()
        try:
            touched = [str(r[0]) for r in batch.select(place.alias("b")).distinct().collect()]  # at most `buckets` rows
            if not touched:
                return
            last, replaced = first_of(batch, keys, *order), [parts[b] for b in touched if b in parts]
            old = spark.read.parquet(*[f"{path}/{p}" for p in replaced]) if replaced else last.limit(0)
            made = upsert(old, last, keys, overwrite).withColumn("__bucket", place)
            made.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v={number}")
        finally:
            batch.unpersist()
        log.append({"number": number, "parts": parts | {b: f"v={number}/__bucket={b}" for b in touched}, "replaced": replaced})
        log.remove(before["replaced"] if before else [])

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def folded(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert_stream folds, as of its last whole batch; None before the first."""
    newest = _Log(spark, path).newest()
    return spark.read.parquet(*[f"{path}/{p}" for p in newest["parts"].values()]) if newest else None


class _Log:
    """The entries of a folded table: one JSON file a batch, through the file system of its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self.path, self.at = path, sc._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(sc._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self.at(f"{self.path}/_log")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def newest(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self.fs.open(self.at(f"{self.path}/_log/{numbers[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def append(self, entry: dict) -> None:
        written = self.at(f"{self.path}/_log/.{entry['number']}.json")
        stream = self.fs.create(written, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        if not self.fs.rename(written, self.at(f"{self.path}/_log/{entry['number']}.json")):
            raise OSError(f"log entry {entry['number']} of {self.path} is there already")

    def remove(self, parts: list[str]) -> None:
        for part in parts:
            self.fs.delete(self.at(f"{self.path}/{part}"), True)
        for number in self._numbers()[:-2]:
            self.fs.delete(self.at(f"{self.path}/_log/{number}.json"), False)


class Breaker:
    """Keeps calls from a service that failed `opens_at` times in a row for `cooldown` seconds; then one more failure closes it off again."""

    def __init__(self, opens_at: int = 3, cooldown: float = 300, clock: Callable[[], float] = time.monotonic) -> None:
        self.opens_at, self.cooldown, self.clock = opens_at, cooldown, clock
        self.failures, self.until = 0, None

    @property
    def is_open(self) -> bool:
        if self.until is not None and self.clock() >= self.until:
            self.until = None
        return self.until is not None

    def call(self, f: Callable, otherwise: Callable):
        """f(), or otherwise() while open and where f fails."""
        if self.is_open:
            return otherwise()
        try:
            got = f()
        except Exception:  # noqa: BLE001 - whatever a remote service raises
            self.failures += 1
            if self.failures >= self.opens_at:
                self.until = self.clock() + self.cooldown
            return otherwise()
        self.failures, self.until = 0, None
        return got


class SingleFlight:
    """Callers that ask for a key while it is being worked on wait for that work and share its result or error."""

    def __init__(self) -> None:
        self._lock, self._running = threading.Lock(), {}

    def do(self, key, f: Callable):
        with self._lock:
            mine = key not in self._running
            future = self._running.setdefault(key, Future())
        if not mine:
            return future.result()
        try:
            future.set_result(f())
        except BaseException as e:  # noqa: BLE001 - handed to all callers
            future.set_exception(e)
        finally:
            with self._lock:
                del self._running[key]
        return future.result()


def progress(streaming_query) -> list[dict]:
    """For each recent batch of a query its number, input rows and the milliseconds of each stage."""
    told = [json.loads(p.json) if hasattr(p, "json") else p for p in streaming_query.recentProgress]
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": dict(p["durationMs"])} for p in told]


def circuit(results: DataFrame, key: str, at: str, failed: Column, opens_at: int = 3) -> DataFrame:
    """Failure streaks that are long enough to open a circuit breaker."""
    from tessera.operators.stats import streaks

    return streaks(results, key, [at], failed).where(F.col("n") >= opens_at)


#: Tokens that an embedding model takes, and characters of the second try.
MOST_TOKENS, RETRY_CHARS = 510, 200


def within_tokens(text: str, count: Callable[[str], int], most: int = MOST_TOKENS) -> str:
    """The longest prefix of at most that many tokens; a text of no more characters is not counted."""
    if len(text) <= most or count(text) <= most:
        return text
    low, high = 0, len(text)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid)
    return text[:low]


def embed_batches(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "text", size: int = 64, dimension: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """key, embedding: texts embedded in batches by an injected function, cut to 510 tokens where a counter is given.

    A batch that fails is tried text by text (200 characters); what fails again has zeros of
    the dimension, or null where none is given.  Null texts count as empty.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), size):
                part = b.iloc[lo : lo + size]
                given = [t or "" for t in part[text]]
                given = [within_tokens(t, count) for t in given] if count else given
                try:
                    vectors = embed(given)
                except Exception:  # noqa: BLE001 - whatever a remote service raises
                    vectors = []
                    for t in given:
                        try:
                            vectors += embed([t[:RETRY_CHARS]])
                        except Exception:  # noqa: BLE001
                            vectors.append(None if dimension is None else [0.0] * dimension)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def embed_round(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], n: int, now: Column, **options) -> tuple[DataFrame, DataFrame]:
    """(id and embedding of up to n pending chunks, chunks after that): one round of a loop of leases.

    chunks: id, heading, content, status, locked_at.  Claimed chunks become embedded, or
    failed without a vector, and are unlocked; both results come from one checkpoint, so the
    service is asked once.
    """
    claimed = claim(chunks, n, now)
    texts = claimed.select("id", cap_for_embedding(F.concat_ws("\n", F.coalesce("heading", F.lit("")), "content")).alias("text"))
    made = checkpointed(embed_batches(texts, embed, "id", **options))
    done = made.select("id", F.col("embedding").isNotNull().alias("__done"))
    state = F.when(F.col("__done"), "embedded").when(~F.col("__done"), "failed").otherwise(F.col("status"))
    after = chunks.join(done, "id", "left").withColumn("status", state).withColumn("locked_at", F.when(F.col("__done").isNull(), F.col("locked_at")))
    return made.where("embedding is not null"), after.drop("__done")


def embed_pending(read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], embed: Callable[[list[str]], list[list[float]]], n: int = 256, rounds: int | None = None, wait: float = 2.0, clock: Callable[[], Column] = F.current_timestamp, sleep: Callable[[float], None] = time.sleep, **options) -> int:
    """Rounds of embed_round until no chunk is pending and free, or `rounds` were made; the chunks worked on.

    read gives the chunks as they are; write takes a round's vectors and the chunks after it,
    and should commit both as one (see sources.store).  With `rounds` None it goes on for
    good and waits where there is nothing to do, as a service does.
    """
    done = made = 0
    while rounds is None or made < rounds:
        made += 1
        chunks = read()
        vectors, after = embed_round(chunks, embed, n, clock(), **options)
        after = checkpointed(after)
        worked = after.join(chunks.select("id", F.col("status").alias("__was")), "id").where("status <> __was").count()
        if not worked:
            if rounds is not None:
                break
            sleep(wait)
            continue
        write(vectors, after)
        done += worked
    return done
