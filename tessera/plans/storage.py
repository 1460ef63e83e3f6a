"""Checkpoints and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_sweep, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _MADE.add(path)
    return path


def _sweep(jvm, conf) -> None:
    with contextlib.suppress(Exception):  # the Java side may have ended first
        for path in map(jvm.org.apache.hadoop.fs.Path, _MADE):
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame to the shared folder, compressed, and gives it as read from there; what it wrote is removed at the end of the block."""
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(new_folder(spark, "kept"))
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, made):
            path.getFileSystem(conf).delete(path, True)
        _MADE.difference_update(made)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which Spark removes when nothing refers to it any more."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    own = sc._jsc.sc().conf()
    if not own.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        own.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()
