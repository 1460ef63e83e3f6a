"""A folder's files, listed in tasks level by level, and its changes as a stream.

Both read local paths and folders mounted on all machines by the operating system, and
other stores through Arrow's file systems.  Excluded directories are never entered and
symbolic links are skipped.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.plans.storage import new_folder
from tessera.sources.files import EXCLUDED_DIRS

ENTRY = "dir string, name string, is_dir boolean, size_bytes bigint, mtime_ms bigint, inode bigint"


def _store(path: str):
    """(file system, path in it) of a URI; (None, path) where the operating system reads it."""
    if "://" not in path and not path.startswith("file:"):
        return None, path
    if path.startswith("file:"):
        return None, "/" + path.removeprefix("file:").lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def entries(folder: str) -> Iterator[tuple[str, bool, int, int, int | None]]:
    """(name, is_dir, bytes, mtime in ms, inode) of what lies in a folder; links and what has gone meanwhile are left out."""
    store, path = _store(folder)
    if store is not None:
        from pyarrow import fs

        for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if i.type in (fs.FileType.File, fs.FileType.Directory):
                yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000, None
        return
    try:
        found = os.scandir(path)
    except OSError:  # gone, or not ours to read
        return
    with found:
        for e in found:
            try:
                if not e.is_symlink() and (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                    s = e.stat(follow_symlinks=False)
                    yield e.name, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime_ns // 1_000_000, s.st_ino
            except OSError:
                continue


def pruned(names: tuple[str, ...] = ()) -> frozenset[str]:
    """Lower-case names of directories that are not entered."""
    return frozenset((*EXCLUDED_DIRS, *(n.lower() for n in names)))


def _wanted(name: str, extensions: frozenset[str] | None) -> bool:
    return extensions is None or os.path.splitext(name)[1].lower() in extensions


def _dotted(extensions: list[str] | None) -> frozenset[str] | None:
    return None if extensions is None else frozenset(e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions)


def list_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, excluded: tuple[str, ...] = (), recursive: bool = True, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files: path, dir, name, size_bytes, mtime_ms, inode; directories entered: dir) under root.

    The directories of a level are dealt out to `width` tasks, which list them and hand on
    those to enter next; what a level found is written, so no list of files passes the driver.
    Other extensions than the given ones never leave the task.
    """
    skip, kinds = pruned(excluded), _dotted(extensions)
    width, out = width or spark.sparkContext.defaultParallelism, new_folder(spark, "tree")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["dir"]:
                rows = []
                for name, is_dir, size, mtime, inode in entries(folder):
                    if (is_dir and name.lower() not in skip) or (not is_dir and _wanted(name, kinds)):
                        rows.append((folder, name, is_dir, size, mtime, inode))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=ENTRY_NAMES).astype({"inode": "Int64"})
                        rows = []
                rows.append((folder, None, True, None, None, None))  # entered
                yield pd.DataFrame(rows, columns=ENTRY_NAMES).astype({"inode": "Int64", "size_bytes": "Int64", "mtime_ms": "Int64"})

    frontier, level = spark.createDataFrame([(root.rstrip("/"),)], "dir string"), 0
    while True:
        frontier.repartition(width, "dir").mapInPandas(listed, ENTRY).write.parquet(f"{out}/level={level}")
        found = spark.read.schema(ENTRY).parquet(f"{out}/level={level}")
        frontier = found.where("is_dir and name is not null").selectExpr("concat(dir, '/', name) as dir")
        level += 1
        if not recursive or frontier.isEmpty():
            break
    every = spark.read.schema(ENTRY).parquet(*[f"{out}/level={i}" for i in range(level)])
    files = every.where("not is_dir").selectExpr("concat(dir, '/', name) as path", "dir", "name", "size_bytes", "mtime_ms", "inode")
    return files, every.where("name is null").select("dir")


ENTRY_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


# --- changes as a stream -------------------------------------------------

CHANGE = "change string, rel_path string, size_bytes bigint, mtime_ms bigint, inode bigint, version bigint"


class FolderChanges(DataSource):
    """format("folder_changes"): added, updated and deleted files of a folder as a stream.

    Options: path; snapshots, a folder that driver and executors share; interval_ms (least
    time between two looks, 1000), extensions and excluded (by commas), buckets (tasks, 8),
    depth (directories that deal a file to its task, 2).

    An offset is the number of a look.  Each task lists its share of the tree, writes it as
    its part of the look's snapshot, and returns where it differs from the snapshot that the
    batch begins with.  A task that finds its part written reads that, so a batch that is
    repeated after a failure or restart returns the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> FolderChangesReader:
        return FolderChangesReader(dict(self.options))


class _Share(InputPartition):
    def __init__(self, start: int, end: int, bucket: int) -> None:
        self.start, self.end, self.bucket = start, end, bucket


class FolderChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.snapshots = options["path"].rstrip("/"), options["snapshots"].rstrip("/")
        self.interval, self.buckets, self.depth = (int(options.get(k, d)) for k, d in (("interval_ms", 1000), ("buckets", 8), ("depth", 2)))
        names = lambda k: [x for x in options.get(k, "").split(",") if x]
        self.extensions, self.skip = _dotted(names("extensions") or None), pruned(tuple(names("excluded")))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1_000_000
        if now - self.last >= self.interval:
            self.last = now
        return {"look": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Share]:
        return [_Share(start["look"], end["look"], b) for b in range(self.buckets)]

    def _mine(self, parts: list[str], bucket: int) -> bool:
        return zlib.crc32("/".join(parts[: self.depth]).encode()) % self.buckets == bucket

    def _listed(self, bucket: int) -> dict[str, tuple]:
        """What lies in the directories of a bucket, and right in those above them."""
        out, open_ = {}, [[]]
        while open_:
            at = open_.pop()
            for name, is_dir, size, mtime, inode in entries("/".join([self.root, *at])):
                parts = [*at, name]
                if not is_dir:
                    if _wanted(name, self.extensions) and self._mine(parts, bucket):
                        out["/".join(parts)] = (size, mtime, inode)
                elif name.lower() not in self.skip and (len(parts) < self.depth or self._mine(parts, bucket)):
                    open_.append(parts)
        return out

    def _part(self, look: int, bucket: int) -> str:
        return f"{self.snapshots}/{look}/{bucket}.json"

    def read(self, share: _Share) -> Iterator[tuple]:
        before = (_load(self._part(share.start, share.bucket)) or {}) if share.start else {}
        after = _load(self._part(share.end, share.bucket))
        if after is None:
            _save(self._part(share.end, share.bucket), self._listed(share.bucket))
            after = _load(self._part(share.end, share.bucket))  # the one that counts, if two tasks wrote
        for path, facts in after.items():
            if path not in before or list(before[path]) != list(facts):
                yield ("updated" if path in before else "added", path, *facts, share.end)
        for path, facts in before.items():
            if path not in after:
                yield ("deleted", path, *facts, share.end)

    def commit(self, end: dict) -> None:
        """Looks before the one that the next batch begins with are done with."""
        store, path = _store(self.snapshots)
        for name, is_dir, *_ in list(entries(self.snapshots)):
            if is_dir and name.isdigit() and int(name) < end["look"]:
                if store is not None:
                    store.delete_dir(f"{path}/{name}")
                else:
                    for f in os.listdir(f"{path}/{name}"):
                        os.unlink(f"{path}/{name}/{f}")
                    os.rmdir(f"{path}/{name}")


def _load(path: str) -> dict | None:
    store, at = _store(path)
    try:
        if store is None:
            with open(at, encoding="utf-8") as f:
                return json.load(f)
        with store.open_input_stream(at) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _save(path: str, listed: dict) -> None:
    """Written aside, then put in place whole; where the operating system allows it, the first one stays."""
    store, at = _store(path)
    aside, data = f"{at}.{os.getpid()}-{time.time_ns()}", json.dumps(listed).encode()
    if store is not None:
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(aside) as f:
            f.write(data)
        store.move(aside, at)
        return
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(aside, "wb") as f:
        f.write(data)
    try:
        os.link(aside, at)
    except FileExistsError:
        pass
    os.unlink(aside)


def watch_changes(spark: SparkSession, root: str, snapshots: str, **options) -> DataFrame:
    """The changes under root as a stream: CHANGE."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=root, snapshots=snapshots, **{k: str(v) for k, v in options.items()}).load()
