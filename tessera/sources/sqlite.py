"""Tables of a SQLite file as DataFrames, read in tasks by ranges of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _open(path: str) -> sqlite3.Connection:
    """For reading alone; the file is never made or changed."""
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _kind(declared: str):
    """By SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d or not d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


class SQLiteTable(DataSource):
    """format("sqlite"): options path (where every machine finds the file), table, partitions (8), where.

    where is a condition in the file's own SQL that its rows are read under.  (Spark keeps what
    it once pushed to a source in Python for later queries of the same frame, so filters are not
    pushed.)  A table without row ids is one partition.  Values not of their column's kind are null.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(r[1], _kind(r[2])) for r in rows])

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(dict(self.options), schema)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.wanted, self.columns = options["path"], options["table"], int(options.get("partitions", 8)), schema
        self.where = options.get("where", "")

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID, or a view
                return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        step = -(-(high - low + 1) // self.wanted)
        return [_Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        where = [f"({self.where})"] * bool(self.where) + [f"rowid BETWEEN {part.low} AND {part.high}"] * (part.low is not None)
        sql = f"SELECT {', '.join(_name(f.name) for f in self.columns)} FROM {_name(self.table)}" + (" WHERE " + " AND ".join(where) if where else "")
        kinds = [{LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}[type(f.dataType)] for f in self.columns]
        db = _open(self.path)
        try:
            for row in db.execute(sql):
                yield tuple(None if v is None else v if type(v) is k else float(v) if k is float and type(v) is int else str(v) if k is str and type(v) in (int, float) else None for v, k in zip(row, kinds))
        finally:
            db.close()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, where: str = "") -> DataFrame:
    """A table of a SQLite file, or its rows under a condition."""
    spark.dataSource.register(SQLiteTable)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions), where=where).load()
