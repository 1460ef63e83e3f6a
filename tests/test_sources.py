"""Trees, change streams, readers and SQLite files."""

import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import manifest, merge
from tessera.sources import readers, sqlite, tree


def _write(root, files):
    for name, text in files.items():
        path = f"{root}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def test_excluded_directories_are_never_entered(spark, tmp_path):
    root = str(tmp_path / "r")
    _write(root, {"a.md": "1", "b.TXT": "22", "x.bin": "3", "n/one.md": "4", "n/deep/er/two.md": "5", "n/.git/objects/aa/o.md": "6", "node_modules/p/q/r.md": "7", "skip/me/s.md": "8", "Target/t.md": "9"})
    os.symlink(f"{root}/n", f"{root}/loop")
    os.symlink(f"{root}/a.md", f"{root}/link.md")
    os.mkdir(f"{root}/empty")
    files, entered = tree.list_tree(spark, root, ["md", ".txt"], ("SKIP",), width=3)
    rel = lambda p: p.removeprefix(root).lstrip("/")
    got = {rel(r["path"]): (r["size_bytes"], r["inode"]) for r in files.collect()}
    assert got == {p: (os.stat(f"{root}/{p}").st_size, os.stat(f"{root}/{p}").st_ino) for p in ("a.md", "b.TXT", "n/one.md", "n/deep/er/two.md")}
    assert sorted(rel(r["dir"]) for r in entered.collect()) == ["", "empty", "n", "n/deep", "n/deep/er"]
    flat, entered = tree.list_tree(spark, f"file://{root}", None, recursive=False)
    assert {r["name"] for r in flat.collect()} == {"a.md", "b.TXT", "x.bin"} and entered.count() == 1
    assert tree.list_tree(spark, f"{root}/not there")[0].collect() == []


@pytest.mark.parametrize("buckets", [1, 5])
def test_changes_of_a_folder(spark, tmp_path, buckets):
    """Adds, changes and deletions over restarts; the same rows as the diff of two listings; a repeated batch returns its rows again."""
    root, out = str(tmp_path / "r"), str(tmp_path / "out")
    names = ["a.md", "d/b.md", "d/e/c.md", "d/e/f/g.md", "h/i.md"]
    _write(root, dict.fromkeys(names, "1"))
    _write(root, {"node_modules/x.md": "1", "z.bin": "1"})

    def run():
        changes = tree.watch_changes(spark, root, f"{tmp_path}/snaps", extensions="md", buckets=buckets, interval_ms=1)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    listed = lambda: tree.list_tree(spark, root, ["md"])[0].selectExpr(f"substring(path, {len(root) + 2}) as rel_path", "size_bytes", "mtime_ms", "inode").withColumn("sha1", F.lit(None).cast("string"))
    run()
    seen = lambda: {(r["version"], r["change"], r["rel_path"]) for r in spark.read.schema(tree.CHANGE).parquet(out).collect()}
    first = seen()
    assert {(c, p) for _, c, p in first} == {("added", p) for p in names}
    before = spark.createDataFrame([tuple(r) for r in listed().collect()], "rel_path string, size_bytes bigint, mtime_ms bigint, inode bigint, sha1 string").withColumn("last_event", F.lit("synced"))
    time.sleep(0.01)
    _write(root, {"d/b.md": "changed", "new/n.md": "1"})
    os.remove(f"{root}/d/e/c.md")
    os.rename(f"{root}/h/i.md", f"{root}/h/j.md")
    run()
    second = {(c, p) for _, c, p in seen() - first}
    assert second == {("updated", "d/b.md"), ("added", "new/n.md"), ("deleted", "d/e/c.md"), ("deleted", "h/i.md"), ("added", "h/j.md")}
    assert second == {(r["change"], r["rel_path"]) for r in manifest.diff(before, listed()).collect()}
    run()
    assert len(seen()) == len(names) + 5  # nothing changed
    reader = tree.FolderChangesReader({"path": root, "snapshots": f"{tmp_path}/other", "buckets": str(buckets), "interval_ms": "1"})
    start = reader.latestOffset()
    for p in reader.partitions({"look": 0}, start):
        list(reader.read(p))
    os.remove(f"{root}/a.md")
    time.sleep(0.01)
    end = reader.latestOffset()
    again = [[sorted(reader.read(p)) for p in reader.partitions(start, end)]]
    _write(root, {"late.md": "1"})
    again.append([sorted(reader.read(p)) for p in reader.partitions(start, end)])
    assert again[0] == again[1] and [r[:2] for part in again[0] for r in part] == [("deleted", "a.md")]
    reader.commit(end)
    assert os.listdir(f"{tmp_path}/other") == [str(end["look"])]


MODULE = """
from tessera.sources.readers import Reader

class Low(Reader):
    extensions, priority = (".log", ".md"), 1
    def read(self, path, content):
        return "low " + content.decode()

class High(Reader):
    extensions, priority = (".log",), 5
    def probe(self, path, head):
        return head.startswith(b"H")
    def read(self, path, content):
        if b"broken" in content:
            raise RuntimeError("cannot read")
        return "high " + content.decode()
"""


def test_readers_by_priority_probe_and_failure(spark, tmp_path, monkeypatch):
    (tmp_path / "own_readers.py").write_text(MODULE)
    spark.sparkContext.addPyFile(str(tmp_path / "own_readers.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    rows = [("/x/a.log", b"Hello"), ("/x/b.log", b"other"), ("/x/c.log", b"H broken"), ("/x/d.md", b"note"), ("/x/e.txt", "\u00e9".encode() + b"\r\nz"), ("/x/f.txt", b"\xff\xfe\x00"), ("/x/g", b"?"), ("/x/h.docx", b"no zip"), ("/x/i.csv", b"a;b\n1;2\n"), ("/x/j.txt", None)]
    found = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"][3:]: r for r in readers.read_files(found, ("own_readers:Low", "own_readers:High")).collect()}
    assert (got["a.log"]["text"], got["a.log"]["reader"]) == ("high Hello\n", "own_readers:High") or got["a.log"]["text"].strip() == "high Hello"
    assert got["b.log"]["reader"] == "own_readers:Low" and got["b.log"]["errors"] == []
    assert got["c.log"]["text"].startswith("low H broken") and "RuntimeError: cannot read" in got["c.log"]["errors"][0]
    assert got["d.md"]["reader"] == "own_readers:Low"  # before the built-in one
    assert got["e.txt"]["text"].startswith("\u00e9\nz") and got["e.txt"]["reader"] == "tessera.sources.readers:Text"
    assert got["f.txt"]["text"] is None and "neither UTF-8 nor GB18030" in got["f.txt"]["errors"][0]
    assert got["g"]["errors"] == ["no reader for files without extension"] and got["h.docx"]["errors"] == ["no reader for .docx"]
    assert got["i.csv"]["text"].startswith("| a | b |") and got["j.txt"]["text"] is not None
    cut = readers.read_one("a.md", b"x" * 50, readers.loaded(readers.BUILT_IN), 10)
    assert cut[0].startswith("x" * 10 + "\n\n*(truncated: 50 characters")


def test_many_rows_of_a_delimited_file(spark):
    raw = "\n".join(["a,b"] + [f"{i},x" for i in range(60_000)]).encode()
    text, reader, errors = readers.read_one("/x/a.csv", raw, readers.loaded(readers.BUILT_IN))
    assert text.count("\n") == 2 + 50_000 + 1 and "10000 more rows omitted" in text and not errors


def _sqlite(path, tables):
    db = sqlite3.connect(path)
    for name, (ddl, rows) in tables.items():
        db.execute(f'CREATE TABLE "{name}" ({ddl})')
        db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(rows[0]))})', rows)
    db.commit()
    db.close()


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "d.db")
    rows = [(i, f"n{i}", i / 2, bytes([i % 256]), None if i % 7 else 1) for i in range(1, 501)] + [(10_000, "far", 1.5, b"", 2), (10_001, 7, "odd", None, None)]
    _sqlite(path, {"odd name": ("id INTEGER PRIMARY KEY, name TEXT, x REAL, raw BLOB, k INT", rows), "none": ("a INTEGER", [(None,)])})
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
    db.execute("DELETE FROM none")
    db.commit()
    db.close()
    df = sqlite.read_sqlite(spark, path, "odd name", 4)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary", "bigint"] and df.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in df.select("id", "name", "x", "k").collect()} == {(i, str(n), x if type(x) is float else None, k) for i, n, x, _, k in rows}
    assert sorted(r["id"] for r in df.where("id > 495 and x < 249.5 and k is null").collect()) == [496, 498]
    assert sorted(r["id"] for r in df.where("id in (3, 10000) or name = 'n9'").collect()) == [3, 9, 10_000]
    assert df.where("x is null").select("id").collect()[0]["id"] == 10_001
    assert df.count() == len(rows)  # after filtered reads of the same frame
    assert {r["id"] for r in sqlite.read_sqlite(spark, path, "odd name", 3, "id < 3 OR name = 'n9'").collect()} == {1, 2, 9}
    assert sqlite.read_sqlite(spark, path, "keyed").count() == 2 and sqlite.read_sqlite(spark, path, "none").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, path, "missing").count()


def test_stores_merge_from_a_file_as_from_tables(spark, tmp_path):
    docs = [(1, "a", 5, None), (2, "b", 9, None), (3, "c", 1, None)]
    ours = {"documents": spark.createDataFrame(docs, "id bigint, rel_path string, updated_at bigint, archived_at string"), "events": spark.createDataFrame([(1, 1)], "id bigint, document_id bigint"), "chunks": spark.createDataFrame([(1, 1)], "id bigint, document_id bigint"), "entities": spark.createDataFrame([(1, "x", "t")], "id bigint, name string, type string"), "links": spark.createDataFrame([(1, 1)], "event_id bigint, entity_id bigint")}
    theirs = {"documents": ("id INTEGER PRIMARY KEY, rel_path TEXT, updated_at INTEGER, archived_at TEXT", [(7, "a", 6, None), (8, "d", 2, None), (9, "b", 3, None)]), "events": ("id INTEGER PRIMARY KEY, document_id INTEGER", [(5, 7), (6, 8), (7, 9)]), "chunks": ("id INTEGER PRIMARY KEY, document_id INTEGER", [(5, 7), (6, 8)]), "entities": ("id INTEGER PRIMARY KEY, name TEXT, type TEXT", [(3, "x", "t"), (4, "y", "t")]), "links": ("event_id INTEGER, entity_id INTEGER", [(5, 3), (6, 4)])}
    path = str(tmp_path / "theirs.db")
    _sqlite(path, theirs)
    tables = {n: spark.createDataFrame(rows, ", ".join(f"{c.split()[0]} {'string' if 'TEXT' in c else 'bigint'}" for c in ddl.split(", "))) for n, (ddl, rows) in theirs.items()}
    attached = {n: sqlite.read_sqlite(spark, path, n, 2) for n in theirs}
    told = lambda got: {n: sorted(map(str, got[n].collect())) for n in theirs}
    assert told(merge.merge_stores(ours, attached)) == told(merge.merge_stores(ours, tables))
