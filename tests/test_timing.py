"""Rows and times of stages and batches; pages, sources, settings."""

from pyspark.sql import functions as F

from tessera.plans import q_details, search
from tessera.plans.timing import Stages, listening

SF = "/root/testdata/sf0.001"


def test_stages_of_a_search(spark):
    """Rows of each stage, counted while it ran, are those of the trace."""
    stages = Stages()
    _, trace = search.multi_search(**q_details._searchable(spark, SF), top_k=10, stages=stages)
    counts = {r["stage"]: r["count"] for r in trace.groupBy("stage").count().collect()}
    told = {r["stage"]: (r["rows"], r["ms"]) for r in stages.table(spark).collect()}
    assert list(told) == ["entities", "seeds", "coarse", "rerank"]
    assert {s: told[s][0] for s in ("coarse", "rerank")} == {s: counts[s] for s in ("coarse", "rerank")}
    assert told["seeds"][0] >= counts["title"] and all(ms > 0 for _, ms in told.values())


def test_own_metrics_of_a_stage(spark):
    stages = Stages()
    assert stages.kept(spark.range(10), "ten", most=F.max("id")).count() == 10
    assert stages.done[0] | {"ms": 0} == {"stage": "ten", "ms": 0, "rows": 10, "most": 9}


def test_batches_of_streams(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    with listening(spark) as heard:
        stream.writeStream.queryName("ids").format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        for _ in range(100):
            if len(heard.batches) >= 3 and heard.ended:
                break
            __import__("time").sleep(0.1)
    told = [b for b in heard.batches if b["rows"]]
    assert [b["rows"] for b in told] == [5, 5, 5] and [b["query"] for b in told] == ["ids"] * 3
    assert sorted(b["metrics"]["seen"]["most"] for b in told) == [4, 14, 24] and all(b["ms"]["triggerExecution"] > 0 for b in told)
    assert list(heard.ended.values()) == [None]


def test_pages(spark):
    from tessera.operators import pages
    from tessera.operators.rows import encode_cursor

    df = spark.createDataFrame([("f", i, f"p{i:02}", "deleted" if i % 5 == 0 else "synced", i) for i in range(23)], "folder_id string, last_seen_at int, rel_path string, last_event string, document_id int")
    events = spark.createDataFrame([(1, "regex-fallback"), (1, None), (2, "llm"), (99, "llm")], "document_id int, extraction_source string")
    ids = lambda got: [r["document_id"] for r in got.rows.orderBy("rel_path").collect()]
    first = pages.manifest_page(df, events, "f", sort="path", limit=7)
    assert ids(first) == [1, 2, 3, 4, 6, 7, 8] and (first.total, first.prev_offset, first.limit) == (18, None, 7)
    assert {r["document_id"]: (r["event_count"], r["fallback_event_count"]) for r in first.rows.where("document_id < 4").collect()} == {1: (2, 1), 2: (1, 0), 3: (0, 0)}
    second = pages.manifest_page(df, events, "f", sort="path", limit=7, cursor=first.next_cursor, offset=3)
    assert ids(second) == [9, 11, 12, 13, 14, 16, 17] and second.offset == 0
    last = pages.manifest_page(df, events, "f", sort="path", limit=7, cursor=second.next_cursor)
    assert ids(last) == [18, 19, 21, 22] and last.next_cursor is None
    recent = pages.manifest_page(df, events, "f", limit=0, include_total=False)
    assert ids(recent) == [22] and recent.total is None and recent.limit == 1
    assert ids(pages.manifest_page(df, events, "f", status="deleted")) == [0, 5, 10, 15, 20]
    assert pages.manifest_page(df, events, "f", include_deleted=True).total == 23 and ids(pages.manifest_page(df, events, "g")) == []
    for bad in ("", "???", "bm90IGpzb24", encode_cursor(other=1), first.next_cursor):  # the last is of another sort mode
        assert ids(pages.manifest_page(df, events, "f", cursor=bad, limit=2)) == [21, 22]
    back = pages.manifest_page(df, events, "f", sort="path", limit=5, offset=12)
    assert (back.offset, back.prev_offset) == (12, 7)


def test_missing_sources_are_told_with_alternatives(spark):
    import pytest

    from tessera.operators import rows

    sources = spark.createDataFrame([(f"s{i:02}", "t" if i % 2 else "u", f"n{i}", i, "x" if i == 24 else None) for i in range(25)], "id string, tenant_id string, name string, created_at int, archived_at string")
    want = spark.createDataFrame([("s03",), ("gone",), ("s24",)], "id string")
    with pytest.raises(ValueError, match=r"not found: gone, s24\. Live sources, newest first: s23 \(n23\); s22 \(n22\)") as told:
        rows.require_sources(want, sources)
    assert str(told.value).count(";") == 9
    with pytest.raises(ValueError, match="no live source"):
        rows.require_sources(want, sources, "nobody")
    assert rows.require_sources(want.where("id = 's03'"), sources, "t") is None


def test_imported_logs(spark):
    from tessera.operators import merge

    logs = spark.createDataFrame([(i, f"own{i}", i) for i in range(1, 8)], "seq bigint, id string, at bigint")
    seen = spark.createDataFrame([("a", 1), ("b", 2)], "id string, at bigint")
    incoming = spark.createDataFrame([("c", 10), ("a", 11), ("d", 12), ("c", 13), ("e", 14)], "id string, at bigint")
    ring, memory = merge.import_logs(logs, seen, incoming, most=6, remembered=4)
    assert sorted(tuple(r) for r in ring.collect()) == [(5, "own5", 5), (6, "own6", 6), (7, "own7", 7), (8, "c", 10), (9, "d", 12), (10, "e", 14)]
    assert sorted(r["id"] for r in memory.collect()) == ["b", "c", "d", "e"]
    ring, _ = merge.import_logs(logs.where("false"), memory, spark.createDataFrame([("a", 20), ("e", 21)], "id string, at bigint"), 6, 4)
    assert [tuple(r) for r in ring.collect()] == [(1, "a", 20)]


def test_settings(spark):
    from tessera.operators import ingest

    kind = "tenant_id string, model string, embedding_api_key string, llm_api_key string, metadata map<string,string>"
    old = spark.createDataFrame([("t", "m1", "e1", "l1", {"a": "1", "b": "2"}), ("u", "m", "e", "l", None)], kind)
    new = spark.createDataFrame([("t", None, "e2", None, {"b": "3"}, True, False), ("v", "mv", "ev", "lv", {"x": "y"}, True, True)], kind + ", keep_embedding_api_key boolean, keep_llm_api_key boolean")
    got = {r["tenant_id"]: tuple(r)[1:] for r in ingest.upsert_settings(old, new).collect()}
    assert got == {"t": (None, "e1", None, {"a": "1", "b": "3"}), "u": ("m", "e", "l", None), "v": ("mv", "ev", "lv", {"x": "y"})}


def test_word_tables_and_lists():
    import io
    import zipfile

    from tessera.sources import files

    p = lambda text, about="": f"<w:p><w:pPr>{about}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda text, depth: p(text, f'<w:numPr><w:ilvl w:val="{depth}"/></w:numPr>')
    cell = lambda *ps: "<w:tc>" + "".join(map(p, ps)) + "</w:tc>"
    body = p("Title", '<w:pStyle w:val="Heading2"/>') + p("one") + item("a", 0) + item("b", 1) + p("two") + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('x', 'y')}{cell('a|b')}</w:tr></w:tbl>" + p("") + p("end")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    assert files.docx_markdown(raw.getvalue()) == "## Title\n\none\n\n- a\n  - b\n\ntwo\n\n| h1 | h2 |\n| --- | --- |\n| x y | a\\|b |\n\nend\n"
