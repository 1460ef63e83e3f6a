"""Literal cases of the text, vector, chunking, manifest, merge and file functions."""

import io
import re
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import chunking, graph, manifest, merge, recall, rows, stats
from tessera.plans import search
from tessera.sources import files
from tessera.streaming import folders


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, label", [
    ("本期审计发现若干问题", "审计发现"), ("内控存在缺陷", "内控缺陷"), ("关键控制点如下", "控制点"), ("风险评估", "风险点"), ("合规检查", "合规事项"), ("建议落实", "建议事项"),
    ("整改情况", "整改事项"), ("政策文件", "政策事项"), ("制度建立", "制度事项"), ("系统告警", "异常事项"), ("出现亏损", "损失事项"), ("违反规定", "违规事项"), ("今天天气很好", "一般事项"),
    ("An audit finding was raised", "audit_finding"), ("Our recommendation", "recommendation"), ("the guideline", "policy"), ("exposure", "risk"), ("hello there", "general"), ("", "general"), ("12345", "general"),
])
def test_categories(spark, text, label):
    assert one(spark, T.classify_category(F.lit(text))) == label


@pytest.mark.parametrize("name, kind", [("2024年3月15日", "time"), ("23%", "metric"), ("Acme Inc", "organization"), ("支付系统", "product"), ("Annual Report", "work"), ("风险", "subject"), ("招商银行", "organization")])
def test_entity_types(spark, name, kind):
    assert one(spark, T.infer_entity_type(F.lit(name))) == kind


def test_spans_have_types(spark):
    assert [one(spark, T.entity_type_of_span(F.lit(n))) for n in ("北京大学", "浙江省", "太湖", "张三", "x")] == ["organization", "location", "location", "person", None]


def test_entity_families(spark):
    got = {e["name"]: e["type"] for e in one(spark, T.named_entities(F.lit('The "quoted phrase" by Acme Group on 2024-03-15 cost $1,234,567.89 or 23%; 国发〔2024〕12号')))}
    assert got["quoted phrase"] == "subject" and got["2024-03-15"] in ("time", "work") and got["$1,234,567.89"] == "metric" and got["23%"] == "metric" and "国发〔2024〕12号" in got


def test_capitalised_names_end_where_ascii_words_end(spark):
    assert [e["name"] for e in one(spark, T.named_entities(F.lit("der Schpfö, Über Anna-Maria_ Group")))] == ["Schpf", "Anna", "Group"]


def test_event(spark):
    e = one(spark, T.extract_event(F.lit("doc"), F.lit("# Findings"), F.lit("An audit finding on Payment System. More text follows here.")))
    assert e["title"] == "Findings" and e["category"] == "audit_finding" and any(x["name"] == "Payment System" and x["type"] == "product" for x in e["entities"])


def test_text_functions(spark):
    assert one(spark, T.strip_markdown(F.lit("# Title\n**bold** `code` ![i](u) [link](u)\n```x\ny```"))) == "Title bold code link"
    assert one(spark, T.redact_paths(F.lit(r"at \\server\share\f.txt and C:\tmp"))) == "at [redacted-path] and [redacted-path]"
    assert one(spark, T.preview(F.lit("a  b\nc"), 3)) == "a b…"
    assert one(spark, T.conversation_title(F.lit("Please could you explain the plan for next year in detail now please?"))) == "the plan for next year in detail now"
    assert one(spark, T.conversation_title(F.lit("请问一下，年度审计报告怎么写？"))) == "年度审计报告怎么写"
    assert one(spark, T.conversation_title(F.lit("  "))) == "新对话"
    assert [one(spark, T.error_phase(F.lit(m))) for m in ("[fake-zip] x", "LLM failed", "?", None)] == ["[read]", "[ingest]", "[unknown]", "[unknown]"]
    assert [one(spark, T.is_garbled(F.lit(t))) for t in ("", "plain", "\ufffd" * 9 + "a" * 9, "E-SafeNet", "\x01\x02abc")] == [False, False, True, True, True]
    assert one(spark, T.normalize_lines(F.lit("\ufeffa\r\nb\rc  \n\n"))) == "a\nb\nc\n"
    assert one(spark, T.query_tokens(F.lit("年度 audit a"))) == ["年度", "audit", "年度 audit a"]
    assert one(spark, T.fixed_pieces(F.lit("abcde"), 2)) == ["ab", "cd", "e"]
    assert one(spark, T.decode_xml(F.lit("a &lt;b&gt; &amp;amp;"))) == "a <b> &amp;"
    assert one(spark, T.concise(F.lit("One. " * 200))) == "One. One. One."
    assert one(spark, T.first_sentence(F.lit("First one. Second."))) == "First one."


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, V.cosine(a(1, 0), a(1, 1, 1))) == 0 and one(spark, V.cosine(a(0, 0), a(1, 1))) == 0
    assert one(spark, V.cosine_shared(a(1, 0), a(1, 0, 5))) == 1
    assert one(spark, V.normalize(a(3, 4))) == [0.6, 0.8] and one(spark, V.normalize(a(0, 0))) == [0, 0]
    assert one(spark, V.literal(a(0.5, 1))) == "[0.50000000,1.00000000]"
    ties = a(0.001953125, 0.005859375, -0.001953125, -0.0, 5e-9, float("nan"), float("-inf"))  # printf of C: ties of the exact value to even
    assert one(spark, V.literal(ties)) == "[0.00195312,0.00585938,-0.00195312,-0.00000000,0.00000001,nan,-inf]"
    assert one(spark, V.literal(F.array(F.lit(1.0), F.lit(None)))) == "[1.00000000]" and one(spark, V.literal(F.lit(None).cast("array<double>"))) is None
    assert one(spark, V.parse(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, V.parse(F.lit("[1, null]"))) is None


def test_chunking(spark):
    docs = spark.createDataFrame([(1, "intro\n# Heading\n\nshort body\n## Two\nx"), (2, "\n\n".join("p" * 100 for _ in range(50))), (3, "  "), (4, "漢" * 2000)], "doc_id int, text string")
    got = {}
    for r in chunking.chunk(docs, max_tokens=300).collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["heading"], r["content"]))
    assert [x[1:] for x in sorted(got[1])] == [("Introduction", "intro"), ("Heading", "# Heading\nshort body"), ("Two", "## Two\nx")]
    assert len(got[2]) > 1 and all(len(c) < 3000 for _, _, c in got[2]) and "".join(c.replace("\n", "") for *_, c in sorted(got[2])) == "p" * 5000
    assert 3 not in got and "".join(c for *_, c in sorted(got[4])) == "漢" * 2000 and all(len(c) <= 450 for *_, c in got[4])
    packs = chunking.paragraph_packs(docs.where("doc_id = 2"), 300).collect()
    assert "\n\n".join(r["content"] for r in sorted(packs, key=lambda r: r["rank"])) == docs.where("doc_id = 2").first()["text"]


def test_sections_and_packs_against_brute_force(spark):
    texts = ["", "# a", "x\n## b \n\ny\n#c\n###### d\n", "\r\n# e\r\nz", None, "\n".join(f"# {i}" if i % 7 == 0 else "w" * (i % 90) for i in range(3000))]

    def cut(text):
        out = [["Introduction", []]]
        for line in (text or "").replace("\r\n", "\n").split("\n"):
            m = re.match(chunking.HEADING, line)
            out.append([m[2].strip(), [line]]) if m else out[-1][1].append(line)
        made = [(h, b[0] if h != "Introduction" or b and re.match(chunking.HEADING, b[0]) else None, b) for h, b in out]
        joined = [(h, "\n".join(x for x in ([first, "\n".join(b[1:]).strip()] if first else ["\n".join(b).strip()]) if x).strip()) for h, first, b in made]
        return [x for x in joined if x[1]]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.heading_sections(docs).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append((r["heading"], r["content"]))
    assert got == {i: cut(t) for i, t in enumerate(texts) if cut(t)}
    sizes = [[], [5], [400, 1], [i * 37 % 120 for i in range(2500)]]

    def packed(ns):
        total, pack, out = 0, -1, []
        for n in ns:
            pack, total = (pack + 1, n) if pack < 0 or total + n > 300 else (pack, total + n)
            out.append(pack)
        return out

    got = spark.createDataFrame(list(enumerate(sizes)), "i int, n array<int>").select("i", chunking.pack(F.col("n"), 300).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {i: packed(n) for i, n in enumerate(sizes)}


def test_manifest_diff(spark):
    kind = "rel_path string, size_bytes bigint, mtime_ms bigint, inode bigint, sha1 string, last_event string"
    old = spark.createDataFrame([("same", 1, 1, 1, "a", "synced"), ("hash", 1, 1, 1, "a", "synced"), ("gone", 1, 1, 1, "a", "synced"), ("bare", None, None, None, None, "failed"), ("time", 1, 1, 1, None, "synced"), ("kept", 1, 1, 1, None, "synced"), ("dead", 1, 1, 1, "a", "deleted")], kind)
    new = spark.createDataFrame([("same", 1, 2, 2, "a"), ("hash", 1, 1, 1, "b"), ("bare", 1, 1, 1, "a"), ("time", 1, 2, 1, "x"), ("kept", 1, 1, 1, "x"), ("new", 1, 1, 1, "a")], kind.rsplit(",", 1)[0])
    assert {tuple(r) for r in manifest.diff(old, new).collect()} == {("hash", "updated"), ("gone", "deleted"), ("bare", "updated"), ("time", "updated"), ("new", "added")}
    assert ("gone", "deleted") not in {tuple(r) for r in manifest.diff(old, new, ignore=F.col("rel_path") == "gone").collect()}
    assert {r["rel_path"]: r["sha1"] for r in manifest.reuse_hashes(old, new).collect()}["hash"] == "a"


def test_manifest_states(spark):
    df = spark.createDataFrame([("a", "pending", "e"), ("b", None, None), ("c", "synced", "e")], "rel_path string, last_event string, last_error string")
    after, moved = manifest.transition(df, "syncing")
    assert {r[0]: r[1] for r in after.collect()} == {"a": "syncing", "b": "syncing", "c": "synced"} and moved.count() == 2
    again, none = manifest.transition(after, "syncing")
    assert none.count() == 0
    assert {tuple(r) for r in manifest.reset_for_retry(df).collect()} == {("a", "pending", "e"), ("b", None, None), ("c", "pending", None)}
    meta = spark.sql("select map('a', '1', 'b', '2') m, map('b', '3') n")
    assert meta.select(manifest.merge_metadata(F.col("m"), F.col("n"))).first()[0] == {"a": "1", "b": "3"}
    assert meta.select(manifest.set_attribute(F.col("m"), "a", None)).first()[0] == {"b": "2"}
    locks = spark.sql("select * from values ('a', 'pending', timestamp_ntz'2024-01-01 00:00:00'), ('b', 'pending', null), ('c', 'pending', timestamp_ntz'2024-01-01 00:09:00'), ('d', 'synced', null) t(id, status, locked_at)")
    assert [r["id"] for r in manifest.claim(locks, 5, F.expr("timestamp_ntz'2024-01-01 00:10:00'")).collect()] == ["a", "b"]


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, v int")
    keys, seen, after = [("v", True), ("id", True)], [], None
    while True:
        page = rows.keyset_page(df, keys, 6, after).collect()
        seen += [r["id"] for r in page]
        cursor = rows.next_cursor(page, keys, 6)
        if cursor is None:
            break
        after = rows.decode_cursor(cursor)
    assert seen == [r["id"] for r in df.orderBy(F.col("v").desc(), F.col("id").desc()).collect()]
    assert [rows.clamp(v, 1, 50, 50) for v in (None, 0, 7, 99)] == [50, 1, 7, 50]


def test_merge(spark):
    ours = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, t int, v string")
    theirs = spark.createDataFrame([("a", 1, "t"), ("b", 6, "t"), ("c", 0, "t")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in merge.last_writer_wins(ours, theirs, ["k"], "t").collect()} == {("a", "o"), ("b", "t"), ("c", "t")}


def test_graph_and_search(spark):
    links = spark.createDataFrame([("e1", "x"), ("e2", "x"), ("e2", "y"), ("e3", "y"), ("e4", "z")], "event_id string, entity_id string")
    seeds = spark.createDataFrame([("x",)], "entity_id string")
    assert {tuple(r) for r in graph.expand_fixed(seeds, links, 5).collect()} == {("e1", 1), ("e2", 1), ("e3", 2)}
    assert {r["event_id"] for r in graph.expand_until(seeds, links, 3).collect()} == {"e1", "e2", "e3"}
    with pytest.raises(ValueError):
        search.search("other")
    got = one(spark, recall.rerank_response(F.lit('[{"index":2,"relevance_score":0.1},{"index":0},{"index":9,"relevance_score":1}]'), F.lit(3)))
    assert [r["index"] for r in got] == [2, 0]


def test_stats(spark):
    runs = spark.createDataFrame([(1, 2, 3, "partial"), (1, 0, 0, "completed")], "stats_added int, stats_updated int, stats_deleted int, status string")
    assert tuple(stats.run_totals(runs).first()) == (2, 2, 3, 1)
    assert [one(spark, stats.progress(F.lit(d), F.lit(t))) for d, t in ((0, 0), (1, 3), (9, 3))] == [-1, 33, 100]


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.txt").write_bytes("漢字\r\nx".encode("gb18030"))
    (tmp_path / "b.csv").write_text('h1,h2\n"a|b",1\nc\n')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "p.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>S{n}</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p></p>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.list_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.convert(found).collect()}
    assert got["b.csv"]["text"] == "| h1 | h2 |\n| --- | --- |\n| a\\|b | 1 |\n| c |  |\n"
    assert got["d.docx"]["text"] == "# Top\n\nBody\n" and got["p.pptx"]["text"] == "## S2\n\n- point\n\n## S10\n\n- point\n" and got["s.xlsx"]["text"] == "## One\n\n| name |  | 3 |\n| --- | --- | --- |\n"
    assert got["bad.docx"]["text"] is None and got["a.txt"]["text"] == "漢字\nx\n"
    kinds = {r["path"].rsplit("/", 1)[1]: r["fake"] for r in found.select("path", files.is_fake(F.col("path"), F.col("content")).alias("fake")).collect()}
    assert kinds["bad.docx"] and not kinds["d.docx"]
    paths = spark.createDataFrame([("a/~$x.docx",), (".gitignore",), ("a.tar.gz",), ("x/node_modules/y.md",), ("ok/A.MD",)], "p string")
    able = paths.where(files.included(F.col("p"), ["md", ".gz"]) & ~files.excluded(F.col("p"))).collect()
    assert {r["p"] for r in able} == {"a.tar.gz", "ok/A.MD"}
    assert {r["dir"] for r in files.watch_targets(paths.select(F.lit("a/b/c.md").alias("path"))).collect()} == {"a", "a/b"}
    assert [one(spark, files.sha1(F.lit(t))) for t in ("hello world", "")] == ["2aae6c35c94fcfb415dbe95f408b9ce91ee846ed", "da39a3ee5e6b4b0d3255bfef95601890afd80709"]
    runs = spark.createDataFrame([(1, 5.0, 10.02, "b"), (1, 1.0, 10.0, "a"), (1, 0.0, 3.0, "c")], "page int, x double, y double, str string")
    assert [r["text"] for r in files.lines_of_runs(runs).orderBy("line").collect()] == ["a b", "c"]


def test_stream_upserts_and_debounces(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "table"
    source.mkdir()
    (source / "1.json").write_text('{"k": "a", "n": 1}\n{"k": "a", "n": 2}\n{"k": "b", "n": 1}\n')
    stream = spark.readStream.schema("k string, n int").json(str(source))
    run = lambda: folders.upsert_stream(stream, str(target), ["k"], [F.col("n").desc()], str(tmp_path / "cp"), ["n"], buckets=4).trigger(availableNow=True).start()
    assert folders.folded(spark, str(target)) is None
    run().awaitTermination()
    for i, lines in enumerate(('{"k": "b", "n": 7}\n{"k": "c", "n": 1}\n', '{"k": "c", "n": 3}\n', "")):
        (source / f"{i + 2}.json").write_text(lines)
        told = run()
        told.awaitTermination()
        assert all(p["ms"] for p in folders.progress(told))
    assert {tuple(r) for r in folders.folded(spark, str(target)).collect()} == {("a", 2), ("b", 7), ("c", 3)}
    log = folders._Log(spark, str(target)).newest()
    kept = {str(p.relative_to(target)) for p in target.glob("v=*/__bucket=*")}
    assert kept >= set(log["parts"].values()) and kept <= set(log["parts"].values()) | set(log["replaced"])
    bursts = spark.sql("select * from values ('f', timestamp'2024-01-01 00:00:00'), ('f', timestamp'2024-01-01 00:00:00.5'), ('f', timestamp'2024-01-01 00:00:05') t(f, at)")
    assert sorted(r["n"] for r in folders.debounce(bursts, "f", "at").collect()) == [1, 2]


def test_embedding_fallback(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    got = dict(folders.embed_batches(spark.createDataFrame([("1", "xy"), ("2", "bad")], "chunk_id string, text string").coalesce(1), embed).collect())
    assert got == {"1": [2.0], "2": None}
    got = dict(folders.embed_batches(spark.createDataFrame([("1", "a bad one"), ("2", None), ("3", "x " * 400)], "chunk_id string, text string").coalesce(1), embed, dimension=2, count=lambda t: len(t.split())).collect())
    assert got == {"1": [0.0, 0.0], "2": [0.0], "3": [200.0]}
    assert folders.within_tokens("x " * 800, lambda t: len(t.split())).split() == ["x"] * 510
    chunks = spark.sql("select * from values (1, 'h', 'good', 'pending', null), (2, 'h', 'bad', 'pending', null), (3, 'h', 'late', 'pending', timestamp'2024-01-01 00:09:00'), (4, 'h', 'more', 'pending', null) t(id, heading, content, status, locked_at)")
    vectors, after = folders.embed_round(chunks, embed, 2, F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert [(r["id"], r["embedding"]) for r in vectors.collect()] == [(1, [6.0])]
    assert {(r["id"], r["status"], r["locked_at"] is None) for r in after.collect()} == {(1, "embedded", True), (2, "failed", True), (3, "pending", False), (4, "pending", True)}


def test_breaker_and_single_flight():
    now = [0.0]
    b = folders.Breaker(cooldown=10, clock=lambda: now[0])
    asked = []

    def bad():
        asked.append(now[0])
        raise RuntimeError("no")

    assert [b.call(bad, lambda: "other") for _ in range(5)] == ["other"] * 5 and len(asked) == 3 and b.is_open
    now[0] = 10
    assert b.call(bad, lambda: "other") == "other" and len(asked) == 4 and b.is_open
    now[0] = 20
    assert b.call(lambda: "fine", lambda: "other") == "fine" and not b.is_open and b.failures == 0

    flights, begun, go, runs = folders.SingleFlight(), threading.Event(), threading.Event(), []

    def work():
        runs.append(1)
        begun.set()
        go.wait(10)
        return "done"

    got = []
    first = threading.Thread(target=lambda: got.append(flights.do("k", work)))
    first.start()
    begun.wait(10)
    others = [threading.Thread(target=lambda: got.append(flights.do("k", work))) for _ in range(3)]
    for t in others:
        t.start()
    while not all(t.is_alive() for t in others):
        pass
    go.set()
    for t in (first, *others):
        t.join(10)
    assert got == ["done"] * 4
    with pytest.raises(RuntimeError):
        flights.do("k", bad)
    assert flights.do("k", lambda: 1) == 1


def test_lists_of_csv_cells():
    assert files.parse_csv('a,"b ""q"", c"\r\n"x\ny",z') == [["a", 'b "q", c'], ["x\ny", "z"]]
    assert files.sniff_delimiter("a;b;c\n") == ";" and files.sniff_delimiter("a\tb,c\n") == "\t"
    assert "3 more rows omitted" in files.markdown_table([["h"], *[[str(i)] for i in range(5)]], max_rows=2)


def test_names_of_a_long_text_are_ranked_in_the_time_of_its_length(spark):
    """6,000 distinct names: each find is looked at once, not once for every name."""
    body = "; ".join(f"Name{i}x" for i in range(6000)) + "; Name5x; API-key"
    began = time.monotonic()
    got = [(r["name"], r["type"], r["score"]) for r in one(spark, T.named_entities(F.lit(body).substr(F.lit(1), F.col("id").cast("int") + len(body))))]
    assert got[0] == ("Name5x", "subject", 4.0) and len(got) == 20 and time.monotonic() - began < 20


def test_sentences_are_split_once(spark, tmp_path):
    from tessera.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "a. b\n\nc"), (2, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["sentence_split"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r["doc_id"]: r["pieces"] for r in got.collect()} == {1: 3, 2: 1}
