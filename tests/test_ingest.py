"""Model answers, stand-ins, ingest and sessions."""

import json

from pyspark.sql import functions as F

from tessera.functions import model_output as M
from tessera.operators import ingest as I


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_repairs():
    load = lambda t: None if (r := M.repaired(t)) is None else json.loads(r)
    assert load('{"a": 1}') == {"a": 1}
    assert load('```json\n{"a": [1, 2,]}\n```') == {"a": [1, 2]}
    assert load('{"a": "line\nbreak"}') == {"a": "line\nbreak"}
    assert load('{"a": [1, {"b": "cut off') == {"a": [1, {"b": "cut off"}]}
    assert load('{"a": 1, "b": {"c": 2}, "d') == {"a": 1, "b": {"c": 2}}
    assert load("no json") is None and load("") is None and load(None) is None


def test_columns(spark):
    assert one(spark, M.strip_thinking(F.lit('<think>x\ny</think> ```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, M.repair_json(F.lit('{"a": 1,'))) == '{"a": 1}'
    tags = [("B-PER", "马", 0.9), ("I-PER", "##云", 0.9), ("B-PER", "张", 0.9), ("E-PER", "勇", 0.9), ("O", "在", 0.9), ("S-LOC", "沪", 0.9), ("I-ORG", "孤", 0.9), ("B-PER", "弱", 0.1), ("B-PER", "马", 0.9), ("I-PER", "云", 0.9)]
    df = spark.createDataFrame([(tags,)], "t array<struct<entity:string,word:string,score:double>>")
    assert df.select(M.merge_spans(F.col("t"))).first()[0] == ["马云", "张勇", "沪", "孤"]
    vec = one(spark, M.pseudo_embedding(F.lit("a"), 5))
    h = ((0x811C9DC5 ^ 97) * 0x01000193) & 0xFFFFFFFF
    assert vec == [((h ^ (h >> (i * 31 % 32 % 4 * 8))) & 255) / 127.5 - 1 for i in range(5)]
    assert one(spark, M.key_fingerprint(F.lit("k"))) == one(spark, M.key_hash(F.lit("k")))[:12]


def test_ingest_shares_entities(spark):
    docs = spark.createDataFrame([("d1", "T", "# One\nAn audit finding on Payment System.\n# Two\nagain the Payment System, by Acme Group.")], "doc_id string, title string, text string")
    got = {k: v.collect() for k, v in I.ingest(docs).items()}
    assert len(got["chunks"]) == 2 and len(got["events"]) == 2
    shared = [e["entity_id"] for e in got["entities"] if e["name"] == "Payment System"]
    assert len(shared) == 1 and sum(l["entity_id"] == shared[0] for l in got["links"]) == 2
    assert {l["entity_id"] for l in got["links"]} <= {e["entity_id"] for e in got["entities"]}


def test_projects_and_sessions(spark):
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    members = spark.createDataFrame([("p", "s1", "folder", True), ("p", "s2", "folder", False), ("p", "s3", "upload", False)], "project_id string, source_id string, source_type string, enabled boolean")
    documents = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3), ("s3", 4)], "source_id string, doc_id int")
    assert dict(I.cached_stats(projects, members, documents).collect()) == {"p": 3, "q": 0}
    folders = spark.createDataFrame([("f", '{"projectId":"p"}'), ("g", "{}")], "source_id string, metadata string")
    assert {tuple(r) for r in I.project_sources(projects, folders).collect()} == {("p", "p"), ("q", "q"), ("p", "f")}
    sessions = spark.createDataFrame([("a", ["s1"], 3), ("b", ["s2"], 2), ("c", ["s1"], 1)], "session_id string, source_ids array<string>, updated_at int")
    assert [r["session_id"] for r in I.sessions_on(sessions, ["s1", "s9"], 2).collect()] == ["a"]
    assert [one(spark, I.upload_problem(F.lit(n), F.lit(c), 5)) for n, c in (("a.md", "x"), ("a.pdf", "x"), ("a.txt", "xxxxxx"), ("a.txt", "  "))] == [None, "only .md and .txt", "too large", "empty"]
    entities = spark.createDataFrame([("n", ""), ("m", "kept")], "name string, description string")
    new = spark.createDataFrame([("n", "filled"), ("m", "lost"), ("o", "new")], "name string, description string")
    assert dict(I.fill_entity(entities, new, ["name"]).collect()) == {"n": "filled", "m": "kept", "o": "new"}
