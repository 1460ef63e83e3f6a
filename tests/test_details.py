"""Literal cases of lookups, answers of models, paths and delimited files."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import model_output as M
from tessera.operators import details, graph
from tessera.sources import files


def test_default_entity_type(spark):
    types = spark.createDataFrame([("a", "person", True, False), ("b", "person", True, True), ("c", "subject", True, False), ("d", "time", False, True)], "id string, type string, is_active boolean, is_default boolean")
    assert [details.default_entity_type(types, t) for t in ("person", "time", "subject")] == ["b", "c", "c"]
    with pytest.raises(LookupError):
        details.default_entity_type(types.where("id = 'd'"), "time")


def test_answers_of_a_model(spark):
    rows = [("ok answer", "x", False), ("", "x", False), ("一二三四五六七八九", "x", False), ("four words of english", "x", True), ("中文", "x", True)]
    df = spark.createDataFrame(rows, "value string, fallback string, chinese boolean")
    got = [tuple(r) for r in df.select(M.answer_text(F.col("value"), F.col("fallback"), F.col("chinese")), M.answer_category(F.col("value"), F.col("chinese"))).collect()]
    assert got == [("ok answer", "ok answer"), ("x", "general"), ("x", "general"), ("x", "一般事项"), ("中文", "中文")]
    kind = "array<struct<type:string,name:string,description:string>>"
    df = spark.createDataFrame([([("person", " Ann ", ""), ("person", "ann", "again"), ("robot", "R2", "unit"), ("time", "x", "short")],), (None,)], f"e {kind}")
    got = [[tuple(e) for e in r[0]] for r in df.select(M.answer_entities(F.col("e"), F.lit(False))).collect()]
    assert got == [[("person", "Ann", "Mentioned in the current event"), ("subject", "R2", "unit")], []]


def test_valid_items(spark):
    texts = ['[{"t": 1, "children": [{"t": 2, "is_valid": false, "children": [{"t": 3}]}]}, {"t": 4, "is_valid": false}, 5]', "no json", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(F.transform(M.valid_items(F.col("t")), lambda x: F.get_json_object(x, "$.t"))).collect()]
    assert got == [["1", "3"], [], [], []]


def test_delimited_files(spark):
    raws = {"a.csv": "x;y\n1;2\n", "b.csv": "x\ty,z\n1\t2\n", "c.csv": "\ufeffx,y\n1,2\n", "d.CSV": ""}
    df = spark.createDataFrame([(k, v.encode()) for k, v in raws.items()], "path string, content binary")
    got = {r["path"]: r["text"] for r in files.convert(df).collect()}
    assert got == {"a.csv": "| x | y |\n| --- | --- |\n| 1 | 2 |\n", "b.csv": "| x | y,z |\n| --- | --- |\n| 1 | 2 |\n", "c.csv": "| x | y |\n| --- | --- |\n| 1 | 2 |\n", "d.CSV": ""}


def test_expansion_ends(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "z")], "event_id int, entity_id string")
    seed = spark.createDataFrame([(1,)], "event_id int")
    none = links.select("entity_id").where("false")
    reach = lambda **more: {(r[0], r[1]) for r in graph.expand_events(seed, none, links, **more)[0].collect()}
    assert reach(hops=1) == {(2, 1)} and reach(hops=9) == {(2, 1), (3, 2)} and reach(hops=9, target=1) == {(2, 1)} and reach(hops=9, target=0) == set()
    assert reach(hops=9, exclude=spark.createDataFrame([(2,)], "event_id int")) == set()
    known = spark.createDataFrame([("b",)], "entity_id string")
    assert graph.expand_events(seed, known, links, 9)[0].collect() == []
