"""Indexes of grams and vectors against scans, with what they read."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gram_index, recall
from tessera.operators.gram_index import GramIndex, contains_join, either_contains
from tessera.operators.vector_index import VectorIndex

RNG = random.Random(8)
WORDS = ["audit", "Finding", "of", "the", "系统", "审计报告", "ledger_service", "100%", "a", "Straße", "x-ray", "Ω", "ledger"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"h{i % 7} {RNG.choice(WORDS)}", "".join(RNG.choice(WORDS) + RNG.choice([" ", "", ","]) for _ in range(RNG.randint(0, 12))), i % 5) for i in range(400)]
    rows += [(400, None, None, 0), (401, "", "", 1), (402, "needle in one place", "zyzzyva", 2), (403, "NEEDLE", "of", 3)]
    return spark.createDataFrame(rows, "id bigint, heading string, content string, rank int")


@pytest.mark.parametrize("tokens", [["audit"], ["of", "the"], ["审计", "系统"], ["zyzzyva"], ["needle", "missing-word"], ["nowhere"], ["Ω"], ["ger_s", "100%"], ["ss", "ße"], []])
def test_gram_search_equals_the_scan(spark, docs, tmp_path, tokens):
    index = GramIndex.build(docs, f"{tmp_path}/i", "id", ["heading", "content"], block_rows=40)
    got = [tuple(r) for r in index.search(tokens, 50, "heading", "content", "rank", "id").collect()]
    assert got == [tuple(r) for r in recall.by_keywords(docs, [t.lower() for t in tokens], 50, "heading", "content", "rank", "id").select(*docs.columns, "match_count", "score").collect()]


def test_a_gram_search_reads_few_rows(spark, docs, tmp_path):
    index = GramIndex.build(docs, f"{tmp_path}/i", "id", ["heading", "content"], block_rows=40)
    assert index.rows(["zyzzyva"]).count() == 1 and index.rows(["needle"]).count() == 2 and index.rows(["qqq"]).count() == 0
    assert index.candidates(["zyzzyva", "needle"]).select("block").distinct().count() <= 3  # of 11 blocks
    plan = index.rows(["zyzzyva"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [block" in plan or "PartitionFilters: [isnotnull(block" in plan or "block#" in plan.split("PartitionFilters")[1][:40]


def test_postings_are_the_grams_of_each_row(spark):
    """Texts of one row are kept apart; zeros, characters of four bytes and more than 100,000 different ones."""
    rows = [["aaa\0", "b"], ["", ""], ["ab\n系😀", "aaa"], ["", "\0"], [RNG.choice("ab") * n + "系" for n in (1, 400)]]
    wide = [[chr(c) for c in range(lo, lo + 30_000)] for lo in (0x10000, 0x20000, 0x30000, 0x40000, 0x50000)]
    for given in (rows, [[], []], [["".join(w), "ab"] for w in wide]):
        grams, at, found = gram_index._postings(given)
        got = [(g, int(i)) for g, lo, hi in zip(grams, at, at[1:]) for i in found[lo:hi]]
        padded = [[t + gram_index.END * 2 for t in row] for row in given]
        assert len(got) == len(set(got)) and set(got) == {(t[k : k + 3], i) for i, row in enumerate(padded) for t in row for k in range(len(t) - 2)}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    asked = {(g, r["i"]) for r in df.select("i", gram_index.grams(F.col("a")).alias("a"), gram_index.grams(F.col("b")).alias("b")).collect() for g in (*r["a"], *r["b"])}
    names, at, found = gram_index._postings(rows)
    assert asked == {(g, int(i)) for g, lo, hi in zip(names, at, at[1:]) for i in found[lo:hi]}


def test_lists_are_cut_by_characters_and_blocks(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(gram_index, "MOST_CHARS", 90)
    batch = docs.where("id < 60").selectExpr("cast(id div 25 as int) as block", "id", "lower(heading) as a", "lower(content) as b").orderBy("id").toArrow().to_batches()
    lists = [r for b in gram_index._lists(batch) for r in b.to_pylist()]
    assert {r["block"] for r in lists} == {0, 1, 2} and all(r["n"] == len(r["keys"]) > 0 for r in lists)
    got = [(r["gram"], r["block"], k) for r in lists for k in r["keys"]]
    want = docs.where("id < 60").select("id", F.explode(F.array_union(gram_index.grams(F.lower("heading")), gram_index.grams(F.lower("content")))).alias("g"))
    assert sorted(got) == sorted((r["g"], r["id"] // 25, r["id"]) for r in want.collect())


def test_the_rows_of_one_block_are_written_by_many_tasks_and_no_text_is_shuffled_in_a_search(spark, docs, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows into one task
    try:
        index = GramIndex.build(docs, f"{tmp_path}/i", "id", ["heading", "content"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in os.listdir(f"{tmp_path}/i/rows/block=0") if f.endswith(".parquet")]
    assert [d for d in os.listdir(f"{tmp_path}/i/rows") if d.startswith("block=")] == ["block=0"] and len(files) > 1
    plan = index.search(["audit"], 5, "heading", "content", "rank", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "match_count" in plan.split("Join LeftSemi")[1].split("\n")[1]  # counted below the join


def test_containment_both_ways(spark):
    a = ["cold", "Cold Widget", "of", "x", "", None, "系统", "大系统平台", "ABC", "abc"]
    b = ["a cold widget here", "COLD", "loaf of", "ox", "ox", "系统", "b", "", None, "abc"]
    left = spark.createDataFrame(list(enumerate(a)), "i int, mine string")
    right = spark.createDataFrame(list(enumerate(b)), "j int, theirs string")
    within = lambda n, t: bool(n) and bool(t) and n.lower() in t.lower()
    got = sorted((r["i"], r["j"]) for r in contains_join(left, right, "mine", "theirs").collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if within(x, y))
    got = sorted((r["i"], r["j"]) for r in either_contains(left, right, "mine", "theirs").collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if within(x, y) or within(y, x))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.25 * rng.normal(size=16)).tolist(), i % 3) for i in range(1500)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 1), (2002, [1.0, 2.0], 2), (2003, [float("nan")] + [1.0] * 15, 0)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, kind int")


def test_vector_search_equals_the_scan(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors, f"{tmp_path}/i", "id", "v", 24)
    fine = vectors.where("id <> 2003")  # a cosine that is no number comes first in a scan
    sample = {r["id"]: r["v"] for r in vectors.where("id in (0, 5, 77, 1499)").collect()}
    shares, found, wanted = [], 0, 0
    n = sum(x[1] for x in index.cells().values())
    for q in [*sample.values(), (-np.array(sample[0])).tolist()]:
        want = [(r["id"], round(r["score"], 9)) for r in recall.by_vector(fine, "v", q, 10, None, "id").collect()]
        got, read = index.search(q, 10)
        assert [(r["id"], round(r["score"], 9)) for r in got.collect()] == want and got.columns == ["id", "v", "kind", "score"]
        near, probed = index.search(q, 10, probes=3, exact=False)
        found += len({i for i, _ in want} & {r["id"] for r in near.collect()})
        wanted += len(want)
        shares.append(sum(index.cells()[c][1] for c in probed) / n)
    assert found / wanted >= 0.95 and max(shares) < 0.4
    q = sample[77]
    got, _ = index.search(q, 10, F.col("kind") == 1)  # filters before the k
    assert [r["id"] for r in got.collect()] == [r["id"] for r in recall.by_vector(fine.where("kind = 1"), "v", q, 10, None, "id").collect()]
    plan = index._nearest([1, 2], q, 5, None, ("id",))._jdf.queryExecution().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1][:20]  # folders of other cells are not listed


def test_missing_rows_are_put_in(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors.where("id % 4 <> 0"), f"{tmp_path}/i", "id", "v", 12)
    assert index.add_missing(vectors) == vectors.where("id % 4 = 0").count() and index.add_missing(vectors) == 0
    q = vectors.where("id = 8").first()["v"]
    assert [r["id"] for r in index.search(q, 5)[0].collect()] == [r["id"] for r in recall.by_vector(vectors.where("id <> 2003"), "v", q, 5, None, "id").collect()]


def test_indexes_of_nothing(spark, docs, vectors, tmp_path):
    assert GramIndex.build(docs.where("false"), f"{tmp_path}/g", "id", ["content"]).search(["ab", "abc"], 5, "heading", "content", "rank").collect() == []
    assert VectorIndex.build(vectors.where("false"), f"{tmp_path}/v", "id", "v").search([1.0] * 16, 5)[0].collect() == []
