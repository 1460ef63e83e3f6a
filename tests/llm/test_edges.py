"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_bpe, collocations, decontamination, divergence, embedding_dedup, license_scan, line_dedup, maxent_lm, nbsvm, ngram_join, secrets, sharding, substring_dedup

LONG = "word one two three four five six seven. " * 400 + "x" * 5_000
ROWS = [(1, None), (2, ""), (3, "   \n\n"), (4, LONG), (5, "alpha beta gamma delta epsilon zeta eta"), (5, "alpha beta gamma delta epsilon zeta eta"), (6, "alpha beta gamma delta epsilon zeta eta"), (None, "alpha beta gamma delta epsilon zeta eta"), (None, None), (7, "é ß 漢字 😀"), (8, "All rights reserved. token = abcdef123456")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("key"), F.lit(2).alias("n_links"), F.lit("z").alias("text_hash"), F.lit(True).alias("kept"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (2, 1, 1), (8, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Alpha beta gamma"), (2, None), (3, ""), (None, "zeta"), (4, "one two three four five six seven word one two three four five six seven")], "item_id bigint, text string")


CASES = {
    "quality": lambda d, l, i: nbsvm.quality_scores(d, l),
    "lines": lambda d, l, i: line_dedup.line_digests(d),
    "lm": lambda d, l, i: maxent_lm.score(d),
    "secrets": lambda d, l, i: secrets.secret_digests(d),
    "substrings": lambda d, l, i: substring_dedup.chunk_digests(d),
    "licenses": lambda d, l, i: license_scan.report(d),
    "ngrams": lambda d, l, i: ngram_join.join(d),
    "bpe": lambda d, l, i: byte_bpe.token_digests(d),
    "benchmark": lambda d, l, i: decontamination.contamination_digests(d, i),
    "shards": lambda d, l, i: sharding.shard_table(d),
}


@pytest.mark.parametrize("name", CASES)
def test_every_row_has_one_result(docs, labels, items, name):
    assert len(CASES[name](docs, labels, items).collect()) == len(ROWS)


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(docs, labels, items, name):
    assert CASES[name](docs.where("false"), labels.where("false"), items.where("false")).collect() == []


@pytest.mark.parametrize("name", ["quality", "benchmark"])
def test_empty_side_tables(docs, labels, items, name):
    assert len(CASES[name](docs, labels.where("false"), items.where("false")).collect()) == len(ROWS)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, labels, items, tmp_path, stage, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs.where("false") if empty else docs
    out = dict(corpus_pipeline.STAGES)[stage](spark, given, str(tmp_path))
    if stage != "tokens":
        assert out.columns == docs.columns
    n = out.count()
    assert n <= len(ROWS) and (n == 0) == empty


def test_what_each_stage_drops(spark, tmp_path):
    """Which rows go, and what is left of the others, stage by stage."""
    words = [f"w{i}" for i in range(200)]
    good = lambda k: " ".join(words[k : k + 40])
    item = " ".join(f"bench{i}" for i in range(20))
    stages = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    junk = lambda i: f"$$ buy {i} ## now {i} !! " * 5
    labelled = [(i, good(i % 100)) for i in range(0, 60)] + [(i, junk(i)) for i in range(100, 160)]
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in labelled], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(0).alias("__got"))
    run = lambda name, rows: {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[name](spark, frame(rows), str(tmp_path)).collect()}
    kept = run("quality", [*labelled, (200, good(150)), (201, junk(7))])
    assert {i for i in kept if i < 100} == set(range(60)) and 200 in kept and not [i for i in kept if 100 <= i < 160 or i == 201]
    kept = run("lines", [(1, "a b\nc d\ne f"), (2, "c d\ne f"), (3, "x\nc d\ne f\ny"), (4, ""), (5, None)])
    assert kept == {1: ("a b\nc d\ne f", 11), 3: ("x\ny", 3), 4: ("", 0), 5: (None, None)}
    kept = run("near_copies", [(1, good(0)), (2, good(0)), (3, good(0) + " end"), (4, good(90)), (5, ""), (6, None)])
    assert set(kept) == {1, 4, 5, 6}
    kept = run("benchmark_free", [(1, good(0)), (2, good(0) + " " + item), (3, item.upper()), (4, None), (5, " ".join(item.split()[:12]))])
    assert set(kept) == {1, 4, 5}


def test_stages_hand_texts_on_in_bounded_batches(spark, monkeypatch):
    """200 texts of 100 kB were one batch of 20 MB; a session that sets a bound of its own keeps it."""

    @F.arrow_udf("struct<ids: array<int>, decoded_sha256: string>")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([{"ids": [texts.nbytes], "decoded_sha256": ""}] * len(texts), pa.struct([("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]))

    monkeypatch.setattr(corpus_pipeline.byte_bpe, "encode_checked", told)
    docs = spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.repeat(F.lit("0123456789"), 10_000).alias("text"))
    largest = lambda: corpus_pipeline.tokens(spark, docs, "").agg(F.max(F.col("ids")[0]), F.count("*")).first()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for key in corpus_pipeline.BATCHES:
        spark.conf.unset(key)
    most, n = largest()
    assert n == 200 and most < 6 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == 512
    try:
        spark.conf.set(name, str(1 << 20))
        assert largest()[0] < 2 << 20 and spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.unset(name)


def test_divergence_of_nulls_and_repeats(spark, docs):
    assert divergence.source_report(docs).collect() == []  # one source, 30 documents for a term
    odd = spark.createDataFrame([(None, None, None), ("a", None, None), ("A b", "", "s"), ("a b", "", "s"), (None, "en", "x"), ("1 2", "en", "y")], "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2))
    got = divergence.divergence(odd, min_docs=2)
    # a: 1 of 1 in source '', 2 of 4 in source s; b: 0 and 2; N 1 and 4, V 2
    p = lambda c, n: 1 + 10**9 * (c + 5) // (n + 10)
    value = abs(p(1, 1) - p(2, 4)) + abs(p(0, 1) - p(2, 4))
    assert sorted(map(tuple, got["pairs"].collect())) == [("", "", "s", value), ("en", "x", "y", 0)]
    assert divergence.source_report(odd.where("false")).collect() == []


def test_collocations_of_nulls_and_repeats(spark, docs):
    assert collocations.collocations(docs).count() > 0  # the long text repeats its words 400 times
    odd = spark.createDataFrame([(None, None), ("a b", None), ("A\t b.a b", None), ("", "en"), ("x,y;x:y!x?y", "en")], "text string, lang string").withColumn("k", F.lit(1)).withColumn("phrase", F.lit(2))
    assert [tuple(r) for r in collocations.collocations(odd, least=2).collect()] == [("und", 1, "a b", 3, 3, 3, 6, 2000)]
    assert collocations.collocations(odd.where("false")).collect() == []


def test_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (None, [1.0, 2.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [float("inf"), 1.0]), (10, [1e-300, 2e-300]), (11, [2.0, -1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(v).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False), None: (0, None, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), 9: (0, 9, True), 10: (2, 4, False), 11: (0, 11, True)}
    assert embedding_dedup.near_duplicates(v.where("false")).collect() == []


def test_decided_cases(docs, labels, items):
    join = [tuple(r) for r in ngram_join.join(docs).collect()]
    assert sorted(r for r in join if r[0] in (5, 6)) == [(5, 5, 2, 5, True), (5, 5, 2, 5, True), (6, 5, 2, 5, False)]
    bench = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.report(docs, items).collect()}
    assert bench[6] == (7, 4, True) and bench[1] == (0, 0, False)
    found = {r["doc_id"]: r["licenses"] for r in license_scan.report(docs).collect()}
    assert found[8] == "all-rights-reserved" and found[4] == ""
    lm = {r["doc_id"]: r["n_tokens"] for r in maxent_lm.score(docs).collect()}
    assert lm[1] == 1 and lm[2] == 1 and lm[6] == 8
