"""Shards, divergence of sources and collocations against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, divergence, sharding, textkit

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_hypergeometric_law(spark):
    """All of the support, at the frequencies of the law: chi-squared below what one in a million draws gives."""
    for good, bad, drawn in ((30, 70, 20), (3, 4, 5), (5000, 200, 60), (40, 1, 41), (0, 9, 4)):
        n = 40_000
        got = {r["x"]: r["count"] for r in spark.range(n).select(sharding.hypergeometric(F.lit(good), F.lit(bad), F.lit(drawn), F.col("id")).alias("x")).groupBy("x").count().collect()}
        law = {x: n * math.comb(good, x) * math.comb(bad, drawn - x) / math.comb(good + bad, drawn) for x in range(max(0, drawn - bad), min(good, drawn) + 1)}
        assert set(got) <= set(law)
        common = [x for x in law if law[x] >= 5]
        rest = n - sum(law[x] for x in common)
        chi = sum((got.get(x, 0) - law[x]) ** 2 / law[x] for x in common) + ((n - sum(got.get(x, 0) for x in common) - rest) ** 2 / rest if rest > 5 else 0)
        assert chi < len(common) + 5.5 * math.sqrt(2 * len(common)) + 25


def test_log_factorial(spark):
    for n in (0, 1, 9, 10, 11, 170, 10**6, 10**12):
        got = spark.range(1).select(sharding.log_factorial(F.lit(n).cast("long")).alias("x")).first()["x"]
        assert got == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-11)


@pytest.mark.parametrize(("sizes", "shards", "fanout"), [([7, 0, 12, 1, 5], 4, 2), ([100] * 40, 24, 3), ([1], 3, 32), ([5, 5], 1, 32), ([1000, 1, 1], 7, 2)])
def test_matrix_has_exact_sums(spark, monkeypatch, sizes, shards, fanout):
    monkeypatch.setattr(sharding, "FANOUT", fanout)
    n = sum(sizes)
    wanted = [n // shards + (j < n % shards) for j in range(shards)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sizes) if s], "part bigint, n bigint")
    got = {r["part"]: r["counts"] for r in sharding.communication_matrix(frame, len(sizes), wanted, textkit.Scratch(spark), 3).collect()}
    assert {i: sum(c) for i, c in got.items()} == {i: s for i, s in enumerate(sizes) if s}
    assert [sum(c[j] for c in got.values()) for j in range(shards)] == wanted and min(min(c) for c in got.values()) >= 0


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_shards(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    texts = [None, "", "é😀", "same"] + ["same"] * 300 + [f"text {i}" for i in range(500)]
    docs = spark.createDataFrame([(i % 700, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("shard", F.lit("x")).repartition(5)
    got = sharding.shard_table(docs).collect()
    want = Counter((i % 700, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sharding.write_shards(docs, f"{tmp_path}/out", 7)
    back = spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in back) == sorted(len(texts) // 7 + (j < len(texts) % 7) for j in range(7))


def test_shuffle_is_uniform(spark):
    """Where a row lies before says nothing of its shard or slot: each pair of part and shard, and each slot, as often as chance gives it."""
    rows = spark.range(20_000).repartitionByRange(8, "id")
    pairs, early = Counter(), 0
    for seed in (1, 2, 3):
        for r in sharding.shuffle_shards(rows, 4, seed).collect():
            pairs[r["id"] // 2500, r["shard"]] += 1
            early += r["id"] < 10_000 and r["slot"] < 2500
    assert all(abs(n - 1875) < 6 * math.sqrt(1875 * 0.75) for n in pairs.values()) and len(pairs) == 32
    assert abs(early - 15_000) < 6 * math.sqrt(60_000 * 0.25)


RNG = random.Random(11)
BASE = ["alpha", "Beta", "gamma", "straße", "ÉTÉ", "été", "x", "Δ", "omega", "漢字"]


def _docs(n):
    out = []
    for i in range(n):
        lang = RNG.choice(["en", "en", "en", "de", None, ""])
        source = "hot" if i % 3 == 0 else RNG.choice(["s1", "s2", "é", None, "Z"])
        words = [RNG.choice(BASE[: RNG.randint(1, 10)]) + RNG.choice(["", "", "1", "-"]) for _ in range(RNG.randint(0, 30))]
        out.append((i % 50, RNG.choice([" ", "  ", ", ", "\t", "."]).join(words) if i % 17 else None, lang, source))
    return out


def _divergence(rows, least):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        others = [s for l, s in groups if l == lang]
        total = {s: sum(tf[lang, s][t] for t in kept) for s in others}
        p = lambda n, all_: 1 + 10**9 * (n + 5) // (all_ + 5 * len(kept))  # noqa: B023, E731
        whole = {t: sum(tf[lang, s][t] for s in others) for t in kept}
        pair = [(sum(abs(p(tf[lang, source][t], total[source]) - p(tf[lang, s][t], total[s])) for t in kept), s) for s in others if s != source]
        term = [(p(tf[lang, source][t], total[source]) - p(whole[t], sum(whole.values())), t) for t in kept if tf[lang, source][t]]
        for part, got in (("pair", pair), ("term", [x for x in term if x[0] > 0])):
            for rank, (value, item) in enumerate(sorted(got, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= 50:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize(("counts", "columns"), [(20_000, 64), (7, 2)])
def test_divergence(spark, monkeypatch, counts, columns):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", counts)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    rows = _docs(900)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = sorted(tuple(r) for r in divergence.source_report(docs).collect())
    assert got == _divergence(rows, 30) and len(got) > 80


def test_combinations_add_up_to_the_kept_terms(spark):
    """Zeros included, the multiplicities of a pair are its language's terms, each once."""
    rows = [("en", s, t, n) for s, own in (("a", {"p": 1, "q": 2, "r": 2}), ("b", {"q": 5, "s": 1}), ("c", {})) for t, n in own.items()]
    kept = spark.createDataFrame(rows, "lang string, source string, term string, n bigint")
    joint = divergence.joint_histograms(kept, 5, 3)
    assert [tuple(r) for r in joint.collect()] == [("en", "a", "b", 2, 5, 1)]
    pairs = spark.createDataFrame([("en", "a", "b", 4, 3, 2), ("en", "a", "c", 4, 3, 0)], "lang string, left string, right string, kept bigint, left_terms bigint, right_terms bigint")
    histograms = kept.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("n"))
    got = {tuple(r) for r in divergence.combinations(pairs, joint, histograms).collect()}
    assert got == {("en", "a", "b", 2, 5, 1), ("en", "a", "b", 1, 0, 1), ("en", "a", "b", 2, 0, 1), ("en", "a", "b", 0, 1, 1), ("en", "a", "c", 1, 0, 1), ("en", "a", "c", 2, 0, 2), ("en", "a", "c", 0, 0, 1)}


def _collocations(rows, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {c: a for c, a in f.items() if a >= least and len(c[1]) > 1}
    inside = {(lang, w[i:j]) for (lang, w), a in cands.items() for i, j in combinations(range(len(w) + 1), 2) if 2 <= j - i < len(w) and a >= f[lang, w[i:j]]}
    told = defaultdict(list)
    for (lang, w), a in cands.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            told[lang].append((score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, all_ in told.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(all_, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top], 1):
            out.append((lang, rank, phrase, a, l, r, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize(("bits", "gathered", "top"), [(28, 4_000_000, 2000), (3, 50, 40)])
def test_collocations(spark, monkeypatch, bits, gathered, top):
    """Also with bitmaps of eight bits, all of them set: they let every run be counted and change nothing."""
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations.bitmap, "__defaults__", (bits,))
    monkeypatch.setattr(collocations, "GATHERED", gathered)
    rows = _docs(700) + [(1, "one two  three\tfour five six. one two three four five six", "en", "s")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 8, 5, top).collect())
    assert got == _collocations(rows, 8, 5, top) and len(got) > 60


def test_scores_beyond_64_bits(spark):
    """a * n * 1000 of 10^25 over l * r of 10^20."""
    score = F.call_function("div", collocations._exact(F.col("a"), F.col("n"), F.lit(1000)), collocations._exact(F.col("l"), F.col("r")))
    row = spark.createDataFrame([(10**10 + 1, 10**12 + 7, 10**10 + 3, 10**10 + 9)], "a bigint, n bigint, l bigint, r bigint").select(score.alias("x")).first()
    assert row["x"] == 1000 * (10**10 + 1) * (10**12 + 7) // ((10**10 + 3) * (10**10 + 9))
