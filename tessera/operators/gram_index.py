"""Containment of short strings in texts by character grams: a stored index, and a join of two columns.

A text is asked whether it contains a string only where it has the string's rarest grams of
three characters.  Containment is of lower-case characters; `%` and `_` are literal.  Any
script will do: two Chinese characters are found like two letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import recall

#: What stands twice after a text, so that each of its characters and pairs begins a gram.
END = "\x03"
SIZE = 3
#: Rows of a block of postings, folders that grams are dealt to, and grams of a string that are looked up.
BLOCK_ROWS, BUCKETS, LOOKED_UP = 1 << 16, 16, 3
#: Files that a block's rows are dealt to, and characters (in one row, if it is longer) and rows whose lists are made at once.
SLICES, MOST_CHARS, MOST_ROWS = 8, 1 << 22, 1 << 12


def grams(text: Column) -> Column:
    """The distinct grams of a lower-case text, those over its end included; none for null and empty ones."""
    chars = F.regexp_extract_all(F.concat(text, F.lit(END * (SIZE - 1))), F.lit("(?s)."), F.lit(0))  # once, so the work follows the length
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - SIZE), lambda i: F.concat(*[F.get(c, i + j) for j in range(SIZE)]))
    return F.when(F.length(text) > 0, F.array_distinct(T.let(chars, cut))).otherwise(F.array().cast("array<string>"))


def _postings(rows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct grams, where each one's rows begin and the last ones end, numbers of rows): `grams` of lower-case rows of texts."""
    texts = [(i, t + END * (SIZE - 1)) for i, row in enumerate(rows) for t in row if t]
    if not texts:
        return [], np.zeros(1, np.int32), np.zeros(0, np.int64)
    lengths = np.array([len(t) for _, t in texts])
    code = np.frombuffer("".join(t for _, t in texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(int(code.max()) + 1, np.int64)
    seen[code] = 1
    chars, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
    bits, n = (len(rows) - 1).bit_length(), len(chars)
    if n**SIZE << bits >= 1 << 63:  # only with more than 100,000 different characters; one row always fits
        half = len(rows) // 2
        parts = [(_postings(rows[:half]), 0), (_postings(rows[half:]), half)]
        sizes = np.concatenate([np.diff(p[1]) for p, _ in parts])
        return [g for p, _ in parts for g in p[0]], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate([p[2] + lo for p, lo in parts])
    gram = np.zeros(len(code) - SIZE + 1, np.int64)
    for i in range(SIZE):
        gram = gram * n + code[i : len(code) - SIZE + 1 + i]
    begins = np.ones(len(code), bool)
    for i in range(1, SIZE):
        begins[np.cumsum(lengths) - i] = False
    begins = begins[: len(gram)]
    pairs = (gram << bits | np.repeat(np.array([i for i, _ in texts]), lengths)[: len(gram)])[begins]
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    gram = pairs >> bits
    at = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    found = gram[at]
    names = chars[np.stack([found // n**i % n for i in reversed(range(SIZE))], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [names[i : i + SIZE] for i in range(0, len(names), SIZE)], np.append(at, len(pairs)).astype(np.int32), pairs & ((1 << bits) - 1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, n, keys of rows (block, key, texts in lower case); a gram of a block has a list for each MOST_CHARS of its texts."""
    for batch in batches:
        block, key, *texts = batch.columns
        blocks, texts = block.to_pylist(), list(zip(*[t.to_pylist() for t in texts]))
        lo = 0
        while lo < len(blocks):
            hi, chars = lo, 0
            while hi < len(blocks) and hi - lo < MOST_ROWS and blocks[hi] == blocks[lo] and (hi == lo or chars + sum(map(len, texts[hi])) <= MOST_CHARS):
                chars += sum(map(len, texts[hi]))
                hi += 1
            names, at, row = _postings([[] if k is None else texts[lo + i] for i, k in enumerate(key[lo:hi].to_pylist())])
            keys = pa.ListArray.from_arrays(pa.array(at), key[lo:hi].take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), blocks[lo], np.int32)), pa.array(np.diff(at)), keys], ["gram", "block", "n", "keys"])
            lo = hi


class GramIndex:
    """Posting lists of a table's texts at path, and the rows themselves in blocks.

    postings: bucket, gram, block, n, keys; counts: gram, n; rows: block and all columns.  A list
    is cut into blocks of keys, so the list of a frequent gram is many rows of bounded size.
    A search reads the folders of its grams' buckets, the row groups that may hold the grams,
    and the blocks that hold what is left after intersecting.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, texts: list[str]) -> None:
        self.spark, self.path, self.key, self.texts = spark, path.rstrip("/"), key, texts
        self._schemas: dict[str, str] = {}

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, texts: list[str], block_rows: int = BLOCK_ROWS) -> GramIndex:
        """The index of the columns `texts` of df, whose `key` is unique."""
        out = cls(df.sparkSession, path, key, texts)
        n_blocks = max(1, -(-df.count() // block_rows))
        placed = df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int"))
        kind = df.schema[key].dataType.simpleString()
        lists = f"gram string, block int, n int, keys array<{kind}>"
        out._schemas = {"rows": placed.schema, "postings": f"{lists}, bucket int", "counts": "gram string, n bigint"}
        dealt = placed.repartition("block", F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.lit(SLICES)))
        dealt.sortWithinPartitions("block", key).write.partitionBy("block").parquet(f"{out.path}/rows")
        low = out._read("rows").select("block", key, *[F.lower(F.coalesce(F.col(t), F.lit(""))).alias(f"text{i}") for i, t in enumerate(texts)])
        made = low.mapInArrow(_lists, lists).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        made.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{out.path}/postings")
        counts = out._read("postings").groupBy("gram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{out.path}/counts")
        return out

    def _read(self, part: str) -> DataFrame:
        read = self.spark.read.schema(self._schemas[part]) if part in self._schemas else self.spark.read
        return read.parquet(f"{self.path}/{part}")

    def candidates(self, tokens: list[str]) -> DataFrame:
        """token, block, key: rows that have the rarest grams of a token; every row that contains it is among them."""
        long_ = {t: sorted({t[i : i + SIZE] for i in range(len(t) - SIZE + 1)}) for t in tokens if len(t) >= SIZE}
        every = sorted({g for gs in long_.values() for g in gs})
        n = {r["gram"]: r["n"] for r in self._read("counts").where(F.col("gram").isin(every)).collect()} if every else {}  # the grams of a query
        plan = [(t, g) for t, gs in long_.items() if all(g in n for g in gs) for g in sorted(gs, key=lambda g: (n[g], g))[:LOOKED_UP]]
        out = []
        if plan:
            asked = self.spark.createDataFrame(plan, "token string, gram string").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
            wanted = sorted({g for _, g in plan})
            buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
            lists = self._read("postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
            need = F.create_map(*[x for t in {t for t, _ in plan} for x in (F.lit(t), F.lit(sum(1 for p in plan if p[0] == t)))])
            met = lists.join(F.broadcast(asked.drop("bucket")), "gram").select("token", "block", F.explode("keys").alias(self.key))
            out.append(met.groupBy("token", "block", self.key).agg(F.count("*").alias("n")).where(F.col("n") == F.element_at(need, F.col("token"))).drop("n"))
        for t in {t for t in tokens if 0 < len(t) < SIZE}:  # begins some gram of each text that contains it
            lists = self._read("postings").where(F.col("gram").startswith(t))
            out.append(lists.select(F.lit(t).alias("token"), "block", F.explode("keys").alias(self.key)).distinct())
        if not out:
            return self._read("rows").where("false").select(F.lit("").alias("token"), "block", self.key)
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        return found

    def _found(self, tokens: list[str]) -> tuple[DataFrame, DataFrame]:
        """(all rows of the blocks that hold a candidate, keys of the candidates)."""
        found = self.candidates(tokens).select("block", self.key).distinct()
        blocks = [r[0] for r in found.select("block").distinct().collect()]  # at most a block for BLOCK_ROWS rows
        return self._read("rows").where(F.col("block").isin(blocks)).drop("block"), found.select(self.key)

    def rows(self, tokens: list[str]) -> DataFrame:
        """The columns of rows that may contain one of the (lower-case) tokens: only blocks that hold one are read."""
        rows, found = self._found(tokens)
        return rows.join(found, self.key, "left_semi")

    def search(self, tokens: list[str], k: int, heading: str = "heading", content: str = "content", rank: str = "rank", *ties: str) -> DataFrame:
        """As recall.by_keywords over the whole table; heading and content must be indexed.

        Texts are looked at where they are read; counts of hits, and no texts, meet the candidates.
        """
        tokens = [t.lower() for t in tokens]
        rows, found = self._found(tokens)
        hits = rows.select(*dict.fromkeys([self.key, rank, *ties]), recall.keyword_hits(tokens, heading, content).alias("match_count")).where("match_count > 0")
        best = recall.best_hits(hits.join(found, self.key, "left_semi"), tokens, k, rank, *ties).select(self.key, "match_count", "score")
        return rows.join(F.broadcast(best), self.key).select(*rows.columns, "match_count", "score").orderBy(F.col("match_count").desc(), rank, *ties)


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Pairs of rows in which the text contains the needle (both as lower case): all columns of both, whose names must differ.

    Each needle is joined by the one of its grams that the fewest texts have, with the texts
    that have it, and then looked for.  Null and empty needles are in nothing.
    """
    low = F.lower(F.col(text))
    have = texts.withColumn("__gram", F.explode(grams(low)))
    own = F.lower(F.col(needle))
    asked = needles.where(F.length(own) > 0).withColumn("__grams", F.filter(grams(own), lambda g: ~g.endswith(END))).withColumn("__n", F.length(own))
    n = have.groupBy("__gram").agg(F.count("*").alias("n"))
    each = asked.where(F.col("__n") >= SIZE).select(F.explode("__grams").alias("__gram")).distinct().join(n, "__gram", "left").fillna(0, ["n"])
    ranked = asked.where(F.col("__n") >= SIZE).select(own.alias("__needle"), F.explode("__grams").alias("__gram")).distinct().join(each, "__gram")
    rarest = ranked.groupBy("__needle").agg(F.min(F.struct("n", "__gram")).alias("r")).where("r.n > 0").select("__needle", F.col("r.__gram").alias("__gram"))
    found = asked.withColumn("__needle", own).join(rarest, "__needle").join(have, "__gram")
    # one or two characters begin a gram of each text that has them
    for size in range(1, SIZE):
        begins = have.withColumn("__begin", F.substring("__gram", 1, size)).dropDuplicates([*texts.columns, "__begin"])
        more = asked.where(F.col("__n") == size).withColumn("__needle", own).join(begins, F.col("__needle") == F.col("__begin"))
        found = found.select(*needles.columns, *texts.columns).unionByName(more.select(*needles.columns, *texts.columns))
    return found.where(low.contains(own)).select(*needles.columns, *texts.columns)


def either_contains(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of rows of a and b, each once, in which one of the two strings contains the other."""
    one = contains_join(a, b, left, right)
    other = contains_join(b, a, right, left).where(F.length(left) > F.length(right))  # equal lengths are among the first
    return one.select(*a.columns, *b.columns).unionByName(other.select(*a.columns, *b.columns))
