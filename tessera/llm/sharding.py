"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions.

The table is written once, each partition in an order of its own random keys (the local
permutation).  How many rows each partition sends to each shard is drawn before any row
moves: the matrix has the partitions' sizes as row sums and the shards' sizes, at most one
apart, as column sums, and the law that a uniform shuffle of all rows would give it.  A
partition's first rows in its own order go to shard 0, the next to shard 1, and so on (the
exchange); within its shard each row takes the place of a second random key.

The matrix is drawn down a tree of partitions, `FANOUT` children a node, so a driver or task
holds one node and not all partitions.  A node's children take their shares one after the
other from what is left of the node's row, each share by univariate hypergeometric draws
(ratio of uniforms; Stadlober 1989, Kachitvichyanukul and Schmeiser 1985).  Sums are exact
whatever the rounding of the logarithms; the law holds to double precision.

A shard is cut into blocks of about `BLOCK_ROWS` rows by its second keys, so no shard meets in
one task; a row's slot is its block's offset and its rank there.  Texts are never looked at:
rows that are equal, null, empty or very long are as any others, and equal texts spread over
shards.  An empty table gives no rows.  Results depend on the seed and on how the table
lies in partitions; all is kept in written tables, so a lost executor changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.native_text import held, if_small, unused
from tessera.llm.textkit import Scratch

SHARDS = 24
FANOUT = 32
BLOCK_ROWS = 1 << 14
#: Most rows of the matrix, or of the blocks' offsets, that are broadcast.
BROADCAST_ROWS = 100_000
#: Tries of a draw; each is accepted with about 0.7 or more, so the last is reached once in 10^30.
TRIES = 64
SEED = 20_240_607


def _uniform(*parts: Column) -> Column:
    """A number over 0 and under 1 that the parts fix."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 10 on."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    small = F.array(*[F.lit(math.log(math.factorial(k))) for k in range(10)])
    return F.when(x < 10, F.get(small, F.least(n, F.lit(9)).cast("int"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, drawn: Column, *seed: Column) -> Column:
    """How many of `drawn` out of good + bad are good: a long, fixed by the seed."""

    def draw(p: Column) -> Column:
        low, high = F.greatest(F.lit(0).cast("long"), p["k"] - p["b"]), F.least(p["g"], p["k"])
        total, share = (p["g"] + p["b"]).cast("double"), p["g"].cast("double") / (p["g"] + p["b"])
        mean = p["k"] * share
        spread = F.sqrt(F.greatest((total - p["k"]) * p["k"] * share * (1 - share) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)) + 0.5)
        mode = F.least(F.greatest(F.floor((p["k"] + 1.0) * (p["g"] + 1.0) / (total + 2)).cast("long"), low), high)
        fixed = F.struct(low.alias("low"), high.alias("high"), (mean + 0.5).alias("centre"), (1.7155277699214135 * spread + 0.8989161620588988).alias("width"), mode.alias("mode"))
        return F.when(low == high, low).otherwise(held(fixed, lambda f: _tried(p, f)))

    def _tried(p: Column, f: Column) -> Column:
        weight = lambda x: log_factorial(x) + log_factorial(p["g"] - x) + log_factorial(p["k"] - x) + log_factorial(p["b"] - p["k"] + x)
        top = weight(f["mode"])

        def one(t: Column) -> Column:
            u, v = _uniform(*seed, t, F.lit(1)), _uniform(*seed, t, F.lit(2))
            spot = F.floor(f["centre"] + f["width"] * (v - 0.5) / u)
            inside = (spot >= f["low"]) & (spot <= f["high"])
            return F.when(inside, held(spot.cast("long"), lambda x: F.when(2 * F.log(u) <= top - weight(x), x)))

        none = F.lit(None).cast("long")
        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), none, lambda got, t: F.coalesce(got, one(t))), f["mode"])

    return held(F.struct(good.cast("long").alias("g"), bad.cast("long").alias("b"), drawn.cast("long").alias("k")), draw)


def _row(left: Column, rows: Column, *seed: Column) -> Column:
    """How many of `rows` go to each shard, drawn without replacement from what is left for each: array<long>."""

    def step(acc: Column, j: Column) -> Column:
        here = F.get(left, j)
        x = hypergeometric(here, acc["rest"] - here, acc["need"], *seed, j)
        return held(x, lambda got: F.struct((acc["rest"] - here).alias("rest"), (acc["need"] - got).alias("need"), F.concat(acc["out"], F.array(got)).alias("out")))

    start = F.struct(F.aggregate(left, F.lit(0).cast("long"), lambda a, b: a + b).alias("rest"), rows.cast("long").alias("need"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), start, step, lambda acc: acc["out"])


def communication_matrix(sizes: DataFrame, n_parts: int, shard_sizes: list[int], scratch: Scratch, seed: int = SEED) -> DataFrame:
    """part, counts (array<long>, one a shard): the drawn matrix.

    sizes: part (0 to n_parts - 1), n.  Level by level, the nodes of the tree over part
    numbers get their share of their parent's row; a node's children lie in one array.
    """
    levels = max(1, math.ceil(math.log(max(n_parts, 2), FANOUT) - 1e-9))
    row = F.array(*[F.lit(s).cast("long") for s in shard_sizes])
    nodes = sizes.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), row.alias("counts"))
    for level in range(levels - 1, -1, -1):
        step = FANOUT**level
        child = F.floor(F.col("part") / step).cast("long")
        below = sizes.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        below = below.groupBy(F.floor(F.col("child") / FANOUT).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))

        def share(acc: Column, c: Column) -> Column:
            drawn = _row(acc["left"], c["n"], F.lit(seed), F.lit(step), c["child"])  # used before the loop goes on
            return held(drawn, lambda got: F.struct(F.zip_with(acc["left"], got, lambda a, b: a - b).alias("left"), F.concat(acc["out"], F.array(F.struct(c["child"].alias("node"), got.alias("counts")))).alias("out")))

        start = F.struct(F.col("counts").alias("left"), F.array().cast("array<struct<node:bigint,counts:array<bigint>>>").alias("out"))
        nodes = below.join(nodes, "node").select(F.inline(F.aggregate("children", start, share, lambda acc: acc["out"])))
        nodes = scratch.keep(nodes, "matrix")
    return nodes.select(F.col("node").alias("part"), "counts")


def _exchanged(df: DataFrame, n: int, seed: int) -> tuple[DataFrame, Scratch, dict[str, str]]:
    """df's rows, kept, with their shard, block and second key, under the names of the dict."""
    if n < 1:
        raise ValueError("there must be a shard at least")
    scratch = Scratch(df.sparkSession)
    names = {}
    for c in ("part", "place", "draw", "shard_at", "block", "order_at", "counts", "slot_at", "ahead"):
        names[c] = unused(df, f"__{c}")
    part, place, draw = names["part"], names["place"], names["draw"]
    # the order of equal keys is that of the rows read; all is written before anything counts on it
    keyed = df.withColumn(place, F.monotonically_increasing_id()).withColumn(draw, F.xxhash64(F.lit(seed), F.col(place)))
    local = keyed.sortWithinPartitions(draw, place).withColumn(place, F.monotonically_increasing_id()).drop(draw)
    local = local.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1))
    local = scratch.keep(local, "local")
    sizes = scratch.keep(local.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")), "sizes")
    rows, n_parts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(-1)) + 1).first()
    shard_sizes = [rows // n + (j < rows % n) for j in range(n)]
    matrix = communication_matrix(sizes, n_parts, shard_sizes, scratch, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.aggregate(F.slice("counts", F.lit(1), j), F.lit(0).cast("long"), lambda a, b: a + b))
    matrix = scratch.keep(matrix.select(F.col("part").alias(part), ends.alias(names["counts"])), "ends")
    bits = max(0, math.ceil(math.log2(max(rows / n / BLOCK_ROWS, 1))))
    sent = local.join(if_small(matrix, BROADCAST_ROWS), part)
    sent = sent.withColumn(names["shard_at"], F.size(F.filter(names["counts"], lambda c: c <= F.col(place))))
    sent = sent.withColumn(names["order_at"], F.xxhash64(F.lit(seed + 1), part, place))
    block = F.shiftrightunsigned(names["order_at"], 64 - bits).cast("int") if bits else F.lit(0)
    return sent.withColumn(names["block"], block).drop(names["counts"]), scratch, names


def shuffle_shards(df: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 to n - 1) and slot (from 0, without gaps in a shard); columns of df of these names are replaced.

    All of df is written once and moved once, by shard and block.
    """
    df = df.drop("shard", "slot")
    sent, scratch, names = _exchanged(df, n, seed)
    shard, block, order_at = names["shard_at"], names["block"], names["order_at"]
    counts = scratch.keep(sent.groupBy(shard, block).agg(F.count("*").alias("n")), "blocks")
    before = F.sum("n").over(Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.keep(counts.select(shard, block, F.coalesce(before, F.lit(0)).alias(names["ahead"])), "offsets")
    own = Window.partitionBy(shard, block).orderBy(order_at, names["part"], names["place"])
    ranked = sent.withColumn(names["slot_at"], F.row_number().over(own).cast("long") - 1)
    out = ranked.join(if_small(offsets, BROADCAST_ROWS), [shard, block])
    return out.select(*df.columns, F.col(shard).cast("int").alias("shard"), (F.col(names["ahead"]) + F.col(names["slot_at"])).alias("slot"))


def write_shards(df: DataFrame, path: str, n: int = SHARDS, seed: int = SEED) -> None:
    """The shuffled table as Parquet under path, a folder shard=j for each shard; files of a block each, rows in the order of their slots."""
    sent, _, names = _exchanged(df.drop("shard"), n, seed)
    shard, block = names["shard_at"], names["block"]
    laid = sent.repartition(shard, block).sortWithinPartitions(shard, block, names["order_at"], names["part"], names["place"])
    laid = laid.select(*[c for c in df.columns if c != "shard"], F.col(shard).cast("int").alias("shard"))
    laid.write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law (rows), shard, slot, grown_shard (null) for every row; null texts have no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_shards(given, n, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
