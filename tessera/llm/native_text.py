"""Column expressions on words and spans; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: ASCII that is neither letter nor digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """array<string> of the words as written; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), F.array().cast("array<string>"))


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if a count finds at most that many rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, however often use() or a lambda in it reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """The sum up to and with each element, by doubling: n log n steps, and no array is copied for an element."""

    def doubled(sums: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - step), F.lit(0)))

    rounds = lambda x: F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1)
    return held(numbers, lambda x: F.when(F.size(x) < 2, x).otherwise(F.aggregate(rounds(x), x, doubled)))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, match, part>> of all matches, part that of the group; offsets in code points, end exclusive.

    The text between matches is what split() leaves, so ends are running sums of lengths.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    kind = "array<struct<start:int,end:int,match:string,part:string>>"

    def placed(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["between"], i)))
        one = lambda ends: lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"), F.get(x["inner"], i).alias("part"))
        return held(running_sums(sizes), lambda ends: F.transform(x["found"], one(ends)))

    all_ = held(F.struct(found.alias("found"), between.alias("between"), inner.alias("inner")), placed)
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(kind))
