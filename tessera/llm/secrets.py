"""Secret scan in DataFrame functions: patterns, and windows of high entropy.

Beside three fixed patterns, candidate strings are runs of at least `WINDOW`
characters of the base64 alphabets.  Shannon entropy is taken over a window that
slides by one character: the counts of its characters are kept, and only those of the
character that leaves and the one that enters change, and with them the sum of n log2 n.
The threshold depends on the character
class (hexadecimal digits, or base64 letters and digits).  Candidates without both
letters and digits, of a pattern on the allow list, or overlapping a pattern's span
add nothing.

Null texts count as empty and have no spans.  Every row is scanned on its own, in
full: nothing is shuffled, and the work grows with the length of a text and, by a
logarithm, with its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.native_text import held, spans

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run of 24 has a match of HEX of 24 or more, and only those count; shorter runs need no span.
LONG_HEX = r"[0-9a-f]{24,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits by class: random hexadecimal windows have about 3.4, random base64 ones about 4.1, words about 3.
HEX_BITS, BASE64_BITS = 3.0, 3.6
#: Strings that are no secrets though they look like it.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^(?:[A-Za-z]+[-_/]){2,}[A-Za-z0-9]*$",  # paths and dashed names
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",  # dates
    r"(?:0123456789|abcdefghij|ABCDEFGHIJ)",  # alphabets
    r"(?i)(?:example|changeme|placeholder|xxxxxx)",
)
KINDS = ("assign", "access", "hex", "entropy")


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """The greatest entropy in bits of any window of that many characters; null for shorter strings."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])  # n log2 n

    def peak(x: Column) -> Column:
        codes = x["codes"]
        counts = F.transform(x["kinds"], lambda _, k: F.size(F.filter(F.slice(codes, 1, window), lambda c: c == k)))

        def slide(acc: Column, i: Column) -> Column:
            leaves, enters = F.get(codes, i), F.get(codes, i + window)
            out, new = F.get(acc["counts"], leaves), F.get(acc["counts"], enters)
            s = acc["s"] - F.get(weight, out) + F.get(weight, out - 1) - F.get(weight, new) + F.get(weight, new + 1)
            after = F.transform(acc["counts"], lambda n, k: F.when(k == leaves, n - 1).when(k == enters, n + 1).otherwise(n))
            return F.when(leaves == enters, acc).otherwise(F.struct(after.alias("counts"), s.alias("s"), F.least(acc["least"], s).alias("least")))

        def walked(begin: Column) -> Column:
            start = F.aggregate(begin, F.lit(0.0), lambda s, n: s + F.get(weight, n))
            state = lambda v: F.struct(begin.alias("counts"), v.alias("s"), v.alias("least"))
            steps = F.when(F.size(codes) > window, F.sequence(F.lit(0), F.size(codes) - window - 1)).otherwise(F.array().cast("array<int>"))
            return held(start, lambda v: F.aggregate(steps, state(v), slide)["least"])

        return F.log2(F.lit(float(window))) - held(counts, walked) / window

    def coded(x: Column) -> Column:
        return F.struct(F.transform(x["chars"], lambda c: (F.array_position(x["kinds"], c) - 1).cast("int")).alias("codes"), x["kinds"].alias("kinds"))

    chars = F.slice(F.split(text, ""), F.lit(1), F.length(text))
    both = held(chars, lambda c: F.struct(c.alias("chars"), F.array_distinct(c).alias("kinds")))
    return F.when(F.length(text) >= window, held(held(both, coded), peak))


def overlaps(found: Column, x: Column) -> Column:
    """Whether the span x meets one of found, spans in order that do not meet each other, by halving."""
    n = F.size(found)

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.get(found, mid)["start"] < x["end"]
        on = acc["lo"] < acc["hi"]
        return F.struct(F.when(on & before, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(on & ~before, mid).otherwise(acc["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2((n + 1).cast("double"))).cast("int"))
    first_after = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), half)["lo"]
    return F.coalesce((n > 0) & (F.get(found, first_after - 1)["end"] > x["start"]), F.lit(False))


def _kind(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, base, extra: arrays of struct<start, rank, end, kind> sorted by start, then kind; offsets in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6)
    out = docs.select("doc_id", assign.alias("assign"), spans(text, LONG_ACCESS).alias("access"), spans(text, LONG_HEX).alias("hex"), spans(text, CANDIDATE).alias("candidates"))

    def secret(x: Column) -> Column:
        s = x["match"]
        ok = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
        for pattern in allowed:
            ok &= ~s.rlike(pattern)
        for kind in KINDS[:3]:
            ok &= ~overlaps(F.col(kind), x)
        bits = F.when(s.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(BASE64_BITS)
        return F.when(ok, peak_entropy(s) >= bits).otherwise(False)

    base = F.array_sort(F.concat(*[_kind(F.col(kind), rank) for rank, kind in enumerate(KINDS[:3])]))
    return out.select("doc_id", base.alias("base"), _kind(F.filter("candidates", secret), 3).alias("extra"))


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs)
    count = [_count(k).alias(f"n_{k}") for k in KINDS[:3]]
    every = F.array_sort(F.concat("base", "extra"))
    return found.select("doc_id", *count, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(every).alias("spans"))
