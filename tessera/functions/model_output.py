"""What models return: answers to clean, JSON to repair, tags to merge; and stand-ins for models in tests."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_SCORE, MOST_SPANS = 0.3, 20


def strip_thinking(text: Column) -> Column:
    """Without thinking blocks, and without a code fence around the whole."""
    out = F.regexp_replace(text, r"(?i)<think\b[^>]*>[\s\S]*?</think>", "")
    out = F.trim(F.regexp_replace(out, r"(?i)<\|im_start\|>think[\s\S]*?<\|im_end\|>", ""))
    return F.regexp_replace(out, r"^```(?:json)?\s*([\s\S]*?)\s*```\s*$", "$1")


def _loads(text: str):
    try:
        return json.dumps(json.loads(text, strict=False), ensure_ascii=False)
    except ValueError:
        return None


def repaired(text: str | None) -> str | None:
    """JSON of a cut or slightly malformed answer; None if nothing can be saved.

    One walk notes the open brackets at each place where a value may end; the longest
    prefix that parses with its brackets closed wins.
    """
    if not text:
        return None
    s = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text, flags=re.I).strip()
    if (whole := _loads(s)) is not None:
        return whole
    s = re.sub(r",\s*([}\]])", r"\1", s)
    if (whole := _loads(s)) is not None:
        return whole
    opened, ends, inside, skip = [], [], False, False
    for i, ch in enumerate(s):
        if skip:
            skip = False
        elif ch == "\\":
            skip = inside
        elif ch == '"':
            inside = not inside
        elif inside:
            continue
        elif ch in "{[":
            opened.append("}" if ch == "{" else "]")
        elif ch in "}]" and opened:
            opened.pop()
        elif ch != ",":
            continue
        ends.append((i if ch == "," and not inside else i + 1, "".join(reversed(opened))))
    ends.append((len(s), ('"' if inside else "") + "".join(reversed(opened))))
    for end, close in reversed(ends[-200:]):
        if (got := _loads(s[:end].rstrip(", \n\r\t") + close)) is not None:
            return got
    return None


def repair_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(repaired)

    return run(text)


def merge_spans(tags: Column) -> Column:
    """array<string>: names of array<struct<entity, word, score>>: B- begins one, I- and E- of its type go on, S- and lone ones stand alone.

    Tags under the threshold end a name; names are distinct without regard to case; at most twenty.
    """
    word = lambda t: F.trim(F.regexp_replace(t["word"], "^##", ""))
    kind = lambda t: F.regexp_replace(t["entity"], "^[A-Z]-", "")
    state = F.struct(F.lit("").alias("open"), F.lit("").alias("kind"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        good = (F.upper(t["entity"]) != "O") & (t["entity"] != "") & (t["score"] >= SPAN_SCORE)
        goes_on = good & t["entity"].rlike("^[IE]-") & (acc["kind"] == kind(t)) & (acc["kind"] != "")
        closed = F.when(acc["open"] != "", F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
        begins = t["entity"].startswith("B-")
        return F.struct(
            F.when(goes_on, F.concat(acc["open"], word(t))).when(good, word(t)).otherwise("").alias("open"),
            F.when(goes_on, acc["kind"]).when(good & begins, kind(t)).otherwise("").alias("kind"),
            F.when(goes_on, acc["out"]).otherwise(closed).alias("out"),
        )

    names = F.aggregate(tags, state, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"]))
    first = F.filter(names, lambda n, i: F.array_position(F.transform(names, lambda x: F.lower(x)), F.lower(n)) == i + 1)
    return F.slice(first, 1, MOST_SPANS)


def _fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


def pseudo_embedding(text: Column, dimensions: int) -> Column:
    """A vector that depends on the text alone: bytes of its FNV-1a hash, scaled to -1 to 1. For tests."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        place = np.arange(dimensions) * 31 % 32 % 4 * 8
        hashes = texts.map(_fnv1a).to_numpy(np.int64)
        return pd.Series([(((h ^ (h >> place)) & 255) / 127.5 - 1).tolist() for h in hashes], dtype=object)

    return run(text)


def key_hash(secret: Column) -> Column:
    return F.sha2(secret.cast("binary"), 256)


def key_fingerprint(secret: Column, n: int = 12) -> Column:
    return F.substring(key_hash(secret), 1, n)


#: The types that an entity may have, and what stands for an answer that is missing or in the wrong language.
ENTITY_TYPES = ("time", "location", "person", "organization", "subject", "product", "metric", "action", "work", "group", "tags")
NO_CATEGORY = ("一般事项", "general")
NO_DESCRIPTION = ("在当前事项中被提及", "Mentioned in the current event")


def language_drift(text: Column, chinese: Column) -> Column:
    """Whether an answer is in another language than its input: words but no Han characters, or many of these and hardly a word."""
    han, latin = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fa5}]")), F.regexp_count(text, F.lit("[A-Za-z]{2,}"))
    return F.when(chinese, (han == 0) & (latin >= 4)).otherwise((han >= 8) & (latin <= 2))


def answer_text(value: Column, fallback: Column, chinese: Column) -> Column:
    """The trimmed answer, or the fallback for an empty one and for one in another language."""
    own = F.trim(F.coalesce(value, F.lit("")))
    return F.when((own == "") | language_drift(own, chinese), fallback).otherwise(own)


def answer_category(value: Column, chinese: Column) -> Column:
    """The answer's category; the general one if it is missing, in another language, or without Han characters for Chinese input."""
    general = F.when(chinese, NO_CATEGORY[0]).otherwise(NO_CATEGORY[1])
    got = answer_text(value, general, chinese)
    return F.when(chinese & ~got.rlike(r"[\x{4e00}-\x{9fa5}]"), general).otherwise(got)


def answer_entities(entities: Column, chinese: Column) -> Column:
    """array<struct<type, name, description>>: names of two or more characters, known types (else subject), one for each type and name."""

    def one(e: Column) -> Column:
        kind = F.when(e["type"].isin(*ENTITY_TYPES), e["type"]).otherwise("subject")
        about = answer_text(e["description"], F.when(chinese, NO_DESCRIPTION[0]).otherwise(NO_DESCRIPTION[1]), chinese)
        return F.struct(kind.alias("type"), F.trim(F.coalesce(e["name"], F.lit(""))).alias("name"), about.alias("description"))

    key = lambda e: F.concat_ws(":", e["type"], F.lower(e["name"]))
    kept = F.filter(F.transform(F.coalesce(entities, F.array().cast("array<struct<type:string,name:string,description:string>>")), one), lambda e: F.length(e["name"]) > 1)
    return F.get(F.transform(F.array(kept), lambda all_: F.filter(all_, lambda e, i: F.array_position(F.transform(all_, key), key(e)) == i + 1)), F.lit(0))


def valid_items(answer: Column) -> Column:
    """array<string>: the items of a JSON array and of their `children`, each before its own, as JSON, without those marked is_valid false."""

    def walk(items) -> list:
        out = []
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict):
                out += [item] if item.get("is_valid") is not False else []
                out += walk(item.get("children"))
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [json.dumps(x, ensure_ascii=False) for x in walk(json.loads(_loads(t) or "null") if t else None)])

    return run(answer)
