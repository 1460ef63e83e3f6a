"""License scan in DataFrame functions: MinHash bands over overlapping windows, then exact containment.

Templates are sorted into classes by length: up to N = 8, 16, 32, ... words, and each
length below 5 by itself.  A template is looked for in the windows of 2N words of its
class, which start every N words, so each run of N words lies inside one.  A window that
holds at least `CONTAINMENT` of the template's shingles (5 words; all its words if it has
fewer) has a Jaccard similarity of 1/12 or more with it; `BANDS` bands of one row each
bring the two together with probability 1 - (1 - 1/12)^96 > 0.9997, and more for longer
templates.  Retrieved pairs are verified by exact containment.

Only windows with an anchor word are hashed: anchors of a template are words that touch
so many of its shingles that a window without them cannot reach the containment.  That
loses nothing.  Templates follow the list of licenses, not the documents; their bands are
broadcast only if a count finds them small.  Texts are not shuffled.

Null and empty texts hold no license.  Rows that repeat both id and text share a result.
"""

from __future__ import annotations

import json
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import BROADCAST_ROWS
from tessera.llm.license_texts import library
from tessera.llm.native_text import ascii_lower, held, if_small, words
from tessera.llm.textkit import Scratch

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 96

TEMPLATES = library()
#: Words that many texts hold: taken as anchors last.
COMMON = frozenset("a all and any are as at by for from in is it may no not of on or that the this to with you your".split())


def _python_words(text: str) -> list[str]:
    return [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split(" ") if w]


def _anchors(own: list[str]) -> list[tuple[str, str]]:
    """Few words, the longest first and common ones last, without which less than the containment is left.

    Each has a mate: where all shingles are needed, another word of the template, which must be there too; else itself.
    """
    k = min(SHINGLE, len(own))
    left = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
    spare, out = len(left) - ceil(CONTAINMENT * len(left) - 1e-9), []
    touched: set = set()
    order = sorted(set(own), key=lambda w: (w in COMMON, w.isdigit(), -len(w), w))
    for word in order:
        if len(touched) > spare:
            break
        out.append((word, word))
        touched |= {s for s in left if word in s}
    return [(order[0], order[min(1, len(order) - 1)])] if not spare else out


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, n, anchors, shingles (strings) of every template that has words."""
    rows = []
    for name, text in sorted(templates.items()):
        if own := _python_words(text):
            k = min(SHINGLE, len(own))
            rows.append((name, len(own), _anchors(own), sorted({" ".join(own[i : i + k]) for i in range(len(own) - k + 1)})))
    return spark.createDataFrame(rows, "template string, n int, anchors array<struct<word: string, mate: string>>, shingles array<string>")


def bands(shingles: Column) -> Column:
    """array<bigint>: for each band the least hash of the shingles under its seed."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))))


def class_of(n: int) -> tuple[int, int]:
    """(N, words of a shingle) of the class of a template of n words."""
    return (n, n) if n < SHINGLE else (max(8, 1 << (n - 1).bit_length()), SHINGLE)


def classes_of(rows) -> list[tuple[int, int, int, dict[str, list[str]]]]:
    """(N, words of a shingle, least shingles, mates of each anchor) of each class that rows (n, anchors, shingles) are in."""
    out: dict = {}
    for r in rows:
        least, anchors = out.get(class_of(r["n"]), (1 << 30, {}))
        for word, mate in r["anchors"]:
            anchors.setdefault(word, set()).add(mate)
        out[class_of(r["n"])] = min(least, ceil(CONTAINMENT * len(r["shingles"]) - 1e-9)), anchors
    return [(*key, least, {w: sorted(m) for w, m in sorted(anchors.items())}) for key, (least, anchors) in sorted(out.items())]


def windows(docs: DataFrame, classes: list[tuple[int, int, int, dict[str, list[str]]]]) -> DataFrame:
    """doc_id, text_hash, size (N), k, at, words: the windows that hold an anchor of their class with a mate, and words enough.

    Anchors are looked up once a document; windows follow from their places, so a document
    without any costs one pass over its words.
    """
    known = lambda own: F.split(F.lit(" ".join(own)), " ")  # noqa: E731; one literal for all words
    anchor = lambda anchors: F.from_json(F.lit(json.dumps([{"word": w, "mates": m} for w, m in anchors.items()])), "array<struct<word: string, mates: array<string>>>")
    each = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(k).alias("k"), F.lit(least + k - 1).alias("least"), anchor(a).alias("anchors")) for n, k, least, a in classes])

    def cut(own: Column, places: Column, size: Column, z: Column, mine: Column) -> Column:
        here = F.filter(places, lambda p: F.exists(mine, lambda a: a["word"] == p["word"]))
        starts = F.array_distinct(F.flatten(F.transform(here, lambda p: F.array(p["at"] - p["at"] % size, p["at"] - p["at"] % size - size))))
        made = F.transform(F.filter(starts, lambda s: s >= 0), lambda s: F.struct(size.alias("size"), z["k"].alias("k"), s.alias("at"), F.slice(own, s + 1, 2 * size).alias("words")))
        whole = lambda w: F.exists(mine, lambda a: F.array_contains(w["words"], a["word"]) & F.arrays_overlap(w["words"], a["mates"]))
        return F.filter(made, lambda w: (F.size(w["words"]) >= z["least"]) & whole(w))

    def all_of(own: Column) -> Column:
        def placed(present: Column) -> Column:
            at = F.filter(F.transform(own, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: F.array_contains(present, p["word"]))
            mine = lambda z: F.filter(z["anchors"], lambda a: F.array_contains(present, a["word"]) & F.arrays_overlap(own, a["mates"]))
            of = lambda places: F.transform(each, lambda z: held(mine(z), lambda m: F.when(F.size(m) > 0, cut(own, places, z["size"], z, m)).otherwise(F.array().cast(kind))))
            return F.when(F.size(present) > 0, held(at, lambda places: F.flatten(of(places))))

        return held(F.array_intersect(own, known(sorted({a for *_, anchors in classes for a in anchors}))), placed)

    kind = "array<struct<size:int,k:int,at:int,words:array<string>>>"
    found = held(words(ascii_lower(F.col("text"))), all_of)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(found))


def shingles_of(own: Column, k: Column) -> Column:
    last = F.size(own) - k + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(own, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, text_hash, template, n, size, at, containment: the windows (start in words, 2 * size words) that hold a template."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = template_table(spark, templates)
    rows = known.collect()  # as many as templates
    if not rows:
        nothing = {"template": "string", "n": "int", "size": "int", "at": "int", "containment": "double"}
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()]).where("false")
    sizes = spark.createDataFrame([(r["template"], class_of(r["n"])[0]) for r in rows], "template string, size int")
    known = scratch.keep(known.join(F.broadcast(sizes), "template").select("template", "n", "size", "shingles", bands(F.col("shingles")).alias("bands")), "templates")
    found = scratch.keep(windows(docs, classes_of(rows)).select("*", bands(shingles_of(F.col("words"), F.col("k"))).alias("bands")), "windows")
    mine = found.select("doc_id", "text_hash", "size", "at", F.explode("bands").alias("band"))
    theirs = known.select("template", "size", F.explode("bands").alias("band"))
    met = mine.join(if_small(theirs, BROADCAST_ROWS), ["size", "band"]).select("doc_id", "text_hash", "size", "at", "template").distinct()
    met = met.groupBy("doc_id", "text_hash", "size", "at").agg(F.collect_list("template").alias("met")).withColumnsRenamed({"doc_id": "met_id", "text_hash": "met_hash", "size": "met_size", "at": "met_at"})
    same = F.col("doc_id").eqNullSafe(F.col("met_id")) & F.col("text_hash").eqNullSafe(F.col("met_hash")) & (F.col("size") == F.col("met_size")) & (F.col("at") == F.col("met_at"))
    asked = found.drop("bands").join(met, same).select("doc_id", "text_hash", "size", "at", shingles_of(F.col("words"), F.col("k")).alias("own"), F.explode("met").alias("template"))
    share = F.size(F.array_intersect("own", "wanted")) / F.size("wanted")
    tested = asked.join(if_small(known.select("template", "n", F.col("shingles").alias("wanted")), BROADCAST_ROWS), "template").withColumn("containment", share)
    return tested.where(F.col("containment") >= CONTAINMENT - 1e-9).select("doc_id", "text_hash", "template", "n", "size", "at", "containment")


def _enough(n: int) -> int:
    """Runs that two templates share to be rivals: half of the shorter; all if it is a notice."""
    return n if n < 20 else ceil(n / 2)


def rivals(templates: dict[str, str]) -> dict[str, list[str]]:
    """For each template those with which it shares half of the shorter (all of a notice), in runs of two words: one text can hold both by being one of them."""
    pairs = {}
    for name, text in templates.items():
        own = _python_words(text)
        pairs[name] = {*zip(own, own[1:])} or {(own[0],)} if own else set()
    holders: dict = {}
    for name, own in pairs.items():
        for p in own:
            holders.setdefault(p, []).append(name)
    out = {}
    for name, own in pairs.items():
        shared = Counter(o for p in own for o in holders[p] if o != name)
        if close := sorted(o for o, c in shared.items() if c >= _enough(min(len(own), len(pairs[o])))):
            out[name] = close
    return out


def _pairs(spark: SparkSession, templates: dict[str, str]) -> DataFrame | None:
    """template, rival, own_size, rival_size: the rivals of each template and both classes; None without any."""
    size = lambda name: class_of(len(_python_words(templates[name])))[0]
    rows = [(name, o, size(name), size(o)) for name, close in sorted(rivals(templates).items()) for o in close]
    return spark.createDataFrame(rows, "template string, rival string, own_size int, rival_size int") if rows else None


def best_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, text_hash, hits: array of the matches that no rival of theirs beats in an overlapping window, by containment and then by length.

    Windows of a class begin at multiples of its size, so a window meets four of the same or a
    larger class at most.  Of two rivals the one of the smaller class asks those places of the
    other for a match: the work follows the matches, however many one text has.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(matches(docs, templates), "found")
    pairs = _pairs(docs.sparkSession, templates)
    hit = F.struct("template", "n", "size", "at", "containment")
    if pairs is None:
        return found.groupBy("doc_id", "text_hash").agg(F.collect_list(hit).alias("hits"))
    pairs = F.broadcast(pairs)  # as many as the library has
    place = ["doc_id", "text_hash", "template", "at"]
    other = found.select(*[F.col(c).alias(f"other_{c}") for c in (*place, "n", "containment")])

    def met(mine: DataFrame, size: Column, wanted: Column, its_size: Column) -> DataFrame:
        """mine with the matches of the template `wanted`, of a class as large or larger, in windows that overlap."""
        first = F.floor((F.col("at") - 2 * its_size) / its_size + 1) * its_size
        places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (first + i * its_size).cast("int")), lambda a: (a > F.col("at") - 2 * its_size) & (a < F.col("at") + 2 * size))
        asked = mine.withColumn("wanted_at", F.explode(places)).withColumn("wanted", wanted)
        same = F.col("doc_id").eqNullSafe(F.col("other_doc_id")) & F.col("text_hash").eqNullSafe(F.col("other_text_hash")) & (F.col("wanted") == F.col("other_template")) & (F.col("wanted_at") == F.col("other_at"))
        return asked.join(other, same)

    better = lambda c, n, than_c, than_n: (F.col(c) > F.col(than_c)) | ((F.col(c) == F.col(than_c)) & (F.col(n) > F.col(than_n)))
    up = met(found.join(pairs.where("rival_size >= own_size"), "template"), F.col("own_size"), F.col("rival"), F.col("rival_size"))
    beaten = up.where(better("other_containment", "other_n", "containment", "n")).select(*place)
    # the larger one is asked by its smaller rivals
    down = met(found.join(pairs.where("rival_size < own_size").select(F.col("template").alias("larger"), F.col("rival").alias("template"), F.col("own_size").alias("larger_size"), F.col("rival_size").alias("small")), "template"), F.col("small"), F.col("larger"), F.col("larger_size"))
    beaten = beaten.unionByName(down.where(better("containment", "n", "other_containment", "other_n")).select(*[F.col(f"other_{c}").alias(c) for c in place])).distinct()
    lost = beaten.select(*[F.col(c).alias(f"lost_{c}") for c in place])
    same = F.col("doc_id").eqNullSafe(F.col("lost_doc_id")) & F.col("text_hash").eqNullSafe(F.col("lost_text_hash")) & (F.col("template") == F.col("lost_template")) & (F.col("at") == F.col("lost_at"))
    return found.join(lost, same, "left_anti").groupBy("doc_id", "text_hash").agg(F.collect_list(hit).alias("hits"))


def report(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names joined by commas), best (greatest containment, 0 if none) for every row of docs."""
    hits = best_matches(docs, templates)
    per = hits.select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.col("hits.template"))).alias("names"), F.array_max("hits.containment").alias("best"))
    per = Scratch(docs.sparkSession).keep(per.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash"), "licenses")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = own.join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))
