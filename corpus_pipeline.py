"""From raw documents to token ids: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of documents.  In every stage null texts count as
empty, rows with null ids are kept or dropped by their text alone, and empty tables give
empty tables.

Texts are wide rows: what is held of them at once is bounded by bytes, not by the thousands
of rows that are Spark's defaults (see BATCHES).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontamination, line_dedup, nbsvm, ngram_join
from tessera.llm.queries import table
from tessera.llm.textkit import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Set by each stage where the session leaves them at their defaults, for as long as it lives, as the result is read later.
#: Bytes of texts that are handed to a Python worker at once (64 MB), rows whose texts lie decoded in a reader's one growing array (4,096).
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def in_batches(stage: Stage) -> Stage:
    """The stage, with the session's batches bounded; results do not depend on them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among them, does not reject.

    A score of 0.5, as all get without labels of both kinds, is no rejection.  Rows that repeat a text score alike.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~nbsvm.held_out(F.col("doc_id"), 3, 1))
    return docs.where(nbsvm.score(F.col("text"), nbsvm.train(docs, labels)) >= 0.5)


@in_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that came earlier, by doc_id; a document of which nothing is left goes.

    Rows that share an id do not see each other's lines; one that had no line, null texts too, stays as it is.
    """
    got = line_dedup.dedup(docs).where("n_deleted = 0 or text rlike '[^ \\\\t\\\\r\\\\n]'")
    return got.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@in_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that links of similarity connect; rows that share an id stay or go together."""
    gone = ngram_join.join(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@in_batches
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth of the words.

    Rows that repeat id and text go or stay together; texts and items without words match nothing.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@in_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256 (of the bytes that the ids decode to) of every row; no ids for null and empty texts."""
    out = docs.select("doc_id", "lang", "source", byte_bpe.encode_checked(F.col("text")).alias("got"))
    return out.select("doc_id", "lang", "source", F.size("got.ids").cast("long").alias("n_tokens"), "got.ids", "got.decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("tokens", tokens)]

#: A fitted model, a similarity join and byte-pair merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
