"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents.
A stage's result must be written before the next stage is called, which removes the tables that the result was computed from.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import mixing, neardup, packing, pii, quality
from panelmill.llm.common import free_name, noted, removed, table, written
from panelmill.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Key of the pseudonyms; a production run brings its own.
KEY = "panelmill"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; the rest lose the lines that too many documents of their host share.

    Null and empty texts are rejected (they have no words); an empty table stays empty; extra columns stay as they are.
    """
    row, = free_name(docs, "_row")
    held = docs.select("text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    out = quality.quality_rules(held).where("kept")
    return out.select(*[F.col("clean_text").alias(c) if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Rows that repeat an id and its text are one document. Documents without an id cannot be chosen by it and stay; so do those without words.
    """
    marks = neardup.near_duplicates(docs.select("doc_id", "text"), 5, 80).where("doc_id is not null")
    ids = marks.groupBy("doc_id").agg(F.bool_and("kept").alias("_stays"), (F.count("*") > 1).alias("_again")).where("not _stays or _again")
    # one exchange of the texts, planned alike at every size
    stay, again = free_name(docs, "_stays", "_again")
    ids = written(ids.withColumnsRenamed({"_stays": stay, "_again": again}))
    told = docs.join(ids.hint("merge"), "doc_id", "left").where(F.coalesce(stay, F.lit(True)))
    once = told.where(F.coalesce(~F.col(again), F.lit(True)))
    more = told.where(again).dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; null texts stay null and extra columns stay as they are."""
    row, = free_name(docs, "_row")
    out = pii.pseudonymise(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)), KEY)
    return out.select(*[F.col("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its fitted rate says: some go, some are repeated. Texts without words go."""
    row, = free_name(docs, "_row")
    held = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    out = mixing.mix_sources(held, table(spark, sf_dir, "labels")).where("copies > 0")
    out = out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' tokens in sequences of 2048: one row for each piece."""
    return packing.pack(docs, vocabulary(), 2048)


#: Tables of the stage that ran last.
_LAST: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage that first removes what the stage before it wrote on its way: that one's result is a table by now."""

    @functools.wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _LAST)
        with noted(_LAST):
            return fn(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stage(quality_stage)),
    ("near_duplicates", stage(near_duplicate_stage)),
    ("personal_data", stage(pii_stage)),
    ("mixing", stage(mixing_stage)),
    ("packing", stage(packing_stage)),
]

#: SQL can express neither the classifier nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written as a table that the next one reads, and removed when that one is written."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, work in STAGES[:-1]:
        made: list[str] = []
        out = work(spark, docs, sf_dir)
        with noted(made):
            docs = written(out)
        removed(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
