"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on all rows that the stage before it kept, and decides for
good: rejected documents, repeated lines, near copies and contaminated documents
are gone for the stages that follow.  SQL can't express the trained classifier,
so there is no SQL for the whole; a test recomputes all stages by their
definitions over a small corpus and compares the rows of ``run``.

Cases: what the operators say of nulls, ties, repeated rows and long texts holds
for each stage.  A null or empty text is scored by the bias alone, repeats
nothing, resembles nothing and has size 0, so the mix leaves it out.  Without
labels every score is 0.5, which passes; without a benchmark nothing leaks; an
empty table gives an empty mix.  Rows of one doc_id are told apart by their
texts: a text that is nowhere else stays, though another row of its id is a copy.
Columns that clash with those that a stage adds keep their place and values, but
for copy and virtual_finish, which the mix replaces.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_classifier
from riskloom.llm._spark import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage: Stage) -> Stage:
    """Gives further columns names of their own while a stage runs, so that none clashes with those that operators add."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in DOCUMENT else f"_own_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run


@_own_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=tuple(docs.columns)).where("predicted = 1").select(*docs.columns)


@_own_names
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines deleted; a document is dropped only where no word of it is left."""
    out = line_dedup.line_dedup(docs)
    kept = out.where((F.col("n_words_removed") == 0) | (F.col("n_words_removed") < F.col("n_words")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id; different texts of one doc_id are told apart."""
    return jaccard_join.one_of_each(docs)


@_own_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, with copy (0 for the first pass) and virtual_finish."""
    return mixing.ordered(mixing.mix(docs)[1], docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the cluster's shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
