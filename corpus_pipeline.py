"""The corpus pipeline: five stages, each one of the corpus operators, from documents to sequences.

``run`` writes every stage's result as Parquet to the shared folder (``spark.checkpoint.dir``) and
reads it back as the next stage's documents, so a lost executor never costs more than a stage. All
stages but the last return the columns of ``documents``; rows keep every column they came with,
and ``n_chars`` follows the text.

Stages: ``toxicity`` drops documents whose score reaches the threshold, ``line_dedup`` drops lines
that ten documents share (a document without lines left stays, empty), ``near_dedup`` leaves the
smallest id of every group of near copies, ``decontamination`` drops documents that hold a
benchmark item, ``packing`` gives every piece of the remaining documents its place in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vetframe.llm import decontamination, lines, packing, simhash, toxicity
from vetframe.llm.base import find_package, stored
from vetframe.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold.

    The lexicon is learnt from the labels of all folds, on the documents that the stage is given.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    kept = lines.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A learnt lexicon, SimHash groups and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; the last stage's rows."""
    find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
