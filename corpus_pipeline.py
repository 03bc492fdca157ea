"""From raw documents to a training mix, one stage after another.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns the mix. Stages are written as Parquet in the shared
folder and read again, so each starts from files and no plan spans two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, jaccard, mixing, pii, quality
from strata.llm.registry import load, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest doc_id stays, null being
    the largest. Rows are told apart by a number of their own, so ids may be null or
    repeated; texts without words are in no class and stay."""
    # the document travels as one struct, so that no name of its columns is taken
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), "rows")
    found = jaccard.linked(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    classes = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"))
    placed = written(classes.join(rows.select("row", F.col("doc.doc_id").alias("doc_id")), "row"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = placed.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = placed.select("row").join(first, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    hidden = pii.redacted(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("mixing sources", source_mixing),
]

# Perplexity bands, entropy balancing and the span classifier are not SQL; the stages
# are tested against brute force in tests/llm/test_mixing_and_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
