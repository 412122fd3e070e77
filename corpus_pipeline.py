"""The corpus pipeline: quality, repeated lines, near copies, benchmark leaks and tokens, each stage written and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import bpe, decontaminate, jaccard, linededup, quality
from breakwater.llm.queries import RANKS, learn_quality, table
from breakwater.plans.lineage import shared_dir

#: The stages need models and fingerprints that SQL cannot express.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject; it learns from the labels outside the held-out fold."""
    return quality.keep_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of windows that stand earlier; texts change, and ``n_chars`` with them.

    Those that this emptied go; null and empty texts that came in stay.
    """
    came = docs.withColumn("__empty", F.coalesce(F.col("text") == "", F.lit(True)))
    out = linededup.drop_repeated_lines(came).withColumn("n_chars", F.length("text").cast("long"))
    return out.where("__empty OR text <> ''").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return jaccard.drop_similar(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids' digest and its decoded bytes' digest."""
    return bpe.bpe_roundtrip(docs, public_tokenizers.path(RANKS))


STAGES = [("quality", good), ("lines", lines), ("near", near), ("decontaminate", clean), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
