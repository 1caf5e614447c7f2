"""A cleaning pipeline over ``documents``, stage by stage.

Each stage is a function ``(spark, docs, sf_dir)`` that returns a DataFrame,
which ``run`` writes to the shared folder and reads again for the next stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.storage import stored
from codelake.llm import contamination, langid, near, pieces, quality
from codelake.llm.spread import remainder

LEAST_CONFIDENCE = 0.5
LEAST_QUALITY = quality.THRESHOLD

#: SQL expresses none of the trained stages; tests compare ``run`` with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: not ``und``, and of at least ``LEAST_CONFIDENCE``."""
    model = langid.train(docs, remainder(F.col("doc_id"), 3) != 1)
    return langid.sure_rows(docs, model, LEAST_CONFIDENCE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least ``LEAST_QUALITY`` stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return quality.good_rows(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id."""
    return near.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay unless a twentieth or more of their words stand in benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.clean_rows(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents that are left."""
    return pieces.encode(docs, "doc_id", "lang", "source")


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
