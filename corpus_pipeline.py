"""The training-data pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents with
copies of benchmark items go, and what is left is mixed to target weights per source.

Every stage but the last returns the columns of the documents it got. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from sparkraster.llm.common import table, unused
from sparkraster.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of the whole table, held-out rows excepted, and scores the documents given."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.is_held_out(F.col("doc_id")))
    (score,) = unused(docs, "toxic_score")
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("MinHash near-dedup", dedup_documents),
          ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix_sources)]
ORACLE_SQL = None  # a trained classifier and sketches are not SQL; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
