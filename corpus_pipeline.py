"""The corpus pipeline: five stages over documents, each of which reads what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomsieve.llm import decontam, jaccard, packing, passages, quality_rules
from loomsieve.llm.queries import tokenizer_path
from loomsieve.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each linked group stays."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents that lose all words go."""
    return passages.remove(docs, passages.passages(docs))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed into windows of 1024 ids."""
    return packing.pack(docs, packing.PackConfig(tokenizer_path()))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", contamination),
    ("packing", pack),
]

#: Forests, components and alignments aren't expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
