"""The corpus pipeline: stages over the documents table, each written as Parquet and reread by the next.

1. toxicity: documents that their nearest labelled examples call toxic go.
2. quality: documents that the classifier calls poor go.
3. near_dedup: one document of each class of near copies stays.
4. decontamination: documents that hold a benchmark item go.
5. encode: what is left is encoded, and decoded again.

Both learned stages leave the labelled rows that the queries hold out unlearned, so that their held-out accuracy holds here too.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import bpe, decontaminate, near_dedup, quality_classifier, toxicity
from graftline.llm.queries import remainder
from graftline.llm.rows import quoted
from graftline.plans.lineage import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keep(docs: DataFrame, scored: DataFrame, predicted: int) -> DataFrame:
    return scored.filter(F.col("predicted") == predicted).select(*[quoted(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _keep(docs, toxicity.score(docs, labels, train=remainder(5) != 0), 0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _keep(docs, quality_classifier.score(docs, labels, train=remainder(3) != 1), 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("encode", encode)]

#: SQL has no form for learned scores, sampled tables or merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each one's rows written to the shared folder and read again."""
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}-{name}")
        docs = spark.read.parquet(f"{at}/{n}-{name}")
    return docs
