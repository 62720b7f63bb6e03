"""Documents to packed token sequences, in five stages.

Toxic documents go, one document of each near-duplicate group stays, contaminated
documents go, secrets are replaced by a mark, and what is left is packed. Each stage gets
all that its predecessor kept, with all columns of ``documents``; the last returns the
pieces of the packing. Empty tables pass through every stage. A stage's model is fitted on
the table folder (labels) or on the stage's own input (secrets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import common, decontaminate, near_copies, packing, secret_scan, simhash_dedup, toxicity
from evidentia.session import shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return toxicity.reject(docs, toxicity.train(labelled, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs, near_copies.members)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train(secret_scan.samples(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL cannot express the models, the components and the tokeniser: tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; results between stages are written to the shared folder."""
    folder = shared_folder(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
