"""A training corpus from raw documents: quality, near copies, privacy, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The
result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fenceline import ship  # noqa: E402
from fenceline.functions.lineage import shared_folder  # noqa: E402
from fenceline.llm import mixing, packing, pii, quality, simhash  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects (score under 0.3)."""
    ship(spark)
    _, model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near copies."""
    ship(spark)
    return simhash.one_of_each(docs)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a placeholder over personal data."""
    ship(spark)
    return pii.redact(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out sources to their target weights."""
    return mixing.mixed_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of fixed length, one row per piece."""
    ship(spark)
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("pii", private_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

#: Fitting, hashing, drawing and packing have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what stages hand on lies in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
