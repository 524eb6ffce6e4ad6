"""The corpus pipeline: language id, quality, near-duplicates, packing.

Each stage takes what the one before kept. The first three return the columns of ``documents``; packing returns
the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import attention_quality, language_id
from quire.llm.common import written
from quire.llm.harmonic_packing import harmonic_packing
from quire.llm.near_dedup import near_duplicates

#: No stage but packing is expressible in SQL row for row: models are learned and a near-duplicate's group is kept by them.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a learned language stay; those without a letter, or far from every centroid, go."""
    model = language_id.fit(docs)
    return language_id.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, scores 0.5 or more stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = attention_quality.fit(docs, labels)
    return attention_quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8 or more) the row of the smallest doc_id stays, once.

    Rows are told apart by a number of their own, so different texts of one doc_id are judged each, and so are rows
    without an id; a null counts as the largest.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    judged = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    kept = rows.select("doc_id", "row").join(judged, "row").groupBy("component").agg(first).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 1024 tokens."""
    return harmonic_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
