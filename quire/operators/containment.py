"""Which documents hold which passages, anywhere in the text: one automaton of all passages, one scan of each text.

The passages are a small separate table of bounded texts; they go to the tasks whole. Documents are neither collected nor
joined: a text is read once, to its end, whatever the number of passages, and only its hits are shuffled, keyed by document
and passage, so a passage that every document holds weighs on no single task.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quire

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(quire)


def _scan(passages: list[str]):
    def run(batches):
        automaton = ahocorasick.Automaton()
        for i, passage in enumerate(passages):
            automaton.add_word(passage, i)
        automaton.make_automaton()
        for batch in batches:
            hits = [sorted({i for _, i in automaton.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
            rows = pa.array([r for r, found in enumerate(hits) for _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([i for found in hits for i in found], pa.int32())], names=["doc_id", "passage"])

    return run


def contained_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` that hold a passage of ``passages(text)``: doc_id and how many different ones, ``passages``.

    Passages are trimmed of blanks; null and empty ones are none. Rows of one doc_id count together; null is an id as any.
    """
    trimmed = passages.select(F.trim("text").alias("text")).where("text <> ''").distinct()
    known = sorted(r["text"] for r in trimmed.collect())
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not known:
        return docs.selectExpr("doc_id", "0L as passages").where("false")
    hits = docs.select("doc_id", "text").mapInArrow(_scan(known), f"doc_id {kind}, passage int")
    return hits.distinct().groupBy("doc_id").agg(F.count("*").alias("passages"))


def bench_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
