"""Incremental sync: a file stream of observations against the last known state of every key.

Each micro-batch is one declarative plan: a keyed window finds each observation's predecessor within the batch, and a
key's first observation is joined with the state that earlier batches left. Changes and the next state are tables named
after the batch and overwritten when a batch is replayed, so a lost executor or a restart repeats no change.
The state is one row a key. A key's observations are sorted by Spark, which spills; Python sees none of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import shared_dir


def changes_of(batch: DataFrame, state: DataFrame | None, key: str, order: list[str], seen: str) -> DataFrame:
    """``batch`` with ``change``: new, updated or unchanged, against the key's observation before."""
    line = Window.partitionBy(key).orderBy(*order)
    rows = batch.withColumn("_nth", F.row_number().over(line)).withColumn("_before", F.lag(seen).over(line))
    known = F.lit(False)
    if state is not None:
        last = state.select(F.col(key).alias("_key"), F.col(seen).alias("_last"))
        rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
        known = F.col("_nth") == 1
        known &= F.col("_key").isNotNull() | F.col("_last").isNotNull()
        rows = rows.withColumn("_before", F.when(known, F.col("_last")).otherwise(F.col("_before")))
    first = (F.col("_nth") == 1) & ~known
    change = F.when(first, "new").when(F.col("_before").eqNullSafe(F.col(seen)), "unchanged").otherwise("updated")
    return rows.withColumn("change", change).select(*batch.columns, "change")


def next_state(batch: DataFrame, state: DataFrame | None, key: str, order: list[str], seen: str) -> DataFrame:
    """The last observation of every key. Later batches are later observations."""
    last = batch.groupBy(key).agg(F.max_by(seen, F.struct(*order)).alias(seen))
    if state is None:
        return last
    kept = state.join(last.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.select(key, seen).unionByName(last)


def sync(stream: DataFrame, home: str, *, key: str, order: list[str], seen: str) -> None:
    """Run ``stream`` to the end of what there is; changes go to ``home/changes/batch=N``, the state to ``home/state/N``."""
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, n: int) -> None:
        state = spark.read.parquet(f"{home}/state/{n - 1}") if n else None
        batch = batch.select(key, *[c for c in order if c != key], seen)
        changes_of(batch, state, key, order, seen).write.mode("overwrite").parquet(f"{home}/changes/batch={n}")
        next_state(batch, state, key, order, seen).write.mode("overwrite").parquet(f"{home}/state/{n}")

    run = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    run.awaitTermination()


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a file stream: every event is an observation of its user's state (its type)."""
    home = f"{shared_dir(spark)}/quire/sync-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    sync(stream, home, key="user_id", order=["ts", "event_id"], seen="event_type")
    return spark.read.parquet(f"{home}/changes").select("event_id", "user_id", "change")


QUERIES = {"stream_sync": stream_sync}
ORACLE_SQL = {
    "stream_sync": """
select event_id, user_id, case when n = 1 then 'new' when before is not distinct from event_type then 'unchanged' else 'updated' end as change from (
  select *, row_number() over w as n, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id)) x"""
}
