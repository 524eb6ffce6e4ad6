"""Shared plumbing of the training-data operators: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quire
from quire.sources.shared import shared_dir

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(quire)

#: ASCII white space, as in the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, so that a batch of long texts is as small as one of short texts.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES``, but for a longer row. Sets the session's bound if that is wider."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(key).lower().rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fields(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. The folder's owner removes old runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"path": path})


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing will read again."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.schema[0].metadata["path"])
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(mod: int, rest: int, key: str = "doc_id"):
    """The contract's split: crc32 of the id as text, modulo ``mod``, equals ``rest``. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == rest, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20, text: tuple[str, ...] = ("text",), most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most_bytes`` of the text columns (one row at least) and at most ``most_rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = [pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(t))), 0).to_numpy(zero_copy_only=False) for t in text]
        begin = held = 0
        for i, n in enumerate(sum(lengths).tolist()):
            if i > begin and (held + n > most_bytes or i - begin == most_rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def per_worker(key, make):
    """``make()`` once for each Python worker, not for each task: memos and automata outlive a task."""
    home = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def latest_per_worker(name: str, key: str, make):
    """As :func:`per_worker`, but a worker holds one value a name: another key's value goes before the new one is made."""
    home = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if home.get(name, (None,))[0] != key:
        home.pop(name, None)
        home[name] = key, make()
    return home[name][1]


class Memo(dict):
    """A dictionary that fills itself through ``make`` and starts anew at ``most`` entries, so its memory is bounded."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_memo() -> Memo:
    """word -> the 8 bytes of its hash."""
    return per_worker("words", lambda: Memo(xxhash.xxh3_64_digest, 200_000))


def sample_share(counts: dict, most: int) -> dict:
    """For each class the share of rows, as a fraction of the hash range, that gives about ``most`` rows."""
    return {k: min(1.0, most / max(n, 1)) for k, n in counts.items()}


def share_of(share: dict, column: str):
    """The share of a row's class, 0 where there is none."""
    pairs = [F.lit(x) for pair in share.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0.0)) if pairs else F.lit(0.0)


def hash_below(key: str, share):
    """Whether a row is in the sample: its id's 64-bit hash decides, so every run draws the same rows. A null id is in none."""
    hashed = F.xxhash64(F.col(key), F.lit(29)).cast("double")
    return F.col(key).isNotNull() & (hashed <= (share * 2 - 1) * F.lit(2.0**63)) & (share > 0)


def drawn_rows(docs: DataFrame, labels: DataFrame, each: int, most_bytes: int) -> DataFrame:
    """(quality, text) of about ``each`` labelled documents a class whose text has at most ``most_bytes`` bytes.

    Of repeated labels the least counts, of rows that repeat a doc_id the least text. Null ids and labels teach nothing.
    """
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.join(rows.select("doc_id").distinct(), "doc_id")
    share = sample_share(dict(marks.groupBy("quality").count().collect()), each)
    drawn = docs.sparkSession.createDataFrame(marks.where(hash_below("doc_id", share_of(share, "quality"))).collect(), marks.schema)
    found = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("quality", "text")).alias("x"))
    return found.select("x.quality", "x.text")
