"""Literal cases of the layout plans, the passes and the incremental sync."""

import pytest

from quire.operators.passes import Pass, run_passes
from quire.plans.dialect import Spark
from quire.plans.layout import contrast_of
from quire.streaming.sync import changes_of, next_state, sync


def test_contrast_on_white(spark):
    row = spark.sql(contrast_of(Spark(""), "select 1 as id, 245 as r, 172 as g, 0 as b, 255 as grey")).first()
    assert (row.r, row.g, row.b) == (0x9D, 0x6E, 0x00)


def test_good_contrast_stays(spark):
    row = spark.sql(contrast_of(Spark(""), "select 1 as id, 0 as r, 0 as g, 0 as b, 255 as grey")).first()
    assert (row.ratio, row.r) == (21.0, 0)


def test_passes_keep_their_order(spark):
    one = Pass("one", lambda df: df.selectExpr("id + 1 as id"))
    two = Pass("two", lambda df: df.selectExpr("id * 2 as id"), after=("one",))
    assert [r.id for r in run_passes(spark.range(2), [one, two]).collect()] == [2, 4]
    with pytest.raises(ValueError):
        run_passes(spark.range(2), [two, one])
    with pytest.raises(ValueError):
        run_passes(spark.range(2), [one, one])


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    rows = [(i, i % 5 if i % 7 else None, "ab"[(i * i) % 3 % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "n int, k int, s string")
    for part in range(3):
        frame.where(f"n >= {part * 20} and n < {part * 20 + 20}").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in/*"))
        sync(stream, str(tmp_path / "home"), key="k", order=["n"], seen="s")
    got = spark.read.parquet(str(tmp_path / "home/changes")).select("n", "change").collect()
    want = changes_of(frame, None, "k", ["n"], "s").select("n", "change").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 60


def test_state_keeps_other_keys(spark):
    state = spark.createDataFrame([(1, "a"), (None, "b")], "k int, s string")
    batch = spark.createDataFrame([(2, 0, "c"), (None, 1, "d")], "k int, n int, s string")
    got = next_state(batch, state, "k", ["n"], "s").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (2, "c"), (None, "d")], key=str)
