"""Searches of whole texts against ``contains`` in DuckDB, in SQL of its own, and Python."""

import duckdb
import pytest

from quire.operators.containment import contained_passages
from quire.plans.catalogue import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_bench_contains_whole_texts(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = sorted(map(tuple, QUERIES["bench_contains"](spark, sf_dir).select("doc_id", "passages").collect()))
    want = duckdb.sql(f"""
select doc_id, count(distinct b.item) as passages from '{sf_dir}/documents.parquet' d
join (select distinct trim(text) as item from '{sf_dir}/benchmark.parquet') b on contains(d.text, b.item) group by doc_id order by doc_id""").fetchall()
    assert got and got == want


def test_passages_anywhere(spark):
    docs = [(1, "so one two\nthree. "), (1, "x one two"), (2, "one twoone two"), (3, "one\ntwo"), (4, None), (None, "aone twob"), (5, ""), (6, "éa b")]
    passages = [(" one two ",), ("one two",), ("two\nthree",), ("wo",), (None,), ("  ",), ("éa",)]
    got = contained_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "text string"))
    assert {tuple(r) for r in got.collect()} == {(1, 3), (2, 2), (3, 1), (None, 2), (6, 1)}
    assert contained_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_catalog_select_whole_texts(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    got = sorted(map(tuple, QUERIES["catalog_select"](spark, sf_dir).select("doc_id", "source").collect()), key=repr)
    rows = duckdb.sql(f"select doc_id, source, text from '{sf_dir}/documents.parquet'").fetchall()
    assert got == sorted(((i, s) for i, s, t in rows if str(i).startswith("12") or s == "src3" or "the" in (t or "").lower()), key=repr)
