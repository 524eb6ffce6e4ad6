"""The registered queries on the smallest tables: columns, types, splits and what SQL can say about their results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import attention_quality, crf_lines, language_id
from quire.llm.piece_viterbi import encode
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONGS = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
WANTED = {
    "op1_minhash_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_harmonic_packing": dict.fromkeys("doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), "bigint"),
    "op4_histogram_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_crf_lines": {"doc_id": "bigint", **dict.fromkeys(LONGS, "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op6_attention_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_context_tree": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(WANTED))
def test_contract(spark, db, name):
    out = QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in WANTED[name]} == WANTED[name]
    rows = out.select(*WANTED[name]).collect()
    docs = {i: t for i, t in db.sql("select doc_id, text from documents").fetchall()}
    if "doc_id" in WANTED[name] and name != "op3_harmonic_packing":
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if "held_out" in WANTED[name]:
        mod, rest = (7, 2) if name.startswith("op8") else (3, 1)
        of = {r["id"]: r["c"] for r in spark.createDataFrame([(i,) for i in docs], "id long").select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()}
        assert all(r["held_out"] == (of[r["doc_id"]] % mod == rest) for r in rows)
    if name == "op5_crf_lines":
        want = db.sql("""select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n, len(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as c,
          len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as s from documents""").fetchall()
        assert {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"]) for r in rows} == set(want)
        assert all(not (r["base_failed"] and r["kept"]) and r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows)
    if name == "op8_context_tree":
        n = {r["train_tokens"] for r in rows}
        assert n == {sum(r["n_tokens"] for r in rows if not r["held_out"])} and all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"])
    if name == "op4_histogram_shards":
        sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 0.05 * max(sizes) + max(r["size"] for r in rows)


def test_clashing_columns_make_way(spark):
    """Columns that are named as results go; the others come along."""
    text = "some words of a text that is long enough to be told from others\n" * 3
    d = spark.createDataFrame([(1, text, 1.5, True, "x", 7, [1], "d", 2, 3), (1, None, None, None, None, None, None, None, None, None)], "doc_id long, text string, score double, kept boolean, lang_pred string, n_words int, ids array<int>, decoded string, predicted int, keep int")
    for out, found in (
        (crf_lines.judge_lines(d, crf_lines.Model()), "kept"),
        (attention_quality.score_quality(d, attention_quality.Model(None)), "predicted"),
        (language_id.identify(d, language_id.fit(d.select("doc_id", "text", "lang_pred").withColumn("lang", F.lit("en")))), "lang_pred"),
        (encode(d, __import__("public_tokenizers").path("piece_bpe_32k.model")), "ids"),
    ):
        assert len(set(out.columns)) == len(out.columns) and found in out.columns and "keep" in out.columns
        assert sorted((r["keep"] is None, r["doc_id"]) for r in out.collect()) == [(False, 1), (True, 1)]


def test_very_long_words_and_texts(spark):
    rows = [(i, ("good words here and there " * 40) if i % 2 else "BAD!! " * 200) for i in range(40)] + [(90, "w" * 700_000), (91, "a b " * 300_000), (92, ""), (92, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(40), 90, 91]], "doc_id long, quality int, toxic int")
    for r in attention_quality.score_quality(d, attention_quality.fit(d, labels, most_bytes=1 << 20)).collect():
        assert 0 <= r["score"] <= 1
    assert crf_lines.judge_lines(d, crf_lines.fit(d, labels)).count() == 44
