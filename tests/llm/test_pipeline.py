"""Stages of the corpus pipeline on repeated and null ids."""

import numpy as np

from corpus_pipeline import drop_near_duplicates


def test_near_dedup_keeps_each_text_once(spark):
    rng = np.random.default_rng(6)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(5, a), (5, b), (3, near), (5, b), (None, c), (None, c), (None, d), (7, d), (8, e), (9, e), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, near), (5, b), (None, c), (7, d), (8, e), (4, "")], key=repr)
