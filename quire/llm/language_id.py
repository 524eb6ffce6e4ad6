"""Operator 7: language identification by nearest centroid.

Method. A text, lower-cased and with ASCII non-letters as blanks, becomes counts of hashed byte n-grams (1 to 3),
weighted by 1 + log tf and inverse document frequency, and normalised. Each language has several centroids, from spherical
k-means over a bounded sample of its labelled texts (``sample_each`` texts a language, a documented bound; document
frequencies come from all of them). The nearest centroid by cosine gives the language. A text too far from its centroid
is rejected: no learned language is near. How far that is depends on how many different grams a text has (in powers of
two), for short or repeating texts lie farther out: its cosine is under 1 / ``reach`` of what 95 % of that language's
sampled texts of that class reach. A few junk labels so move nothing, and no bound falls to where every text passes.

Scale. Two passes over the text: one counts document frequencies (a vector a task), one predicts. The model is
``dims * clusters * languages`` floats, whatever the corpus, and goes to the tasks with the closure. No shuffle of text.

Defined cases. A null text or one without a letter is ``und`` with score 0, and rejected. Null languages teach nothing. A
corpus without any labelled text gives ``und`` for all. Repeated rows and ids are predicted each; other columns are carried
along, but for those named as results are.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fields, hash_below, held_out, map_arrow, sample_share, share_of, slices, texts

DIMS = 4096
#: Rows and bytes of text in a slice: a row takes 4096 counts, however short its text.
_SLICE = {"most_bytes": 1 << 20, "most_rows": 256}
CLASSES = DIMS.bit_length()  # of a text, by the power of two of its different grams
_BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]").search


def gram_counts(raw: list[bytes]) -> np.ndarray:
    """Counts (a row a text) of hashed byte 1- to 3-grams."""
    low = [t.decode().lower().encode().translate(_BLANK) for t in raw]
    sizes = np.array([len(t) + 2 for t in low])
    u = np.frombuffer(b"".join([t + b"  " for t in low]), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.uint32) * np.uint32(DIMS), sizes)
    out = np.zeros(len(low) * DIMS, np.int32)
    for n in (1, 2, 3):
        code = np.full(len(u) - n + 1, n, np.uint32)
        for i in range(n):
            code = (code + u[i : len(u) - n + 1 + i]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        keep = u[: len(code)] != 32 if n == 1 else slice(None)
        at = (row[: len(code)] + (code & np.uint32(DIMS - 1)))[keep]
        out += np.bincount(at, minlength=len(out)).astype(np.int32)
    return out.reshape(-1, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1).astype(np.float32)), np.float32(0)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, clusters: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(rounds):
        best = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[best == c].sum(axis=0) if (best == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def gram_classes(x: np.ndarray) -> np.ndarray:
    """The class of each row, by how many grams it has, however often."""
    return np.log2(np.maximum((x > 0).sum(axis=1), 1)).astype(int)


def least_cosines(cosine: np.ndarray, classes: np.ndarray, reach: float, fewest: int = 20) -> np.ndarray:
    """For each class the least cosine that isn't rejected; neighbouring classes are taken together up to ``fewest`` texts."""
    out, begin = np.zeros(CLASSES), 0
    for c in range(CLASSES):
        inside = (classes >= begin) & (classes <= c)
        rest = (classes > c).sum()
        if c + 1 < CLASSES and (inside.sum() < fewest or rest < fewest):
            continue
        out[begin : c + 1] = np.quantile(cosine[inside], 0.05) / reach
        begin = c + 1
    return out


def _frequencies(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for part in slices(batches, **_SLICE):
        counts = gram_counts(texts(part))
        total += (counts > 0).sum(axis=0)
        n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["i", "n"])


def _encode(batches):
    for part in slices(batches, **_SLICE):
        rows = gram_counts(texts(part))
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["lang", "counts"])


class Model:
    """idf, unit centroids, the language of each, and the least cosine of each, by class of text, that isn't rejected."""

    def __init__(self, idf, centroids, languages, least):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def predict(self, raw: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        has = np.array([_LETTER(t.decode()) is not None for t in raw])
        if not self.languages:
            return ["und"] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
        counts = gram_counts(raw)
        near = weighted(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.where(has, np.clip(near[np.arange(len(raw)), best], 0, 1), 0).astype(float)
        names = [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
        return names, score, ~has | (score < np.asarray(self.least)[best, gram_classes(counts)])


def fit(labelled: DataFrame, *, clusters: int = 4, sample_each: int = 400, reach: float = 1.4, most_bytes: int = 1 << 20) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``.

    Document frequencies come from all rows. Centroids and bounds come from about ``sample_each`` texts a language, each of
    at most ``most_bytes`` bytes; of a repeated doc_id one row (the least text) is drawn, a null doc_id is not.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    summed = map_arrow(labelled.select("text"), _frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    df = dict(summed.collect())
    n = df.pop(DIMS, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(DIMS)], np.float32)
    counts = dict(labelled.groupBy("lang").count().collect())
    share = sample_share(counts, sample_each)
    if not share:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], [])
    sample = labelled.where(hash_below("doc_id", share_of(share, "lang"))).where(F.octet_length("text") <= most_bytes)
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("x.*")
    drawn: dict[str, list] = {}
    for r in map_arrow(sample, _encode, "lang string, counts binary").collect():
        drawn.setdefault(r["lang"], []).append(bytes(r["counts"]))
    centroids, languages, least = [], [], []
    for lang in sorted(drawn):
        x = weighted(np.stack([np.frombuffer(zlib.decompress(b), np.int32) for b in sorted(drawn[lang])]), idf)
        own = spherical_kmeans(x, clusters)
        bounds = least_cosines((x @ own.T).max(axis=1), gram_classes(x), reach)
        centroids.append(own)
        languages += [lang] * len(own)
        least += [bounds] * len(own)
    if not centroids:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], [])
    return Model(idf, np.concatenate(centroids), languages, least)


def _predict(model: Model):
    def run(batches):
        for part in slices(batches, **_SLICE):
            names, score, rejected = model.predict(texts(part))
            more = [pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` with lang_pred, score, rejected; columns of ``docs`` with these names make way."""
    docs = docs.drop("lang_pred", "score", "rejected")
    return map_arrow(docs, _predict(model), f"{fields(docs)}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
