"""Operator 6: document quality by attention-based multiple-instance learning.

Method. A document is a bag of passages of ``WORDS`` words, all of them, to its end. A passage is encoded by the
frequencies of its character-class trigrams (its shape: case, marks, blanks, ...) and by how much its words repeat. A
learned layer turns the encoding into h; gated attention weighs the passages,
``a_i ~ exp(w . (tanh(V h_i) * sigmoid(U h_i)))``, and a logistic unit scores the weighted sum of h. All parameters are
learned together from document labels alone, on a bounded sample (``sample_each`` labelled documents a class).

Scale. The labelled sample is drawn by a hash of the id and its ids are broadcast (bounded by ``2 * sample_each``, up to chance);
its encodings are fitted on the driver. Scoring is one map over the text, without a shuffle; the model has a constant size.

Defined cases. A null or word-less text has one empty passage and gets a score as any other. Unlabelled ids and null labels teach
nothing; of repeated labels the least counts. Without labels of both classes every score is 0.5. Other columns are
carried along, but for those named as results are; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import drawn_rows, fields, held_out, map_arrow, slices, texts, word_memo

WORDS = 80
CLASSES = 8
EXTRA = 4
DIMS = CLASSES**3 + EXTRA


def _classes() -> np.ndarray:
    """Byte -> class: other sign, lower, upper, digit, blank, sentence mark, symbol, beyond ASCII."""
    lut = np.zeros(256, np.int32)
    lut[97:123], lut[65:91], lut[48:58], lut[32], lut[128:] = 1, 2, 3, 4, 7
    lut[[ord(c) for c in ".,;:'\"-()?"]] = 5
    lut[[ord(c) for c in "#*$%&|<>!_=+/\\@~^{}[]"]] = 6
    return lut


def encode(raw: list[bytes], block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Passage encodings (float32 rows) and the number of passages of each text."""
    lut, take = _classes(), word_memo().__getitem__
    words = [t.split() or [b""] for t in raw]
    passages = np.array([-(-len(w) // WORDS) for w in words])
    cut = [w[i : i + WORDS] for w in words for i in range(0, len(w), WORDS)]
    del words
    out = np.empty((len(cut), DIMS), np.float32)
    for begin in range(0, len(cut), block):
        part = cut[begin : begin + block]
        total = len(part)
        held = np.array([len(w) for w in part])
        of_word = np.repeat(np.arange(total, dtype=np.int32), held)
        sizes = np.array([len(x) for w in part for x in w], np.int32) + 1
        c = lut[np.frombuffer(b" ".join([b" ".join(w) for w in part]) + b" ", np.uint8)]
        of_byte = np.repeat(of_word, sizes)
        same = of_byte[2:] == of_byte[:-2]
        code = (of_byte[:-2] * CLASSES**3 + c[:-2] * np.int32(CLASSES**2) + c[1:-1] * np.int32(CLASSES) + c[2:])[same]
        shape = np.bincount(code, minlength=total * CLASSES**3).reshape(total, -1).astype(np.float32)
        out[begin : begin + total, :-EXTRA] = np.sqrt(shape / np.maximum(shape.sum(axis=1, keepdims=True), 1))
        ids = np.frombuffer(b"".join([take(x) for w in part for x in w]), np.uint64) >> np.uint64(24)
        again = np.zeros(len(ids))
        again[1:] = (ids[1:] == ids[:-1]) & (of_word[1:] == of_word[:-1])
        keyed = np.sort(of_word.astype(np.uint64) << np.uint64(40) | ids)
        fresh = np.concatenate(([True], keyed[1:] != keyed[:-1]))
        distinct = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)
        # A word of 200 bytes is as long as can be told, so that no word outweighs the rest of the model.
        length = np.bincount(of_word, np.minimum(sizes - 1, 200), minlength=total)
        out[begin : begin + total, -EXTRA:] = np.stack([np.bincount(of_word, again, minlength=total) / held, distinct / held, length / held / 10, np.log1p(held) / 5], axis=1)
    return out, passages


class Model:
    def __init__(self, p: dict[str, np.ndarray] | None):
        self.p = p

    def score(self, x: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score, and each passage's attention."""
        if self.p is None:
            return np.full(len(passages), 0.5), np.ones(len(x))
        return forward(self.p, x, np.concatenate(([0], np.cumsum(passages)[:-1])), passages)[:2]


def forward(p, x, first, passages):
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), passages))
    a = e / np.repeat(np.add.reduceat(e, first), passages)
    z = np.add.reduceat(h * a[:, None], first, axis=0)
    s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
    return s.ravel(), a, h, t, g, z


def fit_bags(x: np.ndarray, passages: np.ndarray, y: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 120, seed: int = 11) -> Model:
    """Adam on the balanced logistic loss, all bags at once."""
    if len(set(y.tolist())) < 2:
        return Model(None)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.02}
    p = {"W": draw(x.shape[1], hidden), "b": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates), "w": draw(gates), "c": draw(hidden), "c0": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    first = np.concatenate(([0], np.cumsum(passages)[:-1]))
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)
    std = (x - fixed["mean"]) / fixed["scale"]
    for epoch in range(1, epochs + 1):
        s, a, h, t, g, z = forward(p | fixed, x, first, passages)
        ds = (s - y) * weight
        dz = ds[:, None] * p["c"]
        dz_rows = np.repeat(dz, passages, axis=0)
        da = (dz_rows * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(da * a, first), passages))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz_rows * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grads = {"W": std.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(axis=0), "c": z.T @ ds, "c0": np.array([ds.sum()])}
        for k in p:
            d = grads[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
    return Model(p | fixed)


def _bags(batches):
    for part in slices(batches):
        x, passages = encode(texts(part))
        ends = np.cumsum(passages)
        rows = [x[e - n : e].tobytes() for e, n in zip(ends, passages, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("quality")), pa.array(rows, pa.binary())], names=["quality", "bag"])


def fit(docs: DataFrame, labels: DataFrame, *, sample_each: int = 1000, most_bytes: int = 1 << 16) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, on about ``sample_each`` documents a class.

    A document that teaches has at most ``most_bytes`` bytes, so the driver holds at most ``2 * sample_each * most_bytes`` of
    text's encodings, whatever the corpus.
    """
    found = map_arrow(drawn_rows(docs, labels, sample_each, most_bytes), _bags, "quality int, bag binary").collect()
    rows = sorted((r["quality"], bytes(r["bag"])) for r in found)
    if len({q == 1 for q, _ in rows}) < 2:
        return Model(None)
    bags = [np.frombuffer(b, np.float32).reshape(-1, DIMS) for _, b in rows]
    return fit_bags(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(q == 1) for q, _ in rows]))


def _score(model: Model):
    def run(batches):
        for part in slices(batches):
            score = model.score(*encode(texts(part)))[0]
            more = [pa.array(score.astype(float)), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` with score and predicted; columns of ``docs`` with these names make way."""
    docs = docs.drop("score", "predicted")
    return map_arrow(docs, _score(model), f"{fields(docs)}, score double, predicted int")


def op6_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(3, 1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where("not held_out"), labels)
    return score_quality(docs.select("doc_id", "held_out", "text"), model).drop("text")
