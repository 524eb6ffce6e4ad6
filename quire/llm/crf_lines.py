"""Operator 5: quality rules with line labelling by a linear-chain conditional random field.

Method. A text's lines are a sequence; each line has features (its make-up by character class, words, repeats, ends).
A linear-chain CRF with the labels content (0) and boilerplate (1) is trained by conditional likelihood on a bounded
sample of documents with a quality label (``sample_each`` a class). What stands for boilerplate there is no input of the
model: the lines of poor documents, and lines that two or more of the sampled documents share; other lines of good documents
stand for content. How stiff the transitions are is chosen by the likelihood of a fifth of the sample that isn't learned
from, against a model without transitions. Viterbi decoding labels every line of
every whole text; the words' characters in content lines, as a share of all, must reach ``least_share`` for a document to stay. Base rules
(word count, words in repeated 5-word windows) fail a document beforehand.

Scale. One map over the text without a shuffle; the model is a few hundred numbers. Memory is bounded by slices of the
Arrow batch (and by the longest text). Training ids are broadcast (``2 * sample_each`` of them, up to chance).

Defined cases. A null or word-less text has zero counts and fails the base rules (fewer than 10 words). Without labels
of both classes the CRF takes every line as content. Other columns are carried along, but for those named as results are;
repeated rows are judged each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quire.llm.common import drawn_rows, fields, held_out, map_arrow, slices, texts, word_memo
from quire.llm.minhash_kernel import mix64

_SPACES = b" \t\n\r\x0b\x0c"
_KINDS = 8
_NOTICE = (b"licensed under", b"all rights reserved", b"copyright")
DIMS = _KINDS + 12


def _kinds() -> np.ndarray:
    """Byte -> kind: other, lower, upper, digit, white space, sentence mark, symbol, beyond ASCII."""
    lut = np.zeros(256, np.int64)
    lut[97:123], lut[65:91], lut[48:58], lut[128:] = 1, 2, 3, 7
    lut[list(_SPACES)] = 4
    lut[[ord(c) for c in ".,;:'\"-()?!"]] = 5
    lut[[ord(c) for c in "#*$%&|<>"]] = 6
    return lut


def measure(raw: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each text; line features, word characters of each line, lines of each text."""
    take = word_memo().__getitem__
    n_docs = len(raw)
    lines = [t.split(b"\n") for t in raw]
    n_lines = np.array([len(x) for x in lines])
    first_line = np.concatenate(([0], np.cumsum(n_lines)))
    flat = [x for doc in lines for x in doc]
    total = len(flat)
    doc_of = np.repeat(np.arange(n_docs), n_lines)
    words = [x.split() for x in flat]
    per_line = np.array([len(w) for w in words])
    line_of = np.repeat(np.arange(total), per_line)

    blob = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(x) for x in flat]) + 1
    kind = _kinds()[blob]
    kind[np.cumsum(sizes) - 1] = 4
    byte_line = np.repeat(np.arange(total), sizes)
    made = np.bincount(byte_line * _KINDS + kind, minlength=total * _KINDS).reshape(total, _KINDS)
    points = (kind != 4) & ((blob & 0xC0) != 0x80)
    chars = np.bincount(byte_line, points, minlength=total).astype(np.int64)

    again = np.zeros(total, bool)
    at = 0
    for doc in lines:
        seen = set()
        for x in doc:
            if x in seen:
                again[at] = True
            elif per_line[at]:
                seen.add(x)
            at += 1

    codes = np.frombuffer(b"".join([take(x) for w in words for x in w]), np.uint64)
    word_doc = doc_of[line_of]
    covered = np.zeros(len(codes) + 1, np.int64)
    n_windows = max(len(codes) - 4, 0)
    if n_windows:
        h = word_doc[:n_windows].astype(np.uint64)
        for i in range(5):
            h = mix64(h + codes[i : i + n_windows])
        whole = np.flatnonzero(word_doc[:n_windows] == word_doc[4:])
        order = whole[np.argsort(h[whole], kind="stable")]
        equal = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hits = order[twice]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + 5, -1)
    repeated = covered[:-1].cumsum() > 0

    by_doc = lambda values: np.bincount(doc_of, values, minlength=n_docs).astype(np.int64)
    base = {
        "n_words": by_doc(per_line),
        "word_chars": by_doc(chars),
        "n_symbols": by_doc(made[:, 6]),
        "n_dup_lines": by_doc(again),
        "n_repeat_words": np.bincount(word_doc, repeated, minlength=n_docs).astype(np.int64),
    }

    some = np.maximum(per_line, 1)
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])
    notice = np.array([any(m in x for m in _NOTICE) for x in (y.lower() for y in flat)])
    tail = np.array([x.rstrip(_SPACES)[-1:] in (b".", b"?", b'"') for x in flat])
    place = np.arange(total) - np.repeat(first_line[:-1], n_lines)
    features = np.concatenate(
        [
            made / np.maximum(sizes - 1, 1)[:, None],
            np.stack(
                [
                    np.ones(total),
                    per_line == 0,
                    np.minimum(per_line, 40) / 40,
                    per_line < 4,
                    chars / some / 10,
                    np.bincount(line_of, same, minlength=total) / some,
                    np.bincount(line_of, repeated, minlength=total) / some,
                    again,
                    notice,
                    tail,
                    made[:, 6] / some,
                    place == 0,
                ],
                axis=1,
            ),
        ],
        axis=1,
    )
    return base, features, chars, n_lines


class Model:
    """Emission weights (DIMS x 2), transition scores (2 x 2) and start scores."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, start: np.ndarray | None = None):
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The best label of each line, all sequences in step: position t of those with more than t lines."""
        out = np.zeros(len(features), np.int8)
        if self.weights is None:
            return out
        emit = features @ self.weights
        first = np.concatenate(([0], np.cumsum(n_lines)[:-1]))
        order = np.argsort(-n_lines, kind="stable")
        first, n = first[order], n_lines[order]
        back = np.zeros((len(features), 2), np.int8)
        best = emit[first] + self.start
        ends = np.zeros((len(n), 2))
        live = len(n)
        for t in range(1, int(n[0]) + 1):
            now = int(np.searchsorted(-n, -t, side="left"))  # sequences with more than t lines
            ends[now:live] = best[now:live]
            live = now
            if not live:
                break
            step = best[:live, :, None] + self.moves
            at = first[:live] + t
            back[at] = step.argmax(axis=1)
            best = step.max(axis=1) + emit[at]
        label = ends.argmax(axis=1).astype(np.int8)
        live = 0
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            at = first[:live] + t
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out


def fit_chains(features: np.ndarray, n_lines: np.ndarray, truth: np.ndarray, epochs: int = 160, rigid: float = 1.0) -> Model:
    """Adam on the conditional log-likelihood; forward and backward run over all sequences in step.

    An infinite ``rigid`` gives a model without transitions.
    """
    p = {"weights": np.zeros((features.shape[1], 2)), "moves": np.zeros((2, 2)), "start": np.zeros(2)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    order = np.argsort(-n_lines, kind="stable")
    first, n = np.concatenate(([0], np.cumsum(n_lines)[:-1]))[order], n_lines[order]
    longest = int(n[0])
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest + 1)]
    one_hot = np.eye(2)[truth]
    inner = np.ones(len(features), bool)
    inner[first] = False
    moved = np.zeros((2, 2))
    np.add.at(moved, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for epoch in range(1, epochs + 1):
        emit = features @ p["weights"]
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[first] = emit[first] + p["start"]
        for t in range(1, longest):
            at = first[: alive[t]] + t
            alpha[at] = lse(alpha[at - 1][:, :, None] + p["moves"], 1) + emit[at]
        for t in range(longest - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            ahead = emit[at + 1] + beta[at + 1]
            beta[at] = lse(p["moves"] + ahead[:, None, :], 2)
        z = np.repeat(lse(alpha[first] + beta[first], 1), n)[np.argsort(np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)]))]
        mass = np.exp(alpha + beta - z[:, None])
        here = np.flatnonzero(inner)
        step = alpha[here - 1][:, :, None] + p["moves"] + (emit[here] + beta[here])[:, None, :] - z[here][:, None, None]
        pairs = np.exp(step).sum(axis=0)
        grads = {
            "weights": features.T @ (mass - one_hot) / len(n) + 1e-4 * p["weights"],
            # Labels change seldom inside a poor document; unchecked, the moves would outvote a line's own features.
            "moves": (pairs - moved) / len(n) + min(rigid, 1e9) * p["moves"],
            "start": (mass[first] - one_hot[first]).mean(axis=0) + min(rigid, 1e9) * p["start"],
        }
        for k in p if rigid < np.inf else ("weights",):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            p[k] = p[k] - 0.1 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
    return Model(**p)


def log_likelihood(model: Model, features: np.ndarray, n_lines: np.ndarray, truth: np.ndarray) -> float:
    """The mean conditional log-likelihood of a sequence's labels."""
    emit, total = features @ model.weights, 0.0
    for first, n in zip(np.concatenate(([0], np.cumsum(n_lines)[:-1])), n_lines, strict=True):
        e, y = emit[first : first + n], truth[first : first + n]
        alpha = e[0] + model.start
        for x in e[1:]:
            alpha = np.logaddexp.reduce(alpha[:, None] + model.moves, axis=0) + x
        path = model.start[y[0]] + e[np.arange(n), y].sum() + model.moves[y[:-1], y[1:]].sum()
        total += path - np.logaddexp.reduce(alpha)
    return total / max(len(n_lines), 1)


def choose(features: np.ndarray, n_lines: np.ndarray, truth: np.ndarray, options=(np.inf, 1.0, 0.1, 0.01)) -> tuple[float, dict[float, float]]:
    """The stiffness under which a fifth of the sequences, not learned from, is likeliest; and all the likelihoods."""
    held = np.arange(len(n_lines)) % 5 == 4
    rows = np.repeat(held, n_lines)
    if not held.any():
        return 1.0, {}
    found = {r: log_likelihood(fit_chains(features[~rows], n_lines[~held], truth[~rows], rigid=r), features[rows], n_lines[held], truth[rows]) for r in options}
    return max(found, key=found.get), found


def fit(docs: DataFrame, labels: DataFrame, *, sample_each: int = 500, most_bytes: int = 1 << 16) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, on about ``sample_each`` documents a class.

    A document that teaches has at most ``most_bytes`` bytes, so what the driver holds is bounded whatever the corpus.
    """
    found = map_arrow(drawn_rows(docs, labels, sample_each, most_bytes), _measured, "quality int, lines binary, hashes binary").collect()
    found = sorted((r["quality"], bytes(r["lines"]), bytes(r["hashes"])) for r in found)
    if len({q == 1 for q, _, _ in found}) < 2:
        return Model()
    # Every fifth sequence is held out, so classes must alternate.
    found = [found[i] for i in np.random.default_rng(7).permutation(len(found))]
    each = [np.frombuffer(b, np.float32).reshape(-1, DIMS).astype(float) for _, b, _ in found]
    features, n_lines = np.concatenate(each), np.array([len(x) for x in each])
    poor = np.repeat([q != 1 for q, _, _ in found], n_lines)
    hashes = [np.frombuffer(h, np.uint64) for _, _, h in found]
    line, docs_of = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    shared = np.isin(np.concatenate(hashes), line[docs_of > 1]) & (features[:, _KINDS + 1] == 0)
    truth = (poor | shared).astype(int)
    return fit_chains(features, n_lines, truth, rigid=choose(features, n_lines, truth)[0])


def _measured(batches):
    for part in slices(batches):
        raw = texts(part)
        _, features, _, n_lines = measure(raw)
        ends = np.cumsum(n_lines)
        rows = [features[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, n_lines, strict=True)]
        hashes = [np.array([xxhash.xxh3_64_intdigest(x) for x in t.split(b"\n")], np.uint64).tobytes() for t in raw]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("quality")), pa.array(rows, pa.binary()), pa.array(hashes, pa.binary())], names=["quality", "lines", "hashes"])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(model: Model, least_share: float):
    def run(batches):
        for part in slices(batches):
            base, features, chars, n_lines = measure(texts(part))
            labels = model.decode(features, n_lines)
            doc_of = np.repeat(np.arange(len(n_lines)), n_lines)
            content = np.bincount(doc_of, chars * (labels == 0), minlength=len(n_lines))
            share = content / np.maximum(base["word_chars"], 1)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            kept = ~failed & (share >= least_share)
            ends = np.cumsum(n_lines)
            marks = [labels[e - n : e].tolist() for e, n in zip(ends, n_lines, strict=True)]
            more = [pa.array(base[k], pa.int64()) for k in BASE]
            more += [pa.array(failed), pa.array(kept), pa.array(share), pa.array(marks, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *BASE, "base_failed", "kept", "content_share", "line_labels"])

    return run


def judge_lines(docs: DataFrame, model: Model, *, least_share: float = 0.5) -> DataFrame:
    """``docs(text, ...)`` with the base counts, base_failed, kept, content_share and line_labels (1: boilerplate).

    Columns of ``docs`` with these names make way.
    """
    docs = docs.drop(*BASE, "base_failed", "kept", "content_share", "line_labels")
    counts = ", ".join(f"{k} long" for k in BASE)
    return map_arrow(docs, _judge(model, least_share), f"{fields(docs)}, {counts}, base_failed boolean, kept boolean, content_share double, line_labels array<byte>")


def op5_crf_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(~held_out(3, 1)), labels)
    return judge_lines(docs, model).drop("text", "line_labels")
