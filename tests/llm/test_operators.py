"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import exp, lgamma, log, log10

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import attention_quality, context_tree, crf_lines, language_id
from quire.llm.exact_topk import exact_topk
from quire.llm.harmonic_packing import cut, harmonic_packing
from quire.llm.histogram_shards import histogram_shards
from quire.llm.license_scan import TEMPLATES, license_scan
from quire.llm.near_dedup import near_duplicates
from quire.llm.piece_viterbi import Pieces, decode, encode

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(rng, n, kind="en"):
    stems = {"en": ["the", "of", "thing", "over", "land"], "fr": ["le", "éau", "que", "ment", "oui"]}[kind]
    return " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    out = [None, "", "   \n\t", "one", "One", "one two", base, base.upper(), base]
    for k in (1, 2, 4, 8, 12):  # near copies, on both sides of the threshold
        w = base.split()
        for i in rng.choice(len(w), k, replace=False):
            w[i] = f"new{i}"
        out.append(" ".join(w))
    out += [words(rng, int(n)) for n in rng.integers(3, 60, 25)]
    out += [words(rng, 30_000), "日本語 🎉 ▁x  a\n\n\nb<|endoftext|>", "x" * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    # An id is null, two rows repeat, and a column clashes with a result's name.
    rows = [(i, t, "en", "s", 0, 1.0) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None), (6, texts[6], "en", "s", 0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_near_duplicates(docs, texts, empty):
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = near_duplicates(docs, words_each=2).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
        else:
            assert r["kept"] and r["component_id"] is None
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("step", [3, 9, 14])
def test_near_duplicate_chains(spark, step):
    """Chains whose ends are far apart, and loose families, of which a bucket's middle is linked with some only."""
    rng = np.random.default_rng(step)
    word = lambda: f"w{rng.integers(10**9)}"
    rows, now = [], [word() for _ in range(200)]
    for _ in range(60):
        for i in rng.choice(200, step, replace=False):
            now[i] = word()
        rows.append(" ".join(now))
    core = [word() for _ in range(200)]
    for _ in range(40):  # a family around one text, each about as far from the others as the threshold
        one = list(core)
        for i in rng.choice(200, step // 2 + 3, replace=False):
            one[i] = word()
        rows.append(" ".join(one))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    sets = [shingles(t, 2) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words_each=2).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_packing(docs, texts, empty):
    tokenizer = Tokenizer.from_file(BPE)
    pieces = harmonic_packing(docs, BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        if p["doc_id"] is not None and p["doc_id"] != 6:
            by_doc[p["doc_id"]].append(p)
    for i, text in enumerate(texts):
        if i == 6:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for inside in by_sequence.values():
        at = 0
        for p in sorted(inside, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    total = sum(p["length"] for p in pieces)
    assert 1024 * len(by_sequence) <= total * 1.02 + 1024
    assert harmonic_packing(empty, BPE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 700, 1023, 1024, 1025, 5000])
def test_cut(n):
    pieces = cut(n, 1024, 1 / 128)
    assert sum(length for length, _ in pieces) == n
    assert all(length * k <= 1024 for length, k in pieces)


def test_shards(docs, empty, spark):
    rows = histogram_shards(docs).collect()
    assert len(rows) == docs.count()
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    out = histogram_shards(many).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        text = "same text" if r["doc_id"] % 3 == 0 else "ab" * (r["doc_id"] % 50)
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 220
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert histogram_shards(empty).count() == 0


def brute_topk(rows, queries, k):
    """rows of (id, integers or None); every pair of one dimension and unlike ids, in whole numbers."""
    rows = [(i, v) for i, v in rows if i is not None and v is not None]
    out = []
    for q in sorted({i for i, _ in rows if queries(i)}):
        found = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for j, w in rows if j == q for i, v in rows if i != q and len(v) == len(w))
        out += [(q, rank, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 12)).round(3)
    v[7] = v[8]
    v[20:40] *= 50
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(900, None), (1000, [float("nan")] * 12), (1100, [None] * 12), (None, [1.0] * 12)]
    ints = lambda v: [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    want = brute_topk([(i, ints(e)) for i, e in enumerate(v)], lambda i: i % 100 == 0, 5)
    for sizes in ({}, {"tile_values": 12 * 40, "tile_queries": 2, "head": 7, "ranges": 4}):
        got = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=5, **sizes)
        assert sorted(map(tuple, got.collect())) == want
    assert exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_topk_repeats_lengths_and_dimensions(spark):
    rng = np.random.default_rng(3)
    plain = [(int(i), [float(x) for x in rng.integers(-9, 9, 3)]) for i in rng.integers(0, 30, 60)]
    rows = plain + [(1, [1.0, 0.0]), (1, [5.0, 0.0]), (10, [1.0, 1.0]), (2, [2.0, 0.0]), (20, []), (21, []), (10, [7.0])]
    rows += [(40, [1e6, -1e6, 3.0]), (41, [1e6, 1e6, 5.0]), (41, [1e6, 1e6, 4.0]), (50, [3e12, 1.0, 0.0]), (51, [-3e12, 0.0, 0.0]), (52, [0.0, 0.0, 0.0])]
    rows += [(60, [1e200, 0.0, 0.0]), (61, [1e200, 1e200, 0.0]), (61, [2e200, 0.0, 0.0])]
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = brute_topk(ints, lambda i: i % 10 == 0, 4)
    for sizes in ({}, {"tile_values": 30, "tile_queries": 1, "head": 3, "ranges": 3}):
        d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, is_query string, d int").repartition(3)
        got = exact_topk(d, F.col("vec_id") % 10 == 0, k=4, **sizes)
        assert sorted(map(tuple, got.collect())) == want


def test_lines(docs, texts, empty):
    base = {}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        covered = {j + o for j, x in enumerate(windows) if x in twice for o in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        base[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
    got = crf_lines.judge_lines(docs.select("doc_id", "text"), crf_lines.Model()).collect()
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r[k] for k in crf_lines.BASE) == base[r["doc_id"]]
            n, repeated = base[r["doc_id"]][0], base[r["doc_id"]][4]
            assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
    assert crf_lines.judge_lines(empty.select("doc_id", "text"), crf_lines.Model()).count() == 0


def test_viterbi_is_best():
    rng = np.random.default_rng(4)
    model = crf_lines.Model(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    n_lines = np.array([1, 5, 3, 5])
    x = rng.normal(size=(n_lines.sum(), 3))
    got, at = model.decode(x, n_lines), 0
    for n in n_lines:
        emit = x[at : at + n] @ model.weights

        def score(path, emit=emit):
            return model.start[path[0]] + sum(emit[i][p] for i, p in enumerate(path)) + sum(model.moves[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(np.ndindex(*(2,) * n), key=score)
        assert tuple(got[at : at + n]) == best
        at += n


def test_quality(spark, empty):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, 150) if i % 2 else " ".join(["AGAIN!!"] * 90)) for i in range(120)] + [(500, None), (501, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = attention_quality.fit(d, labels)
    got = {r["doc_id"]: r for r in attention_quality.score_quality(d, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(120)) and 0 <= got[500]["score"] <= 1
    assert attention_quality.score_quality(empty.select("doc_id", "text"), attention_quality.Model(None)).count() == 0


def test_language(spark, empty):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, 60, "en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(160)]
    rows += [(900, None, "en"), (901, "12 + 34", None), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(d, language_id.fit(d.where("doc_id < 100"))).collect()}
    assert all(got[i]["lang_pred"] == got[i]["lang"] and not got[i]["rejected"] for i in range(100, 160))
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (900, 901, 902))
    none = language_id.fit(empty)
    assert [r["lang_pred"] for r in language_id.identify(d.where("doc_id = 0"), none).collect()] == ["und"]


def test_language_rejects_the_unlearned(spark):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, int(rng.integers(20, 200)), "en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(200)]
    rows += [(200, "x", "en"), (201, "qq zz 0x1f", "fr")]  # a few junk labels must not widen the bounds
    random = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n))
    foreign = ["обычный русский текст о погоде и людях, которые живут в городе", "今天天气很好我们去公园散步看到很多人", "ένα ελληνικό κείμενο για τον καιρό"]
    foreign += ["tämä on suomenkielinen teksti säästä ja ihmisistä jotka asuvat kaupungissa", random(10), random(200)]
    foreign += [" ".join(f"{int(x):016x}" for x in rng.integers(0, 2**62, n)) for n in (5, 50)]
    rows += [(300 + i, t * k, None) for i, (t, k) in enumerate((t, k) for t in foreign for k in (1, 8))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(d, language_id.fit(d.where("doc_id < 140 or doc_id in (200, 201)"))).collect()
    assert [r["doc_id"] for r in got if not r["rejected"] and r["doc_id"] >= 300] == []
    assert [r["doc_id"] for r in got if r["rejected"] and r["doc_id"] < 200] == []


def test_language_learns_from_a_text_of_one_gram(spark):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, 60, "en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(160)] + [(200, "x" * 100_000, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(d.where("doc_id between 100 and 159"), language_id.fit(d.where("doc_id < 100 or doc_id = 200"))).collect()
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] and 0 < r["score"] <= 1 for r in got)


def brute_tree(rows, depth):
    """Context-tree weighting by the recursion of its definition, on dictionaries: log10 P of a byte behind a context."""
    counts = {}
    for text in rows:
        body = b"\n" * depth + text
        for i in range(depth, len(body)):
            for k in range(8):
                bits, bit = format(body[i], "08b")[:k], int(format(body[i], "08b")[k])
                for d in range(depth + 1):
                    counts.setdefault((body[i - d : i], bits), [0, 0])[bit] += 1
    children = defaultdict(list)
    for context, bits in counts:
        if context:
            children[context[1:], bits].append((context, bits))

    def kt(n0, n1):
        return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - 2 * lgamma(0.5) - lgamma(n0 + n1 + 1)

    def weight(node):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            return own, 1.0
        split = sum(weights[c][0] for c in children[node])
        both = np.logaddexp(own, split)
        return both - log(2), exp(own - both)

    weights = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        weights[node] = weight(node)

    def probability(context, byte):
        total = 0.0
        for k in range(8):
            bits, bit = format(byte, "08b")[:k], int(format(byte, "08b")[k])
            inner, reach, final = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                node = context[len(context) - d :], bits
                if node not in counts:
                    break
                n0, n1 = counts[node]
                one = (n1 + 0.5) / (n0 + n1 + 1)
                final = inner + reach * one
                inner, reach = inner + reach * weights[node][1] * one, reach * (1 - weights[node][1])
            total += log10(final if bit else 1 - final)
        return total

    return probability


@pytest.mark.parametrize("depth,top", [(1, 1), (2, 1), (3, 2), (3, 3), (7, 2)])
def test_context_tree_is_brute_force(spark, depth, top):
    rng = np.random.default_rng(depth)
    texts = ["".join(rng.choice(list("aAb  c"), rng.integers(0, 40))) for _ in range(12)] + [None, "  ", "é"]
    held = ["abab c", "zz a", "", None, "cab" * 30]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fitted = context_tree.fit(d, depth=depth, top=top)
    clash = spark.createDataFrame([(i, t, 1.0, 2, "x", 3) for i, t in enumerate(texts + held)], "doc_id long, text string, score double, _row int, row string, block int").repartition(2)
    got = context_tree.score_texts(clash, fitted, block_bytes=20)
    assert got.columns == ["doc_id", "row", "block", *context_tree.RESULTS]
    bodies = [b" ".join((t or "").encode().lower().split()) + b"\n" for t in texts]
    probability = brute_tree(bodies, depth)
    for r in got.collect():
        body = b" ".join(((texts + held)[r["doc_id"]] or "").encode().lower().split()) + b"\n"
        padded = b"\n" * depth + body
        want = sum(probability(padded[i : i + depth], padded[i + depth]) for i in range(len(body)))
        assert r["score"] == pytest.approx(want, rel=1e-6)  # answers are four-byte floats
        assert r["bits_per_byte"] == pytest.approx(-want / log10(2) / len(body), rel=1e-6)


def test_context_chunks_are_whole():
    rng = np.random.default_rng(1)
    raw = [("".join(rng.choice(list("ab  "), n))).encode() for n in rng.integers(0, 60, 40)] + [b"", b" ", b"x" * 90, b"y" * 33 + b" z"]
    bodies = [b" ".join(t.split()) + b"\n" for t in raw]
    chunks = [context_tree.Chunk([(i, (b"\n" * 7 + b[:a])[-7:], p)], len(raw)) for i, b in enumerate(bodies) for a, p in zip(np.cumsum([0, *map(len, context_tree._pieces(b, 9))]), context_tree._pieces(b, 9), strict=False)]
    assert b"".join(c.u[7:-8].tobytes() for c in chunks) == b"".join(bodies)
    whole = context_tree.Chunk([(i, b"\n" * 7, b) for i, b in enumerate(bodies)], len(raw))
    for depth in (0, 3, 7):
        assert (np.concatenate([c.grams(depth) for c in chunks]) == whole.grams(depth)).all()
        want = [int.from_bytes((b"\n" * 7 + b)[i + 7 - depth : i + 8], "big") for b in bodies for i in range(len(b))]
        assert whole.grams(depth).tolist() == want
    assert (sum(c.words()[1] for c in chunks) == whole.words()[1]).all() and whole.words()[1].tolist() == [len(t.split()) for t in raw]
    keys = np.concatenate([c.words()[0] for c in chunks])
    assert (keys == whole.words()[0]).all() and len(set(keys.tolist())) == len({w for t in raw for w in t.split()})
    assert sum(c.ends for c in chunks) == len(raw)


def test_context_tree_at_once(docs):
    """Learning and scoring in one pass gives what the two apart give."""
    d = docs.select("doc_id", "text").where("doc_id is not null")
    train = F.col("doc_id") % 3 == 0
    at_once = context_tree.fit_and_score(d, train, depth=3, block_bytes=20_000).collect()
    apart = context_tree.score_texts(d, context_tree.fit(d.where(train), depth=3)).collect()
    key = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), float(f"{r['score']:.4e}"))
    assert sorted(map(key, at_once)) == sorted(map(key, apart)) and len(at_once) == d.count()


def test_context_tree(docs, texts, spark, empty):
    fitted = context_tree.fit(docs.where("doc_id % 2 = 0"), depth=2)
    got = context_tree.score_texts(docs.select("doc_id", "text"), fitted).collect()
    assert len(got) == docs.count()
    lower = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    rows = [t for i, t in enumerate(texts) if i % 2 == 0] + [texts[6]]
    counts = Counter(w for t in rows for w in [*lower(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        if r["doc_id"] is None:
            continue
        tokens = [*lower(texts[r["doc_id"]]), b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    none = context_tree.fit(empty)
    assert context_tree.score_texts(empty, none).count() == 0
    [r] = context_tree.score_texts(docs.where("doc_id = 5").select("doc_id", "text"), none).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] == pytest.approx(8 * len(b"one two\n") * log10(0.5))


def test_pieces(docs, texts, empty):
    out = decode(encode(docs.select("doc_id", "text"), PIECES), PIECES).collect()
    assert all(r["decoded"] == r["text"] for r in out) and len(out) == docs.count()
    pieces = Pieces(PIECES)
    table = {p: pieces.automaton.get(p) for p in pieces.automaton.keys()}
    for text in [" the thing", " q" * 3, " éx日", " ...land"]:
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in table:
                    best[j] = max(best[j], best[i] + table[text[i:j]][2])
            best[i + 1] = max(best[i + 1], best[i] + pieces.lowest - 10)
        assert pieces.solve(text)[1] == pytest.approx(best[-1])
    assert encode(empty.select("doc_id", "text"), PIECES).count() == 0


def test_licences(spark, empty):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/x.txt", "nothing here\nof note"),
        (3, "a/b/y.txt", "intro\nReleased under the MIT License.\nmore"),
        (4, "c/z.txt", None),
        (5, None, "All rights reserved.\nsome words of another kind that go on"),
        (6, "a/b/c/LICENSE", "All rights reserved."),
        (7, "a/b/c/d/e.txt", ""),
        (2, "a/b/x.txt", "nothing here\nof note"),
    ]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    licence = {r["doc_id"]: (r["header"], r["inherited_from"], r["licence"]) for r in got}
    assert len(got) == 8
    assert licence[2] == (None, "a", "Apache-2.0") and licence[3] == ("MIT", None, "MIT") and licence[4] == (None, None, None)
    assert licence[5] == ("proprietary", None, "proprietary") and licence[7] == (None, "a/b/c", "proprietary")
    assert license_scan(empty.select("doc_id", F.col("source").alias("path"), "text")).count() == 0


def test_whole_licences_and_wrapped_headers(spark):
    whole = {name: text for name, text in TEMPLATES if len(text) > 400}
    wrap = lambda t, n=70: "\n".join(textwrap.wrap(t, n))
    apache = whole["Apache-2.0"]
    rows = [(1, "m/LICENSE", f"MIT License\n\nCopyright (c) 2019 Some Body\n\n{wrap(whole['MIT'])}"), (2, "m/src/a.c", "int main;"), (3, "b/LICENSE.txt", f"Copyright 2001, Them\n{wrap(whole['BSD-2-Clause'])}")]
    rows += [(4, "i/COPYING", wrap(whole["ISC"], 60)), (5, "i/x/y/z", "1"), (6, "g/a.py", f"# {wrap(whole['GPL-3.0']).replace(chr(10), chr(10) + '# ')}\n" + "x = 1  # some other code\n" * 80)]
    rows += [(7, "n/a", "// SPDX-License-Identifier: MIT\ncode"), (8, "n/b", "code\n" * 30 + wrap(apache, 40).split("\n\n")[0] + "\ncode" * 30)]
    rows += [(9, "n/c", "the software is used with permission of the author, who has it under control\n" * 3), (10, "n/d", "/* This Source Code Form is subject to the terms of\n * the Mozilla Public License, v. 2.0. */\ncode")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(got[i]["licence"], got[i]["is_licence_file"]) for i in (1, 3, 4)] == [("MIT", True), ("BSD-2-Clause", True), ("ISC", True)]
    assert (got[2]["inherited_from"], got[2]["licence"]) == ("m", "MIT") and (got[5]["inherited_from"], got[5]["licence"]) == ("i", "ISC")
    assert [got[i]["header"] for i in (6, 7, 8, 9, 10)] == ["GPL-3.0", "MIT", "Apache-2.0", None, "MPL-2.0"]
