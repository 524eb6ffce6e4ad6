"""Operator 3: harmonic packing of token sequences.

Method. Class k holds the lengths up to ``capacity // k`` (its reciprocal share of the capacity); a bin of class k takes
exactly k pieces. A document gives whole-capacity pieces first (class 1). Its rest is cut at the largest class length
that fits, again and again, so a piece fills its share; a rest within ``slack`` of its class length stays uncut. Workers
tokenize and classify their documents on their own and number each class's pieces; bins of k consecutive numbers
need no exchange of pieces, only each worker's starting number in each class: prefix sums over a table with a row for each
worker and class. The bins left unfilled, at most one a class, are packed once more by first fit decreasing;
their number is bounded by the class list, whatever the corpus.

Sequences are padded to ``capacity`` unless their length is a power of two, which needs no padding.

Scale. One pass over the text; its output (ids as CRCs and numbers, no text) is written once to the shared folder, so no
retry tokenizes anew. Windows run over the counts, not the pieces. Only counts (classes x read splits) and the
bounded unfilled bins are broadcast or brought to the driver.

Defined cases. A null text is empty: its document is the one piece of the end id. A null doc_id is packed as any other.
Repeated rows are packed once each. An empty table gives no pieces. Other columns are ignored. Special-token
strings in a text are read as the tokenizer file says (``add_special_tokens=False``). Texts are never cut before tokenizing.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Memo, discard, map_arrow, per_worker, slices, texts, written

#: Unicode white space, at which pre-tokenization splits.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Chunks that no token crosses: white-space runs but for their last character, and words with the blank before them.
_CHUNK = f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]"


#: The byte-level alphabet's printable bytes; the other bytes stand at U+0100 and on, in order. Fixed values.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level pre-tokenization. Fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def text_ids(path: str):
    """A function from a text to the bytes of its little-endian ids, as `tokenizers` gives them for this file.

    Where the file's merges come in the order of their ids, as in byte-level files, merging by rank gives the same ids;
    `tiktoken` does that in a quarter of the time, for chunks that no token crosses, once a chunk. Special tokens are cut out
    of the text before it is split into chunks. Any other file goes through `tokenizers` itself, text by text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    model = json.loads(slow.to_str())
    vocab, merges = model["model"].get("vocab"), model["model"].get("merges") or []
    merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
    ordered = [vocab[a + b] for a, b in merges] if isinstance(vocab, dict) else [0, 0]
    byte_level = '"ByteLevel"' in json.dumps(model.get("pre_tokenizer")) and '"add_prefix_space": true' not in json.dumps(model["pre_tokenizer"])
    flagged = any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    if ordered != sorted(ordered) or not byte_level or flagged or model.get("normalizer") or model["model"].get("ignore_merges"):
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rest = [b for b in range(256) if b not in _PRINTABLE]
    to_byte = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in model["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    encode = lambda chunk: np.array(fast(chunk), "<u4").tobytes()
    marks = {c: encode(c) for c in ".,;:!?"}

    def make(chunk: str) -> bytes:
        # Letters and a closing mark are tokens apart, so the word is looked up without it.
        if chunk[-1] in marks and chunk[:-1].strip(" ").isalpha():
            return memo[chunk[:-1]] + marks[chunk[-1]]
        return encode(chunk)

    memo = Memo(make, 1_000_000)
    take, chunks = memo.__getitem__, re.compile(_CHUNK).findall
    special = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None

    def ids(text: str) -> bytes:
        if special is None or special.search(text) is None:
            return b"".join(map(take, chunks(text)))
        parts = special.split(text)  # texts and special tokens by turns
        return b"".join(added[p] if i % 2 else b"".join(map(take, chunks(p))) for i, p in enumerate(parts))

    return ids


def classes(capacity: int) -> list[int]:
    """The class numbers in use: every distinct length ``capacity // k`` once, with the largest k that gives it."""
    return sorted({capacity // (capacity // k) for k in range(1, capacity + 1)})


def cut(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """The pieces (length, class) of a document of n ids."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest  # the class that holds the rest uncut
        full = capacity // k
        if rest >= full * (1 - slack):
            pieces.append((rest, k))
            break
        k += 1
        full = capacity // k
        k = capacity // full
        pieces.append((full, k))
        rest -= full
    return pieces


def _tokenize(path: str, capacity: int, slack: float, end_id: int):
    def run(batches):
        encode, end = per_worker(("ids", path), lambda: text_ids(path)), np.array([end_id], "<u4").tobytes()
        worker, seen = TaskContext.get().partitionId(), {}
        plans = Memo(lambda n: cut(n, capacity, slack))
        for part in slices(batches):
            rows = [], [], [], [], [], [], []
            for at, text in enumerate(texts(part)):
                ids = encode(text.decode()) + end
                n, start = len(ids) // 4, 0
                for length, k in plans[n]:
                    rank = seen.get(k, 0)
                    seen[k] = rank + 1
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (at, start, length, crc, n, k, rank), strict=True):
                        column.append(value)
                    start += length
            longs = [pa.array(r, pa.int64()) for r in rows]
            ids_of = part.column(0).take(longs[0])
            yield pa.RecordBatch.from_arrays(
                [ids_of, *longs[1:], pa.array(np.full(len(rows[0]), worker, np.int64))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank", "worker"],
            )

    return run


def first_fit_decreasing(pieces: list[tuple[int, int, int]], capacity: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(class, number) of each piece (class, number, length) -> (bin, offset)."""
    bins: list[int] = []
    placed = {}
    for k, number, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        at = next((i for i, used in enumerate(bins) if used + length <= capacity), len(bins))
        if at == len(bins):
            bins.append(0)
        placed[k, number] = at, bins[at]
        bins[at] += length
    return placed


def harmonic_packing(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, slack: float = 1 / 128, end_id: int = 0) -> DataFrame:
    """The pieces of every document of ``docs(doc_id, text)``, with sequence_id and offset.

    ``tokenizer`` is the path of a `tokenizers` file, the same on every executor.
    """
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, class long, rank long, worker long"
    pieces = written(map_arrow(docs.select("doc_id", "text"), _tokenize(tokenizer, capacity, slack, end_id), schema), "pieces")
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    numbered = pieces.join(starts.select("class", "worker", "before"), ["class", "worker"]).withColumn("number", F.col("before") + F.col("rank"))
    numbered = written(numbered.drop("before", "rank", "worker"), "numbered")
    discard(pieces)
    # One unfilled bin a class at most: fewer pieces than the sum of the class numbers, a constant.
    ends = [(k, n - n % k) for k, n in sorted(totals.items()) if n % k]
    limits = spark.createDataFrame(ends, "class long, whole long")
    numbered = numbered.join(F.broadcast(limits), "class", "left")
    last = F.coalesce(F.col("number") >= F.col("whole"), F.lit(False))
    placed = first_fit_decreasing([tuple(r) for r in numbered.where(last).select("class", "number", "length").collect()], capacity)
    last_bins = spark.createDataFrame([(*key, *at) for key, at in placed.items()], "class long, number long, bin long, at long")
    # Bins of whole classes: sequence numbers follow each other class by class; the last bins follow all of them.
    firsts, following = [], 0
    for k, n in sorted(totals.items()):
        firsts.append((k, following))
        following += n // k
    firsts = spark.createDataFrame(firsts, "class long, first long")
    numbered = numbered.join(F.broadcast(firsts), "class").join(F.broadcast(last_bins), ["class", "number"], "left")
    bin_of = F.coalesce(F.lit(following) + F.col("bin"), F.col("first") + F.floor(F.col("number") / F.col("class")))
    numbered = numbered.withColumn("sequence_id", bin_of)
    inside = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.when(F.col("bin").isNotNull(), F.col("at")).when(F.col("class") == 1, F.lit(0)).otherwise(F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def op3_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return harmonic_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))
