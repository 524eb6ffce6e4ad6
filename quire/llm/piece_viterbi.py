"""Operator 10: SentencePiece encoding and decoding by Viterbi over an Aho-Corasick automaton.

Method. All pieces go into one Aho-Corasick automaton. A single pass over the text meets, at each position, every piece that ends
there (the automaton's state and its output links, longest first) and relaxes the best score at that end; walking back gives the
pieces of the highest total score. A character that no piece covers is spelled in byte pieces at ``FALLBACK`` below the lowest score;
in a file without a byte's piece that byte is the unknown id, which decodes to nothing. Of the model file's own normalisation only
the blank in front is followed: texts are neither NFKC-folded nor are blanks run together, so that decoding gives them back.
Decoding joins the pieces' bytes. Blanks, not their stand-in sign, are matched, so a sign U+2581 in a text survives the round trip.

Where no piece has a blank or line end behind another character (checked when the file is read), the best path cannot cross a word's
start, so words are solved once and kept in a bounded memo; otherwise whole texts are solved.

Scale. One map, no shuffle; the automaton is built once a worker from the file at ``path`` (a parameter, the same on all executors).

Defined cases. A null text encodes to null and decodes to null; an empty text to no piece. Ties keep the longer last piece.
Repeated rows are encoded each; other columns are carried along, but for those named as results are.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, fields, map_arrow, per_worker, slices

FALLBACK = 10.0


class Pieces:
    """A model file's pieces: encode and decode one text."""

    def __init__(self, path: str, memo: int = 1_200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.automaton, self.bytes_of, self.byte_ids = ahocorasick.Automaton(), [b""] * n, [model.unk_id()] * 256
        scores = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                scores[text] = i, model.get_score(i)
        self.lowest = min([s for _, s in scores.values()], default=0.0)
        for text, (i, score) in scores.items():
            self.automaton.add_word(text, (len(text), i, score))
        if scores:
            self.automaton.make_automaton()
        by_words = not any(re.search(r"[^ ][ ]|.\n|\n.", t, re.S) for t in scores)
        self.segments = re.compile(r" *[^ \n]+|\n| +" if by_words else r"[\s\S]+").findall
        self.memo = Memo(self.solve, memo)

    def solve(self, text: str) -> tuple[bytes, float]:
        """The best path's ids (little-endian int32 bytes) and its score."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        miss = self.lowest - FALLBACK
        matches = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        end, found = next(matches, (n, None))
        for at in range(n):
            to = at + 1
            while end == at:
                size, i, score = found
                score += best[to - size]
                if best[to] is None or score > best[to]:
                    best[to], back[to] = score, (size, i)
                end, found = next(matches, (n, None))
            spelled = best[at] + miss
            if best[to] is None or spelled > best[to]:
                best[to], back[to] = spelled, (1, -1)
        ids, at = [], n
        while at:
            size, i = back[at]
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
            at -= size
        return np.array(ids[::-1], "<i4").tobytes(), best[n]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a text, behind the blank that the model file puts first."""
        if not text:
            return np.empty(0, np.int32), 0.0
        memo = self.memo
        parts = [memo[s] for s in self.segments(" " + text)]
        return np.frombuffer(b"".join([p[0] for p in parts]), np.int32), sum([p[1] for p in parts])

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])[1:]


def _pieces(path: str) -> Pieces:
    return per_worker(("pieces", path), lambda: Pieces(path))


def _encode(path: str):
    def run(batches):
        pieces = _pieces(path)
        for part in slices(batches):
            found = [t if t is None else pieces.encode(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([x and x[0] for x in found], pa.list_(pa.int32())), pa.array([x and x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "ids", "score"])

    return run


def _decode(path: str):
    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                ids = part.column(part.schema.get_field_index("ids"))
                texts = pa.array([x if x is None else pieces.decode(x).decode("utf-8", "replace") for x in (i.as_py() for i in ids)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(text, ...)`` with ids and score; columns of ``docs`` with these names make way."""
    docs = docs.drop("ids", "score")
    return map_arrow(docs, _encode(path), f"{fields(docs)}, ids array<int>, score double")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(ids, ...)`` with decoded, in whose place a column of that name goes; unknown and control ids decode to nothing."""
    encoded = encoded.drop("decoded")
    return map_arrow(encoded, _decode(path), f"{fields(encoded)}, decoded string")


def op10_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = decode(encode(docs, path), path)
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.hex(F.xxhash64("ids")).alias("ids_hash"), "score", same.alias("round_trip"))
