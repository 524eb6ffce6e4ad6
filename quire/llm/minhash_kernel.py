"""Shingle sets and b-bit MinHash signatures of one text, in numpy."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> _S33)) * _MIX1
    x = (x ^ (x >> _S33)) * _MIX2
    return x ^ (x >> _S33)


def shingle_sets(texts: list[bytes], words_each: int, memo: dict) -> list[np.ndarray]:
    """A text's sorted distinct 64-bit hashes of its word shingles; a shorter text is one shingle, no word is none.

    ``memo`` gives the 8 hash bytes of a word. The texts are hashed together, so short ones cost no numpy call each.
    """
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    take = memo.__getitem__
    codes = np.frombuffer(b"".join([b"".join(map(take, w)) for w in words]), np.uint64)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    whole = len(codes) - words_each + 1
    all_of = np.full(max(whole, 0), words_each, np.uint64)
    for i in range(words_each if whole > 0 else 0):
        all_of = mix64(all_of + codes[i : i + whole])
    out = []
    for first, n in zip(firsts.tolist(), counts.tolist(), strict=False):
        if n >= words_each:
            one = np.sort(all_of[first : first + n - words_each + 1])
            fresh = np.empty(len(one), bool)
            fresh[0] = True
            np.not_equal(one[1:], one[:-1], out=fresh[1:])
            out.append(one[fresh])
        elif n:
            one = np.array([n], np.uint64)
            for c in codes[first : first + n]:
                one = mix64(one + c)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Signer:
    """MinHash of ``bands * rows`` functions: band keys from full minima, ``bits`` low bits of each kept, packed."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 17):
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.a = (rng.integers(0, 1 << 31, k, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
        self.room = np.empty((k, 128), np.uint32)
        self.by = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.at = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, shingles: np.ndarray, block: int = 128) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), block):
            part = x[None, i : i + block]
            h = self.room[:, : part.shape[1]]
            np.multiply(self.a, part, out=h)
            np.bitwise_xor(h, self.b, out=h)
            np.minimum(best, h.min(axis=1), out=best)
        return best

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (int64, one a band) and the packed low bits (int64 words)."""
        low = self.minima(shingles)
        with np.errstate(over="ignore"):
            keys = mix64((low.reshape(self.bands, self.rows).astype(np.uint64) * self.by).sum(axis=1) + self.at)
            v = low ^ (low >> np.uint32(16))
            v *= np.uint32(0x45D9F3B)
            v ^= v >> np.uint32(16)
        v &= np.uint32((1 << self.bits) - 1)
        fields = v.astype(np.uint64).reshape(-1, 64 // self.bits) << (np.arange(64 // self.bits, dtype=np.uint64) * np.uint64(self.bits))
        return keys.view(np.int64), np.bitwise_or.reduce(fields, axis=1).view(np.int64)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` cells the shingles fall into, as int64 words."""
    cells = np.zeros(bits, np.uint8)
    cells[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(cells, bitorder="little").view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays; empty sets link with nothing."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
