"""Operator 8: language-model scores by context-tree weighting over bytes.

Method. A text is its words (A-Z lower-cased), a blank after each but the last, and an end byte. Each byte is eight binary
decisions; a decision's node is the last d bytes and the bits so far, for every d from 0 to ``depth`` (7 at most). A node's
estimate is Krichevsky-Trofimov's, (n1 + 1/2) / (n0 + n1 + 1). Weighting mixes all depths: a node stops with probability
``P_e / (P_e + prod P_w(children))``, from the block probabilities of the training counts, worked out bottom-up; the deepest
node of the tree on a path stops surely. (Plain weighting lets a child that training never saw say 1/2; here a path ends
above such a child. A child of a node that was seen takes that node's estimate, then.) The code length per byte is -log2 of the
mixed probability over the text's bytes.

What is gathered follows the corpus: every (depth + 1)-gram of bytes and every word of all training texts is counted, with
map-side sums and one shuffle, and stays in a table in the shared folder. No gram is left out, whatever the size.

Scale. The tree is weighted in subtrees: all nodes whose last ``top`` context bytes hash alike make a task, which hands
up the sums over its highest nodes; the nodes above (``256 ** (top - 1) * 255`` at most, in practice a few thousand) are weighed on
the driver and go to the tasks with the closure. Texts are dealt into blocks of ``block_bytes``. A block asks for the distinct
grams and words it holds; every gram that some block asks for is evaluated once, in its subtree's task, and the answers go back to
the blocks; so a task holds a block of text and its answers, a part of the hash range, or a subtree, never the model.
Grams travel packed: a row holds the grams of one block in one part of the hash range, sorted, as compressed differences, so
rows are few and an exchange moves a few bytes a distinct gram of a block. Parts are even, for gram hashes are.

Words are known by 64-bit hashes. Defined cases: a null text is empty, one end token; an empty training set gives N = V =
0 and a score of half a chance for each bit. A null doc_id is in training. Repeated rows are scored each; other columns are
carried along, but for those named as results are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import held_out, map_arrow, slices, texts, written
from quire.llm.minhash_kernel import mix64

END = b"\n"
#: The end's key among the words; no word has length 0.
END_WORD = np.uint64(0)
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
_BYTE = np.uint64(8)


_FOLD = bytes(32 if b in b" \t\n\r\x0b\x0c" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _body(text: bytes) -> bytes:
    """The words, A-Z lower-cased, a blank after each but the last, and an end byte."""
    text = text.translate(_FOLD)
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        text = b" ".join(text.split())
    return text + END


def _pieces(body: bytes, most: int = 1 << 20) -> list[bytes]:
    """A body cut behind blanks into pieces of about ``most`` bytes; a longer word stays whole."""
    out, begin = [], 0
    while len(body) - begin > most:
        at = body.rfind(b" ", begin, begin + most) + 1 or body.find(b" ", begin + most) + 1
        if not at or at == len(body):
            break
        out.append(body[begin:at])
        begin = at
    return [*out, body[begin:]]


def chunks(raw: list[bytes], most: int = 2 << 20):
    """The texts' bodies in chunks of about ``most`` bytes; a long text goes over several."""
    items, size = [], 0
    for i, t in enumerate(raw):
        body, before = _body(t), END * 7
        for piece in [body] if len(body) <= 1 << 20 else _pieces(body):
            if items and size + len(piece) > most:
                yield Chunk(items, len(raw))
                items, size = [], 0
            items.append((i, before, piece))
            size += len(piece)
            before = (before + piece)[-7:]
    if items:
        yield Chunk(items, len(raw))


class Chunk:
    """Some texts' grams and words, all at once: bodies (words, a blank after each but the last, an end byte) on one line of bytes."""

    def __init__(self, items: list[tuple[int, bytes, bytes]], n: int):
        """``items``: the text's number (of ``n``), the seven bytes before, a piece of its body."""
        text_of, left, content = zip(*items, strict=True)
        self.n, self.text_of = n, np.array(text_of)
        self.ends = sum(c.endswith(END) for c in content)
        self.sizes = np.array([len(c) for c in content])
        # Seven bytes stand before every piece; eight bytes from each place on, read as one number, end with a gram.
        self.u = np.frombuffer(b"".join([x for pair in zip(left, content, strict=True) for x in pair]) + END * 8, np.uint8)
        self.eight = np.lib.stride_tricks.as_strided(self.u, (len(self.u) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 7)[:-1]))

    def grams(self, depth: int) -> np.ndarray:
        """Every byte with the ``depth`` bytes before it as one number."""
        own = np.ones(len(self.eight), bool)
        own[-1] = False
        gaps = self.starts + self.sizes
        own[(gaps[:-1, None] + np.arange(7)).ravel()] = False
        own[gaps[-1] :] = False
        return _low(self.eight[own], depth + 1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """A key for every word, and how many words each text has."""
        first = self.starts + 7
        last = first + self.sizes - 1
        mark = self.u == 32
        for k in range(7):
            mark[self.starts + k] = False  # what stands before a piece is not its own
        mark[last] = True
        end = np.flatnonzero(mark)
        begin = np.concatenate(([0], end[:-1] + 1))
        at = np.searchsorted(end, first)
        begin[at] = first
        length = end - begin
        per_text = np.bincount(self.text_of, np.diff(at, append=len(end)) - (length[at] == 0), minlength=self.n).astype(np.int64)
        begin, length = begin[length > 0], length[length > 0]
        key = mix64(length.astype(np.uint64))
        todo = np.flatnonzero(length <= 32)
        for i in range(4):
            rest = length[todo] - 8 * i
            chunk = self.eight[begin[todo] + 8 * i] >> (np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64))
            key[todo] = mix64(key[todo] + chunk + np.uint64(1))
            todo = todo[rest > 8]
            if not len(todo):
                break
        for j in np.flatnonzero(length > 32):
            key[j] = xxhash.xxh3_64_intdigest(self.u[begin[j] : begin[j] + length[j]].tobytes())
        return key, per_text

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text of a value a gram."""
        by_piece = np.add.reduceat(values, np.concatenate(([0], np.cumsum(self.sizes)[:-1])))
        return np.bincount(self.text_of, by_piece, minlength=self.n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and how often each came."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def pack(rising: np.ndarray) -> bytes:
    """Rising numbers as compressed differences, byte by byte."""
    steps = np.diff(rising.astype(np.uint64), prepend=np.uint64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _zip(values: np.ndarray) -> bytes:
    size = values.itemsize
    return pa.compress(values.view(np.uint8).reshape(-1, size).T.tobytes(), "zstd", asbytes=True)


def _unzip(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size * n, "zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rising keys by part of the hash range (rising inside a part), and where each part begins in it."""
    part = (mix64(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))


class _Gathered:
    """Distinct grams (kind 0) and words (kind 1), with counts of those from training, merged now and then."""

    def __init__(self):
        self.held = {0: ([], []), 1: ([], [])}
        self.size = 0

    def add(self, chunk: Chunk, depth: int, counted: bool = True) -> None:
        words, _ = chunk.words()
        for kind, keys in ((0, chunk.grams(depth)), (1, np.concatenate([words, np.full(chunk.ends, END_WORD)]))):
            k, c = distinct(keys)
            self.held[kind][0].append(k)
            self.held[kind][1].append(c if counted else np.zeros(len(k), np.int64))
            self.size += len(k)
            if len(self.held[kind][0]) >= 24:
                self.merged(kind)

    def merged(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.held[kind]
        if len(keys) > 1:
            self.size -= sum(map(len, keys))
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            k, c = summed(keys, counts) if counts.any() else (distinct(keys)[0], None)
            self.held[kind] = [k], [np.zeros(len(k), np.int64) if c is None else c]
            self.size += len(k)
        keys, counts = self.held[kind]
        return (keys[0], counts[0]) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def rows(self, parts: int, block: int = 0, counted: bool = False):
        """One row a kind and part: (kind, part, block, n, keys, counts)."""
        for kind in (0, 1):
            keys, counts = self.merged(kind)
            order, first = _by_part(keys, parts)
            out = []
            for p in range(parts):
                at = order[first[p] : first[p + 1]]
                if len(at):
                    out.append((kind, p, block, len(at), pack(keys[at]), _zip(counts[at].astype(np.int64)) if counted else None))
            for i in range(0, len(out), 64):
                columns = list(zip(*out[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED.values(), strict=True)], names=list(_PACKED))


_PACKED = {"kind": pa.int8(), "part": pa.int32(), "block": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
_PACKED_SQL = "kind byte, part int, block long, n long, keys binary, counts binary"


def _count(depth: int, parts: int, most: int = 2_000_000):
    def run(batches):
        held = _Gathered()
        for part in slices(batches):
            for chunk in chunks(texts(part)):
                held.add(chunk, depth)
            if held.size > most:
                yield from held.rows(parts, counted=True)
                held = _Gathered()
        yield from held.rows(parts, counted=True)

    return run


def _task_of(gram: np.ndarray, top: int, tasks: int) -> np.ndarray:
    """Which task has the subtree of a gram: by its last ``top`` context bytes."""
    return (mix64(_low(gram >> _BYTE, top)) % np.uint64(tasks)).astype(np.int64)


def _rows_by_task(keys: np.ndarray, top: int, tasks: int):
    task = _task_of(keys, top, tasks)
    order = np.argsort(task, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(task, minlength=tasks))))
    return [(t, order[first[t] : first[t + 1]]) for t in range(tasks) if first[t + 1] > first[t]]


def _merge(top: int, tasks: int):
    """All rows of a kind and part -> their distinct keys and summed counts, in a row a subtree task (grams) or one row (words)."""

    def run(t: pa.Table) -> pa.Table:
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        sizes = t.column("n").to_pylist()
        keys = np.concatenate([unpack(k, n) for k, n in zip(t.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_unzip(c, n, np.int64) for c, n in zip(t.column("counts").to_pylist(), sizes, strict=True)])
        keys, counts = summed(keys, counts)  # what only held-out texts have has count 0
        rows = [] if not len(keys) else _rows_by_task(keys, top, tasks) if kind == 0 else [(0, slice(None))]
        out = [(kind, part, task, len(keys[at]), int((counts[at] > 0).sum()), pack(keys[at]), _zip(counts[at]), int(counts[at].sum())) for task, at in rows]
        return _table(_MERGED, out)

    return run


def _table(columns: dict, rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array(x, k) for (c, k), x in zip(columns.items(), list(zip(*rows, strict=True)) or [()] * len(columns), strict=True)})


_MERGED = {"kind": pa.int8(), "part": pa.int32(), "task": pa.int64(), "n": pa.int64(), "known": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "total": pa.int64()}
_MERGED_SQL = "kind byte, part int, task long, n long, known long, keys binary, counts binary, total long"


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The grams that training has and their counts, of packed rows, rising."""
    sizes = t.column("n").to_pylist()
    if not sizes:
        return np.empty(0, np.uint64), np.empty(0)
    keys = np.concatenate([unpack(k, n) for k, n in zip(t.column("keys").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([_unzip(c, n, np.int64) for c, n in zip(t.column("counts").to_pylist(), sizes, strict=True)])
    keys, counts = keys[counts > 0], counts[counts > 0]
    order = np.argsort(keys)
    return keys[order], counts[order].astype(float)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function, for x of 1/2 and more, by Stirling's series beyond 8."""
    y, low = x + 8.0, np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


_FEW = np.arange(4096.0)
_HALVES, _WHOLES = _log_gamma(_FEW + 0.5), _log_gamma(_FEW + 1.0)


def _looked_up(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    many = np.flatnonzero(n >= len(table))
    out[many] = _log_gamma(n[many] + more)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT block probability of n0 zeros and n1 ones."""
    return _looked_up(n0, _HALVES, 0.5) + _looked_up(n1, _HALVES, 0.5) - math.log(math.pi) - _looked_up(n0 + n1, _WHOLES, 1.0)


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes."""
    return x & np.uint64((1 << (8 * n)) - 1)


def nodes_of(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The binary nodes of one depth from its sorted grams: keys (context, then the bits so far behind a leading one), zeros, ones."""
    context, byte = gram >> _BYTE, gram & np.uint64(255)
    keys, zeros, ones = [], [], []
    for k in range(8):
        key = context << _BYTE | np.uint64(1 << k) | byte >> np.uint64(8 - k)  # rising, as the grams rise
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(float)
        total, one = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
        keys.append(key[first])
        zeros.append(total - one)
        ones.append(one)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


class Levels:
    """Nodes of the depths ``first`` to ``last``, from grams of ``last + 1`` bytes or from the sums that subtrees hand up."""

    def __init__(self, nodes: list[tuple], first: int, below: tuple | None = None):
        """``nodes``: for each depth keys, zeros, ones. ``below``: for the last depth's nodes the summed log weights of their children."""
        self.first, self.keys, self.highest = first, [x[0] for x in nodes], nodes[0][1:]
        self.kt = [(x[2] + 0.5) / (x[1] + x[2] + 1) for x in nodes]
        self.stop = [None] * len(nodes)
        self.parents = [None]
        for i in range(1, len(nodes)):
            parent = _low(self.keys[i] >> _BYTE, first + i - 1) << _BYTE | self.keys[i] & np.uint64(255)
            self.parents.append(np.searchsorted(self.keys[i - 1], parent))
        split = below
        for i in range(len(nodes) - 1, -1, -1):
            own = log_kt(nodes[i][1], nodes[i][2])
            if split is None:
                self.stop[i], self.weight = np.ones(len(own)), own
            else:
                both = np.logaddexp(own, split)
                self.stop[i], self.weight = np.exp(own - both), both - math.log(2)
            if i:
                split = np.bincount(self.parents[i], self.weight, len(self.keys[i - 1]))

    def mix(self, mixed: np.ndarray, reach: np.ndarray) -> None:
        """Top-down: each first node's ``mixed`` probability of a one from above, and the share ``reach`` that comes down to it."""
        self.logs = []
        for i, kt in enumerate(self.kt):
            if i:
                mixed, reach = mixed[self.parents[i]], reach[self.parents[i]]
            # As the deepest node of a path it takes all that is left; as an inner one its stopping share.
            final = np.clip(mixed + reach * kt, 1e-12, 1 - 1e-12)
            mixed, reach = mixed + reach * self.stop[i] * kt, reach * (1 - self.stop[i])
            self.logs.append(np.stack([np.log10(1 - final), np.log10(final)], axis=1))
        self.mixed, self.reach = mixed, reach

    def look(self, context: np.ndarray, prefix: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each decision whether a node of these depths is on its path, and the deepest one's log10 probability."""
        there, out = np.zeros(len(prefix), bool), np.zeros(len(prefix))
        todo = np.arange(len(prefix))
        for i in range(len(self.keys) - 1, -1, -1):
            keys = self.keys[i]
            if not len(keys) or not len(todo):
                continue
            want = _low(context[todo], self.first + i) << _BYTE | prefix[todo]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            out[todo[hit]] = self.logs[i][at[hit], bit[todo[hit]]]
            there[todo[hit]] = True
            todo = todo[~hit]
        return there, out


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> Levels:
    """The nodes of depth ``top`` and more that these grams (``depth + 1`` bytes, distinct) make."""
    levels = []
    for d in range(depth, top - 1, -1):
        gram, n = summed(_low(gram, d + 1), n)
        levels.append(nodes_of(gram, n) if len(gram) else (np.empty(0, np.uint64), np.empty(0), np.empty(0)))
    return Levels(levels[::-1], top)


def _hand_up(depth: int, top: int):
    """A task's subtrees -> sums over the children of each node of depth ``top - 1``: log weights, zeros, ones."""

    def run(t: pa.Table) -> pa.Table:
        gram, n = _read(t)
        if not len(gram):
            return pa.table({"node": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("weight", "zeros", "ones")}})
        tree = subtree(gram, n, depth, top)
        parent = _low(tree.keys[0] >> _BYTE, top - 1) << _BYTE | tree.keys[0] & np.uint64(255)
        unique, at = np.unique(parent, return_inverse=True)
        sums = [np.bincount(at, x, len(unique)) for x in (tree.weight, *tree.highest)]
        return pa.table({"node": unique.view(np.int64), "weight": sums[0], "zeros": sums[1], "ones": sums[2]})

    return run


def crown(keys: np.ndarray, weight: np.ndarray, zeros: np.ndarray, ones: np.ndarray, top: int) -> Levels:
    """The nodes above the subtrees: depths 0 to ``top - 1``, mixed."""
    nodes = [(keys, zeros, ones)]
    for d in range(top - 2, -1, -1):
        key, n0, n1 = nodes[0]
        up = _low(key >> _BYTE, d) << _BYTE | key & np.uint64(255)
        unique, at = np.unique(up, return_inverse=True)
        nodes.insert(0, (unique, np.bincount(at, n0, len(unique)), np.bincount(at, n1, len(unique))))
    levels = Levels(nodes, 0, weight)
    levels.mix(np.zeros(len(levels.keys[0])), np.ones(len(levels.keys[0])))
    return levels


def log_probabilities(wanted: np.ndarray, above: Levels, tree: Levels | None) -> np.ndarray:
    """log10 probability of each gram's last byte behind the others; ``tree`` is the mixed subtree of its context, if training has one."""
    context, byte, total = wanted >> _BYTE, wanted & np.uint64(255), np.zeros(len(wanted))
    for k in range(8):
        prefix = np.uint64(1 << k) | byte >> np.uint64(8 - k)
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        there, value = tree.look(context, prefix, bit) if tree is not None else (np.zeros(len(wanted), bool), np.zeros(len(wanted)))
        rest = np.flatnonzero(~there)
        if len(rest):
            known, other = above.look(context[rest], prefix[rest], bit[rest])
            value[rest] = np.where(known, other, math.log10(0.5))
        total += value
    return total


def _asked(top: int, tasks: int):
    """The requests of a part -> its distinct grams, in a row a subtree task."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        keys, _ = distinct(np.concatenate([unpack(k, n) for k, n in zip(t.column("keys").to_pylist(), t.column("n").to_pylist(), strict=True)]))
        out = [(part, task, len(at), pack(keys[at])) for task, at in _rows_by_task(keys, top, tasks)]
        return _table({"part": pa.int32(), "task": pa.int64(), "n": pa.int64(), "keys": pa.binary()}, out)

    return run


_TOLD = {"kind": pa.int8(), "part": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "values": pa.binary()}


def _told(depth: int, top: int, above: Levels, counts: pa.Table, asked: pa.Table) -> pa.Table:
    """A task's counts and the grams asked for -> (kind 0, part, n, keys, values: log10 probabilities)."""
    gram, n = _read(counts)
    tree = subtree(gram, n, depth, top) if len(gram) and asked.num_rows else None
    if tree is not None:
        parent = _low(tree.keys[0] >> _BYTE, top - 1) << _BYTE | tree.keys[0] & np.uint64(255)
        at = np.searchsorted(above.keys[-1], parent)
        tree.mix(above.mixed[at], above.reach[at])
    out = []
    for part, n, packed in zip(*(asked.column(c).to_pylist() for c in ("part", "n", "keys")), strict=True):
        out.append((0, part, n, packed, _zip(log_probabilities(unpack(packed, n), above, tree).astype(np.float32))))
    return _table(_TOLD, out)


def _answer(key, asked: pa.Table, told: pa.Table) -> pa.Table:
    """For each block's request in a part its values, in the order of its keys; a key that nobody knows has 0 (a word's count)."""
    kind = key[0].as_py()
    dtype = np.float32 if kind == 0 else np.int64
    sizes = told.column("n").to_pylist()
    keys = np.concatenate([np.empty(0, np.uint64), *(unpack(k, n) for k, n in zip(told.column("keys").to_pylist(), sizes, strict=True))])
    values = np.concatenate([np.empty(0, dtype), *(_unzip(x, n, dtype) for x, n in zip(told.column("values").to_pylist(), sizes, strict=True))])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    out = []
    for block, part, n, packed in zip(*(asked.column(c).to_pylist() for c in ("block", "part", "n", "keys")), strict=True):
        wanted = unpack(packed, n)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = np.where(keys[at] == wanted, values[at], 0).astype(dtype) if len(keys) else np.zeros(n, dtype)
        out.append((block, kind, part, n, _zip(found)))
    return _table({"block": pa.int64(), "kind": pa.int8(), "part": pa.int32(), "n": pa.int64(), "values": pa.binary()}, out)


class Fitted:
    """A fitted model: the table of counts, packed, the nodes above the subtrees, N and V."""

    def __init__(self, counts: DataFrame, depth: int, top: int, parts: int, tasks: int, above: Levels, n: int, v: int):
        self.counts, self.depth, self.top, self.parts, self.tasks, self.above, self.n, self.v = counts, depth, top, parts, tasks, above, n, v


def _sizes(docs: DataFrame, part_bytes: int, task_grams: int) -> tuple[int, int]:
    """How many parts of the hash range, and how many subtree tasks."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Distinct grams grow more slowly than the text; a sixteenth is more than any text measured has at depth 6.
    return max(48, -(-size // part_bytes)), max(64, -(-size // 16 // task_grams))


def _weighed(packed: DataFrame, depth: int, top: int, parts: int, tasks: int) -> Fitted:
    """The model of all counts in ``packed``."""
    counted = written(packed.groupBy("kind", "part").applyInArrow(_merge(top, tasks), _MERGED_SQL), "counts")
    n, v = counted.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    up = counted.where("kind = 0").select("task", "n", "keys", "counts")
    up = up.groupBy("task").applyInArrow(_hand_up(depth, top), "node long, weight double, zeros double, ones double")
    up = up.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("weight", "zeros", "ones"))).toArrow()
    keys = up.column("node").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    above = crown(keys[order], *(up.column(c).to_numpy()[order] for c in ("weight", "zeros", "ones")), top)
    return Fitted(counted, depth, top, parts, tasks, above, n, v)


def _check(depth: int, top: int) -> None:
    if not 0 < top <= depth <= 7:
        raise ValueError("0 < top <= depth <= 7: a gram is depth + 1 bytes, eight at most")


def fit(train: DataFrame, *, depth: int = 6, top: int = 2, part_bytes: int = 32 << 20, task_grams: int = 100_000) -> Fitted:
    """Count over all of ``train(text)`` and weigh the tree.

    ``part_bytes``: so many bytes of text a part of the hash range; ``task_grams``: about as many distinct grams a subtree task.
    """
    _check(depth, top)
    train = train.select("text")
    parts, tasks = _sizes(train, part_bytes, task_grams)
    return _weighed(map_arrow(train, _count(depth, parts), _PACKED_SQL), depth, top, parts, tasks)


def _in_blocks(block_bytes: int, kept: list[str]):
    """Runs of rows as one row each: (block, sizes, texts: compressed, train, rows: the other columns)."""

    def run(batches):
        worker, block, held, rows, size = TaskContext.get().partitionId(), 0, [], [], 0

        def whole():
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = [*(table.column(c).combine_chunks() for c in kept), pa.array(range(len(held)), pa.int64())]
            struct = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[*kept, "_row"])
            data = pa.compress(b"".join(held), "zstd", asbytes=True)
            columns = [pa.array([(worker << 32) + block], pa.int64()), pa.array([[len(t) for t in held]], pa.list_(pa.int32())), pa.array([data], pa.binary())]
            ends = pa.array([0, len(held)], pa.int32())
            columns += [pa.ListArray.from_arrays(ends, table.column("_train").combine_chunks()), pa.ListArray.from_arrays(ends, struct)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "sizes", "texts", "train", "rows"])

        for part in slices(batches):
            held += texts(part)
            rows.append(part.drop_columns(["text"]))
            size += sum(map(len, held[-part.num_rows :]))
            if size >= block_bytes:
                yield whole()
                block, held, rows, size = block + 1, [], [], 0
        if held:
            yield whole()

    return run


def _texts_of(sizes: list[int], data: bytes) -> list[bytes]:
    whole, at, out = pa.decompress(data, sum(sizes), "zstd", asbytes=True) if sum(sizes) else b"", 0, []
    for n in sizes:
        out.append(whole[at : at + n])
        at += n
    return out


def _needs(depth: int, parts: int):
    """The distinct grams and words of each block, packed; counted are those of rows with ``train``."""

    def run(batches):
        for batch in batches:
            trains = batch.column(3).to_pylist()
            for block, sizes, data, train in zip(*(batch.column(i).to_pylist() for i in range(3)), trains, strict=True):
                held = _Gathered()
                raw = _texts_of(sizes, data)
                for wanted in (True, False):
                    for chunk in chunks([t for t, x in zip(raw, train, strict=True) if x is wanted], 4 << 20):
                        held.add(chunk, depth, wanted)
                yield from held.rows(parts, block, counted=True)

    return run


def _score(depth: int, parts: int, n: int, v: int, kept: list[str]):
    def run(_, block: pa.Table, answers: pa.Table) -> pa.Table:
        floor = math.log10(n + v + 1)
        sizes, data = block.column("sizes")[0].as_py(), block.column("texts")[0].as_py()
        rows = block.column("rows").combine_chunks().flatten()
        raw, keys, tables = _texts_of(sizes, data), {0: [], 1: []}, []
        for chunk in chunks(raw, 4 << 20):
            # The block's keys are found anew, which costs less than moving them twice.
            keys[0].append(distinct(chunk.grams(depth))[0])
            keys[1].append(distinct(np.concatenate([chunk.words()[0], np.full(chunk.ends, END_WORD)]))[0])
        for kind, dtype in ((0, np.float32), (1, np.int64)):
            mine = distinct(np.concatenate(keys.pop(kind)))[0]
            order, first = _by_part(mine, parts)
            values = np.zeros(len(mine))
            told = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            for p, m, packed in zip(*(told.column(c).to_pylist() for c in ("part", "n", "values")), strict=True):
                at = order[first[p] : first[p + 1]]
                if m != len(at):
                    raise RuntimeError("a block's answers are not for its grams")
                values[at] = _unzip(packed, m, dtype)
            tables.append((mine, values))
        del answers
        score, gain, known, lengths, tokens = (np.zeros(len(raw)) for _ in range(5))
        for chunk in chunks(raw):
            gram = chunk.grams(depth)
            order = np.argsort(gram)  # equal grams lie together, and rising ones are found fast
            rising = gram[order]
            first = np.flatnonzero(np.concatenate(([True], rising[1:] != rising[:-1])))
            value = np.empty(len(gram))
            value[order] = np.repeat(tables[0][1][np.searchsorted(tables[0][0], rising[first])], np.diff(first, append=len(rising)))
            score += chunk.per_text(value)
            codes, words = chunk.words()
            order = np.argsort(codes)
            count = np.empty(len(codes))
            count[order] = tables[1][1][np.searchsorted(tables[1][0], codes[order])]
            of_text = np.repeat(np.arange(len(raw)), words)
            gain += np.bincount(of_text, np.log10(count + 1), minlength=len(raw))
            known += np.bincount(of_text, count > 0, minlength=len(raw))
            lengths += np.bincount(chunk.text_of, chunk.sizes, minlength=len(raw))
            tokens += words
        ends = tables[1][1][0]  # the end's key is the least
        more = [
            pa.array(tokens.astype(np.int64) + 1),
            pa.array((known + (ends > 0)).astype(np.int64)),
            pa.array(np.full(len(raw), n, np.int64)),
            pa.array(gain + math.log10(ends + 1) - floor * (tokens + 1)),
            pa.array(score),
            pa.array(-score / lengths * math.log2(10)),
        ]
        return pa.table([*(rows.field(c) for c in kept), *more], names=[*kept, *RESULTS])

    return run


def _blocks(docs: DataFrame, train, block_bytes: int) -> DataFrame:
    """``docs(text, ...)`` as one row a block: (block, sizes, texts, train, rows: the other columns)."""
    docs = docs.drop(*RESULTS, "_row", "_train")
    row = T.StructType([*docs.drop("text").schema, T.StructField("_row", T.LongType())])
    kinds = {"block": T.LongType(), "sizes": T.ArrayType(T.IntegerType()), "texts": T.BinaryType(), "train": T.ArrayType(T.BooleanType()), "rows": T.ArrayType(row)}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    with_train = docs.withColumn("_train", F.coalesce(train, F.lit(False)))
    return written(map_arrow(with_train, _in_blocks(block_bytes, docs.drop("text").columns), schema), "blocks")


_TOLD_SQL = "kind byte, part int, n long, keys binary, values binary"


def _answered(blocks: DataFrame, needed: DataFrame, told: DataFrame, fitted: Fitted) -> DataFrame:
    """Scores of all texts: ``told`` has the values of all grams asked for; the words' values are their counts."""
    words = fitted.counts.where("kind = 1").select("kind", "part", "n", "keys", F.col("counts").alias("values"))
    answers = needed.select("kind", "part", "block", "n", "keys").groupBy("kind", "part").cogroup(told.unionByName(words).groupBy("kind", "part"))
    answers = answers.applyInArrow(_answer, "block long, kind byte, part int, n long, values binary")
    kept = T.StructType([f for f in blocks.schema["rows"].dataType.elementType if f.name != "_row"])
    schema = T.StructType([*kept, *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")])
    joined = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return joined.applyInArrow(_score(fitted.depth, fitted.parts, fitted.n, fitted.v, kept.names), schema)


def score_texts(docs: DataFrame, fitted: Fitted, *, block_bytes: int = 24 << 20) -> DataFrame:
    """``docs(text, ...)``, less the text, with n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    blocks = _blocks(docs, F.lit(False), block_bytes)
    depth, parts, top, tasks, above = fitted.depth, fitted.parts, fitted.top, fitted.tasks, fitted.above
    needed = written(map_arrow(blocks.drop("rows"), _needs(depth, parts), _PACKED_SQL), "needed")
    asked = needed.where("kind = 0").select("part", "n", "keys").groupBy("part").applyInArrow(_asked(top, tasks), "part int, task long, n long, keys binary")
    counts = fitted.counts.where("kind = 0").select("task", "n", "keys", "counts")
    told = counts.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(lambda _, c, a: _told(depth, top, above, c, a), _TOLD_SQL)
    return _answered(blocks, needed, told, fitted)


def fit_and_score(
    docs: DataFrame, train, *, depth: int = 6, top: int = 2, part_bytes: int = 32 << 20, task_grams: int = 100_000, block_bytes: int = 24 << 20
) -> DataFrame:
    """Learn from the rows of ``docs(text, ...)`` where ``train`` (a Column) is true and score all; the texts' grams are found once for both."""
    _check(depth, top)
    parts, tasks = _sizes(docs.select("text"), part_bytes, task_grams)
    blocks = _blocks(docs, train, block_bytes)
    needed = written(map_arrow(blocks.drop("rows"), _needs(depth, parts), _PACKED_SQL), "needed")
    fitted = _weighed(needed, depth, top, parts, tasks)
    # The merged counts hold every gram that some block asks for, so they are the requests, too.
    above, rows = fitted.above, fitted.counts.where("kind = 0").select("part", "task", "n", "keys", "counts")
    told = rows.groupBy("task").applyInArrow(lambda t: _told(depth, top, above, t, t), _TOLD_SQL)
    return _answered(blocks, needed, told, fitted)


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    return fit_and_score(docs, ~F.col("held_out")).select("doc_id", "held_out", *RESULTS)
