"""Binary Ion 1.0: decode and encode values, as the public format describes them.

Python stands for the types: None, bool, int, float, Decimal, str, bytes, list, dict; ``Symbol`` is a symbol's number, ``Annotated`` a
value with annotations, ``SExp`` an s-expression. Structs keep the order of their fields; field names are symbol numbers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from decimal import Decimal

from quire.functions.rowwise import rowwise

MARK = b"\xe0\x01\x00\xea"
#: Deepest nesting that is read. Fixed value.
DEPTH = 128


@dataclass(frozen=True)
class Symbol:
    number: int


@dataclass(frozen=True)
class Annotated:
    annotations: tuple
    value: object


class SExp(list):
    pass


class IonError(ValueError):
    pass


def _var_uint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        if at >= len(data) or n >> 63:
            raise IonError("number runs out")
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
        if b & 0x80:
            return n, at


def _var_int(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data):
        raise IonError("number runs out")
    b = data[at]
    sign, n, at = -1 if b & 0x40 else 1, b & 0x3F, at + 1
    while not b & 0x80:
        if at >= len(data):
            raise IonError("number runs out")
        b = data[at]
        n, at = n << 7 | b & 0x7F, at + 1
    return sign * n, at


def _value(data: bytes, at: int, end: int, depth: int):
    """(value, next place, whether it was padding)."""
    if depth > DEPTH:
        raise IonError("too deep")
    kind, low = data[at] >> 4, data[at] & 15
    at += 1
    if kind == 15:
        raise IonError("reserved type")
    if kind == 1:
        if low not in (0, 1, 15):
            raise IonError("no boolean")
        return (None if low == 15 else low == 1), at, False
    size = low
    if low == 14 or (kind == 13 and low == 1):
        size, at = _var_uint(data, at)
    elif low == 15:
        return None, at, False
    stop = at + size
    if stop > end:
        raise IonError("value runs out")
    body = data[at:stop]
    if kind == 0:
        return None, stop, True
    if kind in (2, 3):
        n = int.from_bytes(body, "big")
        if kind == 3 and not n:
            raise IonError("negative zero")
        return (-n if kind == 3 else n), stop, False
    if kind == 4:
        if size not in (0, 4, 8):
            raise IonError("no float")
        return (0.0 if not size else struct.unpack(">f" if size == 4 else ">d", body)[0]), stop, False
    if kind == 5:
        if not size:
            return Decimal(0), stop, False
        exponent, i = _var_int(body, 0)
        rest = body[i:]
        sign = bool(rest) and rest[0] >> 7
        n = int.from_bytes(rest, "big") & ((1 << (8 * len(rest) - 1)) - 1) if rest else 0
        return Decimal((int(sign), tuple(map(int, str(n))), exponent)), stop, False
    if kind == 6:
        return ("timestamp", bytes(body)), stop, False
    if kind == 7:
        return Symbol(int.from_bytes(body, "big")), stop, False
    if kind == 8:
        try:
            return body.decode("utf-8"), stop, False
        except UnicodeDecodeError as e:
            raise IonError("no text") from e
    if kind in (9, 10):
        return bytes(body), stop, False
    if kind in (11, 12):
        out = [] if kind == 11 else SExp()
        while at < stop:
            v, at, pad = _value(data, at, stop, depth + 1)
            if not pad:
                out.append(v)
        return out, stop, False
    if kind == 13:
        out = {}
        while at < stop:
            name, at = _var_uint(data, at)
            if at >= stop:
                raise IonError("field without value")
            v, at, pad = _value(data, at, stop, depth + 1)
            if not pad:
                out[name] = v
        return out, stop, False
    count, at = _var_uint(data, at)
    upto, names = at + count, []
    while at < upto:
        n, at = _var_uint(data, at)
        names.append(n)
    if at != upto or at >= stop:
        raise IonError("annotations run out")
    v, at, pad = _value(data, at, stop, depth + 1)
    if at != stop or pad or not names:
        raise IonError("annotation without one value")
    return Annotated(tuple(names), v), stop, False


def decode(data: bytes) -> list:
    """All values of a stream; its version marks and padding are no values."""
    out, at = [], 0
    if data[:4] != MARK:
        raise IonError("no version mark")
    while at < len(data):
        if data[at : at + 4] == MARK:
            at += 4
            continue
        v, at, pad = _value(data, at, len(data), 0)
        if not pad:
            out.append(v)
    return out


def _groups(n: int) -> bytes:
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(out[::-1])


def _signed(n: int) -> bytes:
    m, out = abs(n), []
    while m > 0x3F:
        out.append(m & 0x7F)
        m >>= 7
    out = [m | (0x40 if n < 0 else 0), *out[::-1]]
    out[-1] |= 0x80
    return bytes(out)


def _tagged(kind: int, body: bytes) -> bytes:
    return bytes([kind << 4 | len(body)]) + body if len(body) < 14 else bytes([kind << 4 | 14]) + _groups(len(body)) + body


def encode_value(v) -> bytes:
    """A value in as few bytes as its type allows."""
    if v is None:
        return b"\x0f"
    if isinstance(v, bool):
        return b"\x11" if v else b"\x10"
    if isinstance(v, int):
        return _tagged(3 if v < 0 else 2, abs(v).to_bytes(-(-abs(v).bit_length() // 8), "big"))
    if isinstance(v, float):
        if v == 0 and struct.pack(">d", v)[0] == 0:
            return b"\x40"
        small = struct.pack(">f", v) if abs(v) <= 3.4e38 or v != v else None
        if small and (v != v or struct.unpack(">f", small)[0] == v):
            return b"\x44" + small
        return b"\x48" + struct.pack(">d", v)
    if isinstance(v, Decimal):
        sign, digits, exponent = v.as_tuple()
        n = int("".join(map(str, digits)) or "0")
        if not n and not exponent and not sign:
            return b"\x50"
        body = n.to_bytes(n.bit_length() // 8 + 1, "big") if n or sign else b""
        return _tagged(5, _signed(exponent) + (bytes([body[0] | 0x80]) + body[1:] if sign else body))
    if isinstance(v, Symbol):
        return _tagged(7, v.number.to_bytes(-(-v.number.bit_length() // 8), "big"))
    if isinstance(v, str):
        return _tagged(8, v.encode())
    if isinstance(v, bytes):
        return _tagged(10, v)
    if isinstance(v, tuple) and v[0] == "timestamp":
        return _tagged(6, v[1])
    if isinstance(v, Annotated):
        names = b"".join(map(_groups, v.annotations))
        return _tagged(14, _groups(len(names)) + names + encode_value(v.value))
    if isinstance(v, dict):
        body = b"".join(_groups(k) + encode_value(x) for k, x in v.items())
        # A length of one would say that the fields are sorted, so it is written out.
        return b"\xde\x81" + body if len(body) == 1 else _tagged(13, body)
    if isinstance(v, list):
        return _tagged(12 if isinstance(v, SExp) else 11, b"".join(map(encode_value, v)))
    raise TypeError(type(v).__name__)


def encode(values: list) -> bytes:
    return MARK + b"".join(map(encode_value, values))


def as_text(v) -> str:
    """A readable form, symbols as ``$n``."""
    if isinstance(v, Symbol):
        return f"${v.number}"
    if isinstance(v, Annotated):
        return "".join(f"${a}::" for a in v.annotations) + as_text(v.value)
    if isinstance(v, dict):
        return "{" + ",".join(f"${k}:{as_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, SExp):
        return "(" + " ".join(map(as_text, v)) + ")"
    if isinstance(v, list):
        return "[" + ",".join(map(as_text, v)) + "]"
    if isinstance(v, bytes):
        return "{{" + v.hex() + "}}"
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    return repr(v)


def texts(data: bytes) -> list[str]:
    return [as_text(v) for v in decode(data)]


def compress_ids(ids: list[int]) -> list[list[int]]:
    """Sorted distinct numbers as runs: [n] alone, [first, count] for two or more."""
    out: list[list[int]] = []
    for n in sorted(set(ids)):
        if out and n == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([n, 1])
    return [r if r[1] > 1 else r[:1] for r in out]


values_of = rowwise(texts, "array<string>")
runs_of = rowwise(compress_ids, "array<array<long>>")
