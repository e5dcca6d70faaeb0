"""Compressed bitmaps over ordinals.

Ordinals are split into a high part and 16 low bits. Each high part that has members holds
one container, in the smallest of three forms: sorted low bits (few members), 1,024 words of
bits (many), or runs (long stretches, as dense ordinals have). AND and AND NOT go container
by container; high parts that only one side has are never looked into.
"""

from __future__ import annotations

import struct

import numpy as np

ARRAY, BITS, RUNS = 0, 1, 2
_FEW = 4096


def _pack(low: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest container of sorted distinct low bits (16-bit numbers)."""
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1
    runs = len(breaks) + 1
    if 4 * runs < min(2 * len(low), 8192):
        first = low[np.r_[0, breaks]]
        last = low[np.r_[breaks - 1, len(low) - 1]]
        return RUNS, np.stack([first, last], 1).astype(np.uint16)
    if len(low) <= _FEW:
        return ARRAY, low.astype(np.uint16)
    return BITS, _bits(low)


def _bits(low: np.ndarray) -> np.ndarray:
    flags = np.zeros(65536, np.uint8)
    flags[low] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _low(kind: int, data: np.ndarray) -> np.ndarray:
    if kind == ARRAY:
        return data
    if kind == RUNS:
        size = data[:, 1].astype(np.int64) - data[:, 0] + 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return (np.repeat(data[:, 0].astype(np.int64), size) + at).astype(np.uint16)
    return np.flatnonzero(np.unpackbits(data.view(np.uint8), bitorder="little")).astype(np.uint16)


def _combine(a: tuple, b: tuple, negate: bool) -> np.ndarray:
    """Low bits of ``a AND b`` or ``a AND NOT b``."""
    (ka, da), (kb, db) = a, b
    if ka == BITS and kb == BITS:
        return _low(BITS, da & (~db if negate else db))
    low = _low(ka, da)
    if kb == RUNS:
        at = np.searchsorted(db[:, 0], low, "right") - 1
        inside = (at >= 0) & (low <= db[np.maximum(at, 0), 1])
    elif kb == BITS:
        inside = (db[low >> 6] >> (low & np.uint16(63)).astype(np.uint64)) & np.uint64(1) != 0
    else:
        at = np.minimum(np.searchsorted(db, low), len(db) - 1)
        inside = db[at] == low
    return low[~inside if negate else inside]


class Bitmap:
    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, tuple[int, np.ndarray]] | None = None):
        self.parts = parts or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "Bitmap":
        ordinals = np.unique(np.asarray(ordinals, np.int64))
        high = ordinals >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(ordinals, cuts) if len(ordinals) else []
        return cls({int(p[0] >> 16): _pack((p & 0xFFFF).astype(np.uint16)) for p in parts})

    def members(self) -> np.ndarray:
        out = [(h << 16) + _low(*c).astype(np.int64) for h, c in sorted(self.parts.items())]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def __and__(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for h in self.parts.keys() & other.parts.keys():
            low = _combine(self.parts[h], other.parts[h], False)
            if len(low):
                out[h] = _pack(low)
        return Bitmap(out)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for h, c in self.parts.items():
            if h not in other.parts:
                out[h] = c
                continue
            low = _combine(c, other.parts[h], True)
            if len(low):
                out[h] = _pack(low)
        return Bitmap(out)

    def __len__(self) -> int:
        return sum(len(_low(*c)) for c in self.parts.values())

    def to_bytes(self) -> bytes:
        out = [struct.pack("<I", len(self.parts))]
        for h, (kind, data) in sorted(self.parts.items()):
            out.append(struct.pack("<QBI", h, kind, data.nbytes))
            out.append(data.tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Bitmap":
        (n,), at, parts = struct.unpack_from("<I", data), 4, {}
        for _ in range(n):
            h, kind, size = struct.unpack_from("<QBI", data, at)
            at += struct.calcsize("<QBI")
            values = np.frombuffer(data, np.uint64 if kind == BITS else np.uint16, size // (8 if kind == BITS else 2), at)
            parts[h] = kind, values.reshape(-1, 2) if kind == RUNS else values
            at += size
        return cls(parts)
