"""Content hash of the store: 64-bit FNV-1a as 16 hex digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the hash.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


def fnv1a_hex(data: bytes) -> str:
    h = OFFSET
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return f"{h:016x}"


def fnv1a_all(items: list[bytes], least: int = 24) -> list[str]:
    """Hashes of many byte strings at once: byte by byte over all that are long enough, a column at a time.

    What is left of the last few, longest ones is hashed one by one.
    """
    if not items:
        return []
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(items) + b"\0", np.uint8)
    begins = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    h = np.full(len(items), OFFSET, np.uint64)
    prime = np.uint64(PRIME)
    # ``live`` rows are longer than ``at`` bytes; they are the first ones.
    at, live = 0, int(np.count_nonzero(sizes))
    while live >= least:
        stop = int(sizes[live - 1])
        for k in range(at, stop):
            h[:live] = (h[:live] ^ data[begins[:live] + k]) * prime
        at = stop
        live = int(np.count_nonzero(sizes > at))
    out = [""] * len(items)
    for i, row in enumerate(order):
        value = int(h[i])
        if i < live:
            for b in items[row][at:]:
                value = ((value ^ b) * PRIME) & MASK
        out[row] = f"{value:016x}"
    return out


@F.pandas_udf(StringType())
def fnv1a(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of the UTF-8 bytes of a text; null for null."""
    for s in texts:
        known = s.notna()
        out = pd.Series(None, index=s.index, dtype=object)
        out[known] = fnv1a_all([t.encode() for t in s[known]])
        yield out
