"""32-bit hashes of bytes, as longs. Arrow batches go through numpy a byte or word at a time, all rows together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = np.uint64(0xFFFFFFFF)
# Fixed values of the two hashes.
_FNV_START, _FNV_PRIME = 2166136261, 16777619
_C1, _C2, _ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
_END1, _END2 = 0x85EBCA6B, 0xC2B2AE35


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    return x * np.uint64(factor) & _M


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits) | x >> np.uint64(32 - bits)) & _M


def _steps(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows that have a whole next word of ``width`` bytes, those little-endian words)."""
    order = np.argsort(-size, kind="stable")
    words = size[order] // width
    for i in range(int(words[0]) if len(words) else 0):
        rows = order[: int(np.searchsorted(-words, -i))]
        at = start[rows] + i * width
        yield rows, sum(data[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(width))


def fnv1a_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.full(len(size), _FNV_START, np.uint64)
    for rows, byte in _steps(data, start, size, 1):
        out[rows] = _times(out[rows] ^ byte, _FNV_PRIME)
    return out


def _scrambled(word: np.ndarray) -> np.ndarray:
    return _times(_turn(_times(word, _C1), 15), _C2)


def murmur3_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size), np.uint64)
    for rows, word in _steps(data, start, size, 4):
        out[rows] = (_times(_turn(out[rows] ^ _scrambled(word), 13), 5) + np.uint64(_ADD)) & _M
    rest, tail = size % 4, np.zeros(len(size), np.uint64)
    for k in range(3):
        rows = np.flatnonzero(rest > k)
        tail[rows] |= data[start[rows] + size[rows] - rest[rows] + k].astype(np.uint64) << np.uint64(8 * k)
    out ^= _scrambled(tail) ^ size.astype(np.uint64)
    out = _times(out ^ out >> np.uint64(16), _END1)
    out = _times(out ^ out >> np.uint64(13), _END2)
    return out ^ out >> np.uint64(16)


def _applied(kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], value: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        raw = [b"" if x is None else bytes(x) for x in values]
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        return pd.Series(kernel(data, np.cumsum(size) - size, size).astype(np.int64))

    return F.when(value.isNotNull(), hashed(value.cast("binary")))


def fnv1a(value: Column) -> Column:
    """FNV-1a of the UTF-8 bytes; null of null."""
    return _applied(fnv1a_bytes, value)


def murmur3(value: Column) -> Column:
    """Murmur3 (32 bits, seed 0) of the UTF-8 bytes; null of null. Spark's own ``hash`` has another seed and tail."""
    return _applied(murmur3_bytes, value)


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("binary"))
