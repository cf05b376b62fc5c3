"""Vectorised scanning of UTF-8 text held in Arrow buffers.

All kernels work on a slice of documents: one flat byte array and the documents' offsets in it.
Slices are cut at document borders at about ``SLICE_BYTES`` so that memory stays bounded whatever
an Arrow batch holds; one longer document makes a slice of its own, whose words are hashed in
stretches of that size (``word_hashes``), which leaves about two bytes for each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Every ASCII byte except digits and lower-case letters, for text whose A-Z is lowered.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix(np.arange(256, dtype=_U)) | _U(1)
GRAM_BASE = _BASE


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                table = np.full(max(n, SLICE_BYTES + (1 << 16)), base, _U)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
                setattr(self, name, table)
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hash`` reads the hash of any byte range."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; entry i covers words[i:i+k]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, factor = np.zeros(n, _U), 1
    for i in range(k):
        out += words[i : i + n] * _U(factor)
        factor = factor * _BASE % (1 << 64)
    return mix(out)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive runs of texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each document's words begin in these arrays."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def stretches(data: np.ndarray, separator: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of about ``limit`` bytes that end behind a separator, so that none cuts a word."""
    at = 0
    while at < len(data):
        stop = at + limit
        while stop < len(data):
            found = np.flatnonzero(separator[data[stop : stop + 4096]])
            if len(found):
                stop += int(found[0]) + 1
                break
            stop += 4096
        yield at, min(stop, len(data))
        at = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a slice, and where each document's words begin in these arrays."""
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        parts = []
        for lo, hi in stretches(data, separator):
            start, end, _ = word_spans(data[lo:hi], np.array([0, hi - lo]), separator)
            parts.append((range_hash(prefix_hash(data[lo:hi]), start, end), start + lo, end + lo))
        hashed, start, end = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return hashed, start, end, np.array([0, len(start)])
    start, end, by_doc = word_spans(data, offsets, separator)
    return range_hash(prefix_hash(data), start, end), start, end, by_doc


def gram_owner(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words of all k-grams that stay in one document, and offsets by document."""
    n = np.maximum(np.diff(word_offsets) - k + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(n)))
    return np.arange(offsets[-1]) + np.repeat(word_offsets[:-1] - offsets[:-1], n), offsets
