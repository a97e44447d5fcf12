"""Words, lines and hashes of whole Arrow text columns, as numpy arrays.

A batch of texts is one byte buffer with offsets; nothing here makes a Python object per word. White space is the
ASCII set of the contracts (space and 9 to 13), lower case is A-Z only, and a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer single document is handled alone.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_CODE_LOWER = _CODE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, U(base))
            table[0] = U(1)
            _powers[k] = np.cumprod(table, dtype=U)
    return _powers


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together; a longer document has a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order of their starts and may overlap."""
    out = np.empty(len(starts), U)
    code = _CODE_LOWER if lower else _CODE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 18), "left")))
        low, high = int(starts[i]), int(ends[i:j].max())
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, U)
        np.cumsum(code[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


class Words:
    """Words of documents ``i`` to ``j`` of a buffer: ``doc`` (from 0), ``start``, ``end`` and ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        before[:1] = False
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        after[-1:] = False
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = span_hashes(data, self.start, self.end, lower) if hashes else None

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words within a document."""
        last = len(self.start) - size + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:last] == self.doc[size - 1:])
        return at, chain([self.hash[at + k] for k in range(size)])


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes."""
    h = mix(parts[0] + U(len(parts)))
    for x in parts[1:]:
        h = mix(h * U(0xA0761D6478BD642F) + x)
    return h


def runs(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of ``size`` hashes (one size a run) from ``first``."""
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes) * up[:len(hashes)], out=sums[1:])
    return chain([(sums[first + size] - sums[first]) * down[first], size.astype(U)])


def each_block(column, lower: bool = False, hashes: bool = True, limit: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """``(i, j, words)`` for blocks of a text column."""
    data, offsets = buffer(column)
    for i, j in blocks(offsets, limit):
        yield i, j, Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower, hashes)


def per_doc(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    out = np.bincount(doc, weights=weights, minlength=n)
    return out if weights is not None else out.astype(np.int64)


def lut(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


def doc_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each document's bytes."""
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_bytes(column) -> list[bytes]:
    """Each text as bytes; nulls are empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
