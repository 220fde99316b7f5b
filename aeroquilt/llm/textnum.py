"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of bytes other than the ASCII white space ``[\\x20\\x09-\\x0D]``; ASCII letters are lower-cased.
Word and shingle identities are 64-bit hashes: a polynomial over the bytes, then an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 21, rows: int = 32_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes, so that temporary arrays stay small; one long document stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(i + 1, min(j, i + rows)))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each document the index of its first word (n + 1 of them)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~_WS[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _B, n), out=total[1:])
    h = (total[end + 1] - total[begin]) * _power("down", _B_INV, n)[begin]
    return mix(h + (end - begin).astype(np.uint64)), np.searchsorted(begin, off)


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a document, and the document's index.  A document of 1 to k - 1 words has one shingle, all its words."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][doc]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    last = at[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for j in range(k):
        w = padded[start + j]
        w[start + j >= last] = 0
        h += w * _STEP[j]
    return mix(h), doc


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, times), sorted by document and then hash."""
    if len(h) == 0:
        return h, doc, np.zeros(0, np.int64)
    order = np.argsort(h)
    if doc[-1] < 1 << 16:
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(new)
    return h[where], doc[where], np.diff(np.append(where, len(h)))
