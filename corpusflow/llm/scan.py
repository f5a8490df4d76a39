"""Vectorised scans of Arrow string columns: words, lines and their 64-bit hashes.

A scan works on the UTF-8 bytes of many documents at once. Word separators are ASCII, so the
bytes of other code points always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: White space of the contracts: a space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Scan:
    """first: index of the first document in its batch; n: documents; word i is
    data[start[i]:end[i]] in document doc[i], counted from first."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def per_doc(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, self.n).astype(np.int64)

    def bytes_per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of bytes with mask in each document."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """Hash of each data[start:end]."""
        n = len(self.data)
        up, down = _power(n + 1)
        table = _BYTE[LOWER] if lower else _BYTE
        total = np.zeros(n + 1, U)
        np.cumsum(table[self.data] * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * _M3)

    def word_hashes(self, lower: bool) -> np.ndarray:
        return self.hashes(self.start, self.end, lower)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line; lines are split at newlines only."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], cut + 1]))
        doc = np.sort(np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, "right") - 1]))
        stop = np.sort(np.concatenate([self.offsets[1:], cut]))
        return start, stop, doc


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of mask that don't cross an offset."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def parts(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First document, bytes and offsets of pieces of about `size` bytes; a longer document is one of its own.

    Null documents count as empty ones.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n, i + 50_000)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def scans(column: pa.Array | pa.ChunkedArray, separator: np.ndarray = SPACE, size: int = 1 << 20) -> Iterator[Scan]:
    """Scans of parts()."""
    for first, piece, offsets in parts(column, size):
        start, end = spans(~separator[piece], offsets)
        yield Scan(
            first, len(offsets) - 1, piece, offsets, start, end, np.searchsorted(offsets, start, "right") - 1
        )


def windows(scan: Scan, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of k words inside one document."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.flatnonzero(scan.doc[: len(h) - k + 1] == scan.doc[k - 1 :])
    out = h[first]
    for i in range(1, k):
        out = out * _BASE + h[first + i]
    return mix(out), first


def whole(scan: Scan, h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hash of the whole word sequence of each of docs (few words each)."""
    out = np.zeros(len(docs), U)
    lo, hi = np.searchsorted(scan.doc, docs), np.searchsorted(scan.doc, docs, "right")
    for i in range(int((hi - lo).max(initial=0))):
        more = lo + i < hi
        out[more] = out[more] * _BASE + h[lo[more] + i]
    return mix(out + (hi - lo).astype(U) * _M3)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, h) in order of doc, then h, and how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))
