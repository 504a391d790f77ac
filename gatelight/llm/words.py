"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of bytes other than ASCII white space. All hashes are 64 bits wide and
depend on nothing but the word's bytes, so they agree across tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step covers; a longer text is one step of its own.
PIECE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same set for Java and RE2 patterns.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
_COEF = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of some byte ranges, none of them empty."""
    size = ends - starts
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1])
    inside = np.arange(total, dtype=np.int32 if total < 2**31 else np.int64)
    inside -= np.repeat(at.astype(inside.dtype), size)
    own = data[starts[0] : starts[0] + total] if (starts[1:] == ends[:-1]).all() else data[inside + np.repeat(starts.astype(inside.dtype), size)]
    value = _COEF[inside & 4095]
    value *= own.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``most`` bytes each, or one document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of some documents: byte ranges, document numbers, and per document the first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data, self.offs, n = data, offs, len(data)
        self.ends = self.starts = np.zeros(0, np.int64)
        if n:
            ink = ~_SPACE[data]
            edge = np.zeros(n + 1, bool)
            edge[offs] = True
            before = np.empty(n, bool)
            before[0], before[1:] = False, ink[:-1]
            self.starts = np.flatnonzero(ink & (~before | edge[:-1]))
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, ink[1:]
            self.ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``most`` bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return hash_spans(self.data, self.starts, ends)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring items; item i begins the i-th, and the last n - 1 wrap on zeros."""
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        coef = _COEF[k]
        out[: len(h) - k] += h[k:] * coef
    return mix(out)
