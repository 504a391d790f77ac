"""Bloom filters over 64-bit hashes, built by segment of the hash space, so that no task holds a whole one.

``repeats`` gives the hashes that occur twice or more, by two filters: once seen, and twice seen. ``members``
gives a plain filter of a set. Either is a small table (seg, bits). False positives occur, false negatives don't.
A filter in use is broadcast, so a caller checks ``size`` first and has another way beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: Hashes to a segment, at most about.
SEGMENT = 1 << 18
_K, _BITS_EACH = 3, 16


def segments_for(n: int) -> int:
    """How many segments n hashes are kept in: a power of two, 16 at least."""
    return max(16, 1 << max(0, -(-n // SEGMENT) - 1).bit_length())


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """_K positions per 32-bit hash in a filter of 2^n bits."""
    h = h.astype(np.uint64)
    a, b = h * np.uint64(0x9E3779B97F4A7C15), (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    shift = np.uint64(64 - bits.bit_length() + 1)
    return np.stack([(a + np.uint64(k) * b) >> shift for k in range(_K)])


def _bits(n: int) -> int:
    return 1 << max(6, (max(1, n) * _BITS_EACH - 1).bit_length())


class Bloom:
    """One byte a bit while it is built."""

    def __init__(self, n: int) -> None:
        self.bits = _bits(n)
        self.set = np.zeros(self.bits, bool)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.set[_positions(h, self.bits)].all(0)

    def add(self, h: np.ndarray) -> None:
        self.set[_positions(h, self.bits)] = True


def _holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = _positions(h, len(packed) * 8)
    return ((packed[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1).all(0)


def _split(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and the 32 bits that stand for the hash within it."""
    h = h.view(np.uint64)
    return (h >> np.uint64(40)).astype(np.int64) % segments, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def packer(segments: int) -> Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]]:
    """From arrays of hashes: by segment, four bytes for a distinct one, apart for those met once and more often."""

    def pack(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            seg, low = _split(h, segments)
            order = np.argsort(seg, kind="stable")
            seg, low, times = seg[order], low[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            end = np.append(at[1:], len(seg))
            once = [low[a:b][times[a:b] == 1].tobytes() for a, b in zip(at, end)]
            more = [low[a:b][times[a:b] > 1].tobytes() for a, b in zip(at, end)]
            return pa.RecordBatch.from_arrays([pa.array(seg[at], pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["seg", "once", "more"])

        for h in arrays:
            if len(h):
                held.append(h)
                n += len(h)
            if n > 2_000_000:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return pack


PACKETS = "seg long, once binary, more binary"
_FILTER = "seg long, bits binary"


def _filter(seg: object, found: np.ndarray) -> pa.Table:
    result = Bloom(len(found))
    result.add(found)
    bits = np.packbits(result.set).tobytes() if len(found) else b""
    return pa.table({"seg": pa.array([seg], pa.int64()), "bits": pa.array([bits], pa.binary())})


def _parts(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in table.column(name).to_pylist()]


def _twice(key: tuple, table: pa.Table) -> pa.Table:
    """A hash that the once-seen filter already holds goes into the twice-seen filter."""
    once, more = _parts(table, "once"), _parts(table, "more")
    seen = Bloom(sum(map(len, once)) + sum(map(len, more)))
    twice = list(more)
    for x in more:
        seen.add(x)
    for x in once:
        again = seen.has(x)
        twice.append(x[again])
        seen.add(x[~again])
    return _filter(key[0].as_py(), np.unique(np.concatenate(twice)))


def _all(key: tuple, table: pa.Table) -> pa.Table:
    return _filter(key[0].as_py(), np.unique(np.concatenate(_parts(table, "once") + _parts(table, "more"))))


def repeats(packets: DataFrame) -> DataFrame:
    """The twice-seen filters of packed hashes, written."""
    return materialize(packets.groupBy("seg").applyInArrow(_twice, _FILTER).where("length(bits) > 0"))


def members(hashes: DataFrame, segments: int) -> DataFrame:
    """The filters of the hashes in the one column of a table, written."""
    pack = packer(segments)
    packets = hashes.mapInArrow(lambda it: pack(b.column(0).to_numpy(zero_copy_only=False) for b in it), PACKETS)
    return materialize(packets.groupBy("seg").applyInArrow(_all, _FILTER).where("length(bits) > 0"))


def size(filters: DataFrame) -> int:
    return filters.agg(F.sum(F.length("bits"))).first()[0] or 0


def shared(spark: SparkSession, filters: DataFrame):
    """The filters as a broadcast value for ``probe``."""
    return spark.sparkContext.broadcast({r.seg: np.frombuffer(bytes(r.bits), np.uint8) for r in filters.toLocalIterator()})


def probe(filters: dict[int, np.ndarray], segments: int, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter of its segment."""
    seg, low = _split(h, segments)
    hit = np.zeros(len(h), bool)
    order = np.argsort(seg, kind="stable")
    ranked = seg[order]
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else []
    for a, b in zip(at, np.append(at[1:], len(h))):
        if (own := filters.get(int(ranked[a]))) is not None:
            hit[order[a:b]] = _holds(own, low[order[a:b]])
    return hit


def maybe(spark: SparkSession, filters: DataFrame, segments: int):
    """A function of a column of hashes: whether the filters may hold it."""
    own = shared(spark, filters)

    @F.arrow_udf("boolean")
    def holds(h: pa.Array) -> pa.Array:
        return pa.array(probe(own.value, segments, h.to_numpy(zero_copy_only=False)))

    return holds


def segment_of(h: str, segments: int):
    """The segment as a column, for filters that are too large to broadcast."""
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(segments))


def found_in(hashes: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """h: the distinct hashes of a table's column h that the filters hold, by shuffling hashes to the segments."""

    def check(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bits = {r["seg"]: np.frombuffer(r["bits"], np.uint8) for r in right.to_pylist()}
        h = left.column("h").combine_chunks().to_numpy(zero_copy_only=False)
        return pa.table({"h": pa.array(np.unique(h[probe(bits, segments, h)]), pa.int64())})

    each = hashes.groupBy("h").agg(F.lit(1).alias("one")).select("h", segment_of("h", segments).alias("seg"))
    return each.groupBy("seg").cogroup(filters.groupBy("seg")).applyInArrow(check, "h long")
