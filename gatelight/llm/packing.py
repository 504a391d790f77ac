"""Hierarchical residual packing of documents into bins of ``capacity`` tokens.

Each input partition packs its own documents best-fit, largest first. Bins that are nearly full
(``full`` of the capacity) are done. The others go up a tree as items: ``fan`` partitions' residual
bins meet, whole bins are packed best-fit into bins again, nearly full ones are emitted, and so on to
the root, which emits the rest. Only (id, start, length) travels, never text.

A document of more than ``capacity`` tokens is cut into pieces: full ones, which are bins of their
own at once, and the remainder, which is packed like a short document.

* Lengths are ids of the public byte-level BPE vocabulary over the whole text (``byte_bpe_50k``; the
  folder is a parameter), plus one for the end-of-document id.
* A document of a null or an empty text has that one token. Rows that share a doc_id, null included,
  are items of their own. Ties go to the lower bin and the earlier row.
* An empty table gives no bin. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .tables import field, modest
from .tokens import byte_bpe
from .words import buffers

CAPACITY = 4096
FULL = 0.98
FAN = 16

_SIDE = "ids array<{0}>, starts array<int>, lens array<int>, used int, part long, no int"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in bins, largest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free tokens and the bin, in order
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k == len(room):
            bins.append([i])
            free, b = capacity - size, len(bins) - 1
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            free -= size
        if free:
            insort(room, (free, b))
    return bins


def _local(batches: Iterator[pa.RecordBatch], capacity: int, path: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids, sizes = [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        sizes.append(byte_bpe(path).batch(*buffers(batch.column(1)))[1] + 1)
        kind = batch.schema.field(0).type
    if not ids:
        return
    size = np.concatenate(sizes)
    whole, rest = size // capacity, size % capacity
    doc = np.repeat(np.arange(len(size)), whole)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [([d], [k * capacity], [capacity]) for d, k in zip(doc.tolist(), piece.tolist())]
    some = np.flatnonzero(rest)
    for b in best_fit(rest[some], capacity):
        at = some[b]
        out.append((at.tolist(), (whole[at] * capacity).tolist(), rest[at].tolist()))
    for lo in range(0, len(out), 4096):
        yield _bins([([ids[i] for i in x], s, n) for x, s, n in out[lo : lo + 4096]], part, kind, lo)


def _bins(rows: list[tuple[list, list[int], list[int]]], part: int, kind: pa.DataType, no: int = 0) -> pa.RecordBatch:
    x, s, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(kind)), pa.array(s, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array([sum(k) for k in n], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(range(no, no + len(rows)), pa.int32())], ["ids", "starts", "lens", "used", "part", "no"])


def _again(key: tuple, table: pa.Table, capacity: int) -> pa.Table:
    """Underfull bins of several partitions as items; part becomes the group's own number."""
    ids, starts, lens = (table.column(c).to_pylist() for c in ("ids", "starts", "lens"))
    used = np.array(table.column("used").to_pylist(), np.int64)
    order = sorted(range(len(ids)), key=lambda i: (used[i], [(x is None, x) for x in ids[i]], starts[i]))
    rows = []
    for b in best_fit(used[order], capacity):
        at = [order[i] for i in b]
        rows.append(([x for i in at for x in ids[i]], [x for i in at for x in starts[i]], [x for i in at for x in lens[i]]))
    return pa.Table.from_batches([_bins(rows, key[0].as_py(), table.schema.field("ids").type.value_type)])


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan: int = FAN, path: str | None = None) -> DataFrame:
    """bin_id, used, and in bin order doc_ids, starts and lengths in tokens of what each bin holds."""
    modest(spark)
    schema = _SIDE.format(docs.schema["doc_id"].dataType.simpleString())
    own = docs.select(field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    bins = materialize(own.mapInArrow(lambda it: _local(it, capacity, path), schema))
    limit = int(full * capacity)
    done = [bins.where(F.col("used") >= limit)]
    rest = bins.where(F.col("used") < limit)
    parts = rest.agg(F.max("part")).first()[0]
    level = 0
    while parts is not None and (parts > 0 or level == 0):
        level += 1
        parts //= fan
        merged = rest.groupBy((F.floor(F.col("part") / fan)).alias("up")).applyInArrow(lambda key, table: _again(key, table, capacity), schema)
        bins = materialize(merged)
        if parts > 0:
            done.append(bins.where(F.col("used") >= limit))
            rest = bins.where(F.col("used") < limit)
        else:
            rest = bins
    done.append(rest)
    out = done[0].withColumn("level", F.lit(0))
    for k, x in enumerate(done[1:], 1):
        out = out.unionByName(x.withColumn("level", F.lit(k)))
    # no two bins share level, part and number: 4, 31 and 28 bits
    out = out.withColumn("bin_id", F.shiftleft(F.col("level").cast("long"), 59).bitwiseOR(F.shiftleft("part", 28)).bitwiseOR(F.col("no").cast("long")))
    return out.select("bin_id", "used", F.col("ids").alias("doc_ids"), "starts", F.col("lens").alias("lengths"))
