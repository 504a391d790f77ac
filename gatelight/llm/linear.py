"""Hashed text features and the numpy fitting that the two classifiers share.

Fitting takes a bounded sample of labelled rows to the driver (``ROWS``, a parameter of the
operators); scoring is a pass over the whole table that shuffles nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize
from .tables import field
from .words import Words, buffers, pieces

#: The most labelled rows that a classifier is fitted on; those with the least hashes of their ids.
ROWS = 12_000
BITS = 20


def presence(data: np.ndarray, offs: np.ndarray, heads: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each once: hashed words and the words' first bytes."""
    w = Words(data, offs)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = []
    size = w.ends - w.starts
    for k, head in enumerate((None, *heads)):
        h = w.hashes(head) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        key = (w.doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
        keys.append(key if head is None else key[size > head])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, columns: list[Column], names: list[str], rows: int, features: Callable, lower: bool = True) -> DataFrame:
    """h, f, y_<name> of at most ``rows`` labelled documents, the same at every run, as a written table.

    Documents are those with the least hashes h of their ids among all that have a label and a row in docs, so
    labels without a document take no place. Null ids, and null or NaN labels, are left out; of labels that share
    an id the least are taken, of documents that share one that whose text has the least hash. A null text has no
    feature. Ids are chosen first; texts are turned into features f (by ``features``) where they lie.
    """
    kind = docs.schema["doc_id"].dataType
    values = [F.when(~F.isnan(c.try_cast("double")), c.try_cast("double")).alias(f"y_{n}") for c, n in zip(columns, names)]
    ys = [f"y_{n}" for n in names]
    own = labels.select(field("doc_id").try_cast(kind).alias("id"), *values).dropna().groupBy("id").agg(*[F.min(y).alias(y) for y in ys])
    own = materialize(own.withColumn("h", F.xxhash64("id")))
    ids = docs.select(field("doc_id").alias("id")).where("id is not null").withColumn("h", F.xxhash64("id"))
    # the share of the hash space that should hold enough, and more of it while it doesn't
    share = 2 * rows / max(1, own.count())
    while True:
        near, there = (own, ids) if share >= 1 else (x.where(F.col("h") < int((share - 0.5) * 2**64)) for x in (own, ids))
        found = materialize(near.join(there.select("id"), "id", "left_semi"))
        if share >= 1 or found.count() >= rows:
            break
        share *= 8
    chosen = found.orderBy("h", "id").limit(rows)
    text = F.coalesce(field("text").cast("string"), F.lit(""))
    text = F.lower(text) if lower else text
    mine = docs.select(field("doc_id").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id").select("text", "id", F.xxhash64("text").alias("pick"), "h", *ys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for lo, hi in pieces(offs):
                doc, col = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(col, pa.int32())), *part.columns[1:]], ["f", "id", "pick", "h", *ys])

    made = mine.mapInArrow(scan, f"f array<int>, id {kind.simpleString()}, pick long, h long, " + ", ".join(f"{y} double" for y in ys))
    return materialize(made.groupBy("id").agg(F.min_by("f", "pick").alias("f"), F.first("h").alias("h"), *[F.first(y).alias(y) for y in ys]))


def collected(table: DataFrame, names: list[str]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """The sample's features and labels on the driver, in the order of the ids' hashes."""
    got = table.toArrow()
    got = got.sort_by([("h", "ascending"), ("id", "ascending")])
    f = got.column("f").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, at = f.values.to_numpy(), f.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])], {c: got.column(f"y_{c}").to_numpy() for c in names}


def spread(spark: SparkSession) -> Callable:
    """A ``map`` that runs each call as a task of its own. What it returns is pickled."""

    def run(work: Callable, jobs: list) -> list:
        if len(jobs) < 2:
            return [work(j) for j in jobs]

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(work(jobs[k]))], pa.binary())], ["k", "out"])

        got = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(tasks, "k long, out binary").collect()
        return [pickle.loads(bytes(r.out)) for r in sorted(got, key=lambda r: r.k)]

    return run


class Sparse:
    """Rows of binary features, as flat pairs in the rows' order; ``scale`` multiplies a whole row."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int, scale: np.ndarray | None = None) -> None:
        self.row, self.col, self.n, self.width, self.scale = row.astype(np.int32), col.astype(np.int32), n, width, scale
        self._by_row, self._by_col = _runs(self.row), None

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = _summed(w[self.col], *self._by_row, self.n)
        return out if self.scale is None else out * self.scale

    def tdot(self, g: np.ndarray) -> np.ndarray:
        if self._by_col is None:
            order = np.argsort(self.col, kind="stable")
            self._by_col = (*_runs(self.col[order]), self.row[order])
        at, which, row = self._by_col
        return _summed((g if self.scale is None else g * self.scale)[row], at, which, self.width)

    def take(self, rows: np.ndarray) -> Sparse:
        new = np.full(self.n, -1, np.int32)
        new[rows] = np.arange(len(rows))
        keep = new[self.row] >= 0
        return Sparse(new[self.row[keep]], self.col[keep], len(rows), self.width, None if self.scale is None else self.scale[rows])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the keys."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return at, key[at]


def _summed(x: np.ndarray, at: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    if len(at):
        out[which] = np.add.reduceat(x, at)
    return out


def informative(df: np.ndarray, pos: np.ndarray, n: int, p: float, most: int, least: float = 15.0) -> np.ndarray:
    """The features that tell most of being positive, by the log-likelihood ratio, ``least`` at least.

    From each feature's documents df and positive documents pos, and n documents of which p are positive. Only
    features that positive documents hold more often.
    """
    if not 0 < p < n:
        return np.zeros(0, np.int64)
    df, pos = df.astype(float), pos.astype(float)

    def term(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(m, 1e-12)), 0)

    g = term(pos, df * p / n) + term(df - pos, df * (n - p) / n) + term(p - pos, (n - df) * p / n) + term(n - p - df + pos, (n - df) * (n - p) / n)
    g[pos * n <= df * p] = 0
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(best[2 * g[best] >= least])


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse features, none below 0, of the dense ones, and the intercept, by Adam on all rows."""
    n, k = x.width, extra.shape[1]
    theta, m, v = np.zeros(n + k + 1), np.zeros(n + k + 1), np.zeros(n + k + 1)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    theta[-1] = np.log(rate / (1 - rate))
    for t in range(1, steps + 1):
        z = x.dot(theta[:n]) + extra @ theta[n:-1] + theta[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([x.tdot(e), extra.T @ e, [e.sum()]])
        g[:-1] += l2 * theta[:-1]
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        theta -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8) * (1 - 0.9 * t / steps)
        np.maximum(theta[:n], 0, out=theta[:n])
    return theta[:n], theta[n:-1], float(theta[-1])
