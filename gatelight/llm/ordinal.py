"""Ordinal quality: cumulative-link regression on graded ratings.

Hashed-text features share one weight vector; K - 1 ordered thresholds cut its score into K grades:
P(grade >= k) = sigmoid(x.w - threshold_k). Thresholds are fitted as a first one and positive steps, so
they can't cross. A document has an expected grade, the sum of P(grade >= k), and a tail probability,
P(grade >= ``tail``); it is selected from ``cut`` on, ties included.

Features are presences of words, of words' first four bytes and of their last three, each counted once
and scaled to length one, so that long and short documents are alike.

* Grades are the column ``grade`` of labels where there is one; else quality * (2 - toxic): 0 for a
  poor document, 1 for a good but toxic one, 2 for a good one (just quality, without a toxic column).
  Grades are ranked, so any numbers serve, fractions too; null, NaN and what is no number are left out.
* Fitted on at most ``rows`` labelled rows (``linear.ROWS``), those with the least hashes of their ids;
  scoring covers all rows. Only features that these rows hold have weights.
* Labels with neither a grade nor a quality column count as none.
* A null or blank text has no features and the score 0. Labels with fewer than two grades, or none,
  give every document the one grade (0 without labels), and tail probability 1.0 if it reaches the tail.
* Repeated rows are each scored. Case is ignored. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import ROWS, Sparse, collected, sample
from .tables import field, modest
from .words import Words, buffers, hash_spans, pieces

BITS = 18
TAIL, CUT = 1, 0.5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each once and in order."""
    w = Words(data, offs)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = w.ends - w.starts
    keys = []
    for k, h in enumerate((w.hashes(), w.hashes(4), hash_spans(data, np.maximum(w.starts, w.ends - 3), w.ends))):
        h = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        key = (w.doc.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS))
        keys.append(key if k == 0 else key[size > 3])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Ordinal:
    grades: list[float]
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for the second grade on, one column each."""
        data, offs = buffers(column)
        score = np.zeros(len(offs) - 1)
        for lo, hi in pieces(offs):
            doc, col = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            size = np.maximum(np.bincount(doc, minlength=hi - lo), 1)
            score[lo:hi] = np.bincount(doc, self.weights[col], hi - lo) / np.sqrt(size)
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit_rows(row: np.ndarray, col: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 200) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood."""
    grades = np.unique(y)
    n, k = len(y), len(grades)
    if k < 2:
        return Ordinal([float(g) for g in grades] or [0.0], np.zeros(1 << BITS), np.zeros(0))
    rank = np.searchsorted(grades, y)
    size = np.maximum(np.bincount(row, minlength=n), 1)
    seen = np.flatnonzero(np.bincount(col, minlength=1 << BITS))
    w = len(seen)
    slot = np.zeros(1 << BITS, np.int32)
    slot[seen] = np.arange(w)
    x = Sparse(row, slot[col], n, w, 1 / np.sqrt(size))
    share = np.array([(rank >= j).mean() for j in range(1, k)])
    at = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(w), [at[0]], np.log(np.maximum(np.diff(at), 1e-3))])
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        step = np.exp(theta[w + 1 :])
        cuts = theta[w] + np.concatenate([[0], np.cumsum(step)])
        p = np.column_stack([np.ones(n), _sigmoid(x.dot(theta[:w])[:, None] - cuts[None, :]), np.zeros(n)])
        up, low = p[np.arange(n), rank], p[np.arange(n), rank + 1]
        own = np.maximum(up - low, 1e-12)
        # derivatives of -log(own) by the score and by each cut
        du, dl = up * (1 - up), low * (1 - low)
        g_score = -(du - dl) / own
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, rank, du / own)
        np.add.at(g_cut, rank + 1, -dl / own)
        g_cut = g_cut[1:k]
        g = np.concatenate([x.tdot(g_score) + l2 * theta[:w], [g_cut.sum()], step * g_cut[::-1].cumsum()[::-1][1:]])
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8) * (1 - 0.95 * t / steps)
    step = np.exp(theta[w + 1 :])
    weights = np.zeros(1 << BITS)
    weights[seen] = theta[:w]
    return Ordinal([float(g) for g in grades], weights, theta[w] + np.concatenate([[0], np.cumsum(step)]))


def graded(labels: DataFrame) -> DataFrame:
    names = {c.lower() for c in labels.columns}
    if "grade" in names:
        grade = field("grade").try_cast("double")
    elif "quality" in names:
        grade = field("quality").try_cast("double") * (F.lit(2) - field("toxic").try_cast("double") if "toxic" in names else F.lit(1))
    else:
        grade = F.lit(None).cast("double")
    return labels.select(field("doc_id").alias("doc_id"), grade.alias("grade"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Ordinal:
    modest(spark)
    table = sample(docs, graded(labels), [F.col("grade")], ["grade"], rows, features)
    f, y = collected(table, ["grade"])
    return fit_rows(np.repeat(np.arange(len(f), dtype=np.int32), [len(x) for x in f]), np.concatenate(f) if f else np.zeros(0, np.int32), y["grade"])


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, tail: int = TAIL, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    """doc_id, expected_grade, tail_probability and whether the document is selected."""
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels, rows))

    @F.arrow_udf("struct<expected_grade: double, tail_probability: double>")
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value
        p = model.tails(texts)
        grades = np.array(model.grades, float)
        expected = grades[0] + p @ np.diff(grades)
        k = int(np.searchsorted(grades, tail))
        top = np.ones(len(texts)) if k == 0 else np.zeros(len(texts)) if k == len(grades) else p[:, k - 1]
        return pa.StructArray.from_arrays([pa.array(np.round(expected, 6)), pa.array(np.round(top, 6))], ["expected_grade", "tail_probability"])

    own = docs.select(field("doc_id").alias("doc_id"), score(F.lower(field("text").cast("string"))).alias("s"))
    return own.select("doc_id", "s.*", (F.col("s.tail_probability") >= cut).alias("selected"))
