"""Toxicity with a classifier chain.

The categories stand in an order. Category k has a logistic model on hashed words and word heads (a
feature counts once per document) and on the log-odds that the models of the categories before it
give. Its features are those that positive rows hold more often, and their weights are not negative, so
a document's other words don't dilute what it holds. The earlier log-odds are out-of-fold while fitting: each row's come from models that didn't see it.
When a document is scored, the models of the earlier categories are the ones fitted on all rows.

The categories are those of ``CATEGORIES`` (or the parameter) that ``labels`` has as columns, whatever their
case; the last, ``toxic``, is the one that decides. Where labels have no other than it, as the stored ones, the
earlier links are learned: the toxic rows are parted into ``KINDS`` kinds by what they hold (spherical
k-means over the chosen features), and each kind is a category, ``kind_1`` and so on.

* Fitted on at most ``rows`` labelled rows (``linear.ROWS``), those with the least hashes of their
  ids; everything else covers all rows.
* A null or empty text has the models' base probability, or 0.0 where nothing could be fitted: no
  labelled row, no column of the last category in ``labels``, or labels all of one kind (then that share, 0.0 or 1.0).
* Labels that are null, NaN or no number are left out; those above 0 are positive.
* Case is ignored; whole texts are read. Repeated rows are each scored. Other columns are not read.
* ``p >= cut`` is toxic, so a tie at the cut is toxic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import BITS, ROWS, Sparse, collected, informative, logistic, presence, sample, spread
from .tables import field, free, modest
from .words import buffers, pieces

#: In the chain's order; the last decides.
CATEGORIES = ("obscene", "insult", "threat", "identity_hate", "severe_toxic", "toxic")
KINDS = 2
CUT = 0.3
FEATURES = 6000
FOLDS = 5


@dataclass
class Chain:
    names: list[str]
    slot: np.ndarray  # feature to its place among the chosen ones, the last place for all others
    weights: np.ndarray  # one column a category; the last row is zero
    feed: list[np.ndarray]  # weights on the earlier categories' log-odds
    bias: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities, one column a category."""
        data, offs = buffers(column)
        odds = np.zeros((len(offs) - 1, len(self.names)))
        for lo, hi in pieces(offs):
            doc, col = presence(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            at = self.slot[col]
            keep = at < len(self.weights) - 1
            doc, at = doc[keep], at[keep]
            for k in range(len(self.names)):
                odds[lo:hi, k] = np.bincount(doc, self.weights[at, k], hi - lo) + odds[lo:hi, :k] @ self.feed[k] + self.bias[k]
                np.clip(odds[lo:hi, k], -30, 30, out=odds[lo:hi, k])
        return 1 / (1 + np.exp(-odds))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] | None = None, rows: int = ROWS) -> Chain:
    modest(spark)
    categories = categories or CATEGORIES
    target = categories[-1]
    place = {c.lower(): i for i, c in reversed(list(enumerate(labels.columns)))}
    names = [c for c in categories if c.lower() in place]
    if target not in names:
        return fit_rows([], {c: np.zeros(0) for c in (*names, target)}, target)
    # columns by place, for names that differ only in case
    own = labels.toDF(*[f"c{i}" if i != place["doc_id"] else "doc_id" for i in range(len(labels.columns))])
    table = sample(docs, own, [F.col(f"c{place[c.lower()]}") for c in names], names, rows, presence)
    every = [F.sum((F.col(f"y_{c}") > 0).cast("long")) for c in names]
    n, *positive = (table.agg(F.count("*"), *every)).first()
    counts = table.select(F.explode("f").alias("x"), *[f"y_{c}" for c in names]).groupBy("x").agg(F.count("*").alias("n"), *[x.alias(c) for x, c in zip(every, names)]).toArrow()

    def dense(name: str) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[counts.column("x").to_numpy()] = counts.column(name).to_numpy()
        return out

    df = dense("n")
    chosen = np.unique(np.concatenate([informative(df, dense(c), n, p or 0, FEATURES) for c, p in zip(names, positive)]))
    # only the chosen features leave the executors
    if len(chosen):
        known = spark.createDataFrame(pa.table({"x": pa.array(chosen, pa.int32())}))
        mine = table.select("id", F.explode("f").alias("x")).join(F.broadcast(known), "x").groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("f"))
        table = table.drop("f").join(mine, "id", "left").withColumn("f", F.coalesce("f", F.array().cast("array<int>")))
    else:
        table = table.withColumn("f", F.array().cast("array<int>"))
    feats, y = collected(table, names)
    return fit_rows(feats, y, target, chosen, spread(spark))


def kinds(x: Sparse, toxic: np.ndarray, many: int, steps: int = 10) -> np.ndarray:
    """For each row the kind of toxic row that it is, from 0; -1 for others. Spherical k-means, begun at the rows least like the mean."""
    at = np.flatnonzero(toxic)
    own = x.take(at)
    size = np.maximum(np.sqrt(np.bincount(own.row, minlength=own.n)), 1)

    def centre(rows: np.ndarray) -> np.ndarray:
        c = own.tdot(rows / size)
        return c / max(np.sqrt((c * c).sum()), 1e-12)

    centres = [centre(np.ones(own.n))]
    near = own.dot(centres[0]) / size
    for _ in range(many):
        first = np.zeros(own.n)
        first[int(np.argmin(near))] = 1
        centres.append(centre(first))
        near = np.maximum(near, own.dot(centres[-1]) / size)
    centres = centres[1:]
    for _ in range(steps):
        best = np.argmax(np.stack([own.dot(c) / size for c in centres]), 0)
        centres = [centre((best == k).astype(float)) if (best == k).any() else c for k, c in enumerate(centres)]
    out = np.full(x.n, -1)
    out[at] = best
    return out


def fit_rows(feats: list[np.ndarray], y: dict[str, np.ndarray], target: str, chosen: np.ndarray | None = None, run: Callable = lambda work, jobs: [work(j) for j in jobs]) -> Chain:
    """The chain from rows of features. ``run`` maps a function over jobs; each category's folds are one such job each."""
    n = len(feats)
    row = np.repeat(np.arange(n), [len(f) for f in feats])
    col = np.concatenate(feats).astype(np.int64) if n else np.zeros(0, np.int64)
    if chosen is None:
        df = np.bincount(col, minlength=1 << BITS)
        chosen = np.unique(np.concatenate([informative(df, np.bincount(col, (y[c] > 0)[row].astype(float), 1 << BITS), n, float((y[c] > 0).sum()), FEATURES) for c in y])) if n else np.zeros(0, np.int64)
    slot = np.full(1 << BITS, len(chosen), np.int32)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[col] < len(chosen)
    x = Sparse(row[keep], slot[col[keep]].astype(np.int64), n, len(chosen))
    y = {c: (v > 0).astype(float) for c, v in y.items()}
    if len(y) == 1 and 0 < y[target].sum() < n:
        kind = kinds(x, y[target] > 0, KINDS)
        y = {f"kind_{k + 1}": (kind == k).astype(float) for k in range(KINDS)} | y
    elif len(y) == 1:
        y = {f"kind_{k + 1}": np.zeros(n) for k in range(KINDS)} | y
    names = list(y)
    fold = np.arange(n) % FOLDS  # the rows come in the order of their ids' hashes
    weights, feed, bias = np.zeros((len(chosen) + 1, len(names))), [], np.zeros(len(names))
    earlier = np.zeros((n, 0))
    for k, name in enumerate(names):
        own = y[name]
        if not 0 < own.sum() < n:
            feed.append(np.zeros(k))
            bias[k] = 30.0 if n and own.all() else -30.0
            earlier = np.column_stack([earlier, np.full(n, bias[k])])
            continue

        def without(j: int, x=x, earlier=earlier, own=own) -> tuple:
            """The model of the rows outside fold j (all rows at -1), and what it gives those within."""
            a, b = np.flatnonzero(fold != j), np.flatnonzero(fold == j)
            w, f, c = logistic(x.take(a), earlier[a], own[a])
            return w, f, c, np.clip(x.take(b).dot(w) + earlier[b] @ f + c, -30, 30)

        last = k + 1 == len(names)
        (weights[:-1, k], f, bias[k], _), *folds = run(without, [-1] if last else [-1, *range(min(FOLDS, n))])
        feed.append(f)
        out = np.zeros(n)
        for j, (_, _, _, odds) in enumerate(folds):
            out[fold == j] = odds
        earlier = np.column_stack([earlier, out])
    return Chain(names, slot, weights, feed, bias)


def probabilities(spark: SparkSession, chain: Chain, text: Column) -> Column:
    """A struct of the categories' probabilities, rounded to six places."""
    shared = spark.sparkContext.broadcast(chain)

    @F.arrow_udf("struct<" + ", ".join(f"p_{c}: double" for c in chain.names) + ">")
    def score(texts: pa.Array) -> pa.Array:
        p = np.round(shared.value.score(texts), 6)
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(p.shape[1])], [f"p_{c}" for c in shared.value.names])

    return score(F.lower(text.cast("string")))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = CUT, rows: int = ROWS, categories: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, one probability a category, and whether the document is toxic."""
    chain = fit(spark, docs, labels, categories, rows)
    own = docs.select(field("doc_id").alias("doc_id"), probabilities(spark, chain, field("text")).alias("p"))
    return own.select("doc_id", "p.*", (F.col(f"p.p_{chain.names[-1]}") >= cut).alias("is_toxic"))


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = CUT, rows: int = ROWS) -> DataFrame:
    """The documents that are not toxic; all columns as they were."""
    chain = fit(spark, docs, labels, rows=rows)
    (p,) = free(docs, "p")
    return docs.withColumn(p, probabilities(spark, chain, field("text"))).where(F.col(p)[f"p_{chain.names[-1]}"] < cut).drop(p)
