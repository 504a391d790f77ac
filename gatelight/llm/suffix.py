"""Benchmark decontamination with suffix arrays of the training texts.

Each Arrow batch of documents is one shard: its words, hashed to 64 bits, become an alphabet of 16
bits, and the shard's suffixes are sorted over it, four letters a step, as deep as the longest test
item goes. Every suffix of every test item is then binary-searched in every shard. An interval of
the array holds all places where a prefix of that suffix stands; each place is confirmed and extended
on the full word hashes, which gives the longest verbatim match and where it lies. Items that begin alike
match at the same places, so places are held by ``PLACES``, not all at once; where only documents are asked for, one
suffix stands for all that begin with the same needed words.

Words are runs of characters other than ASCII white space, compared as they are written.

* A match counts from ``min_words`` words on; an item with fewer words, but ``least_item`` at least,
  counts when it stands in the text whole; shorter items are not searched.
* A null or empty text has no match. Null items are skipped. Repeated test items are each reported.
* Rows that share a ``doc_id`` (null included) count as one document: it is reported once per item,
  with the longest match, then the least document position, then the least item position.
* Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import field, free, modest
from .words import Words, buffers, ngrams, pieces

MIN_WORDS = 8
LEAST_ITEM = 5
#: Bytes of test text that one pass over the documents carries; more test text takes more passes.
PASS_BYTES = 32 << 20
#: Places that are extended at a time; those of one suffix in one shard stay together.
PLACES = 1 << 20

_SIXTEEN = np.uint64(16)


@dataclass
class Tests:
    """The suffixes of the test items, as hashes of words with a zero after each item."""

    item: np.ndarray  # the item's number, per suffix
    pos: np.ndarray  # the suffix's first word within its item
    at: np.ndarray  # the same within ``words``
    need: np.ndarray  # words that a match needs
    words: np.ndarray
    depth: int
    ids: list


def prepare(rows: list[tuple[object, str | None]], min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> Tests:
    ids = [i for i, t in rows if t is not None]
    w = Words(*buffers(pa.array([t for _, t in rows if t is not None], pa.string())))
    h = w.hashes()
    parts, item, pos, at, need, n = [], [], [], [], [], 0
    for i, size in enumerate(w.count.tolist()):
        own = h[w.first[i] : w.first[i] + size]
        want = min(min_words, size)
        if size >= min(least_item, min_words):
            last = size - want + 1
            item += [i] * last
            pos += range(last)
            at += range(n, n + last)
            need += [want] * last
        parts += [own, np.zeros(1, np.uint64)]
        n += size + 1
    return Tests(*(np.array(x, np.int64) for x in (item, pos, at, need)), np.concatenate(parts) if parts else np.zeros(0, np.uint64), int(w.count.max(initial=0)), ids)


def distinct(tests: Tests) -> Tests:
    """One suffix of those that begin with the same needed words: as good for whether a text has a match, not for which.

    A place that ``search`` leaves to the suffix one word longer matches that one, so some place of the text stays.
    """
    gram = np.zeros(len(tests.at), np.uint64)
    for n in np.unique(tests.need).tolist():
        own = tests.need == n
        gram[own] = ngrams(tests.words, n)[tests.at[own]]
    _, rep, inv = np.unique(gram, return_index=True, return_inverse=True)
    rep = rep[inv]
    same = tests.need == tests.need[rep]  # by the words themselves, so that no two hashes alike lose a suffix
    depth = int(tests.need.max(initial=0))
    for k in range(depth):
        deep = np.flatnonzero(same & (tests.need > k))
        same[deep] = tests.words[tests.at[deep] + k] == tests.words[tests.at[rep[deep]] + k]
    stay = ~same | (rep == np.arange(len(rep)))
    return Tests(tests.item[stay], tests.pos[stay], tests.at[stay], tests.need[stay], tests.words, depth, tests.ids)


def _packed(words: np.ndarray) -> np.ndarray:
    """Letter i to i + 3 of 16 bits each in one number; a word's letter is never 0, that of an end is."""
    letter = np.where(words == 0, np.uint64(0), np.uint64(1) + (words >> np.uint64(17)) % np.uint64(65535))
    out = np.zeros(len(letter), np.uint64)
    for k in range(4):
        out[: len(letter) - k] |= letter[k:] << (_SIXTEEN * np.uint64(3 - k))
    return out


def _ended(key: np.ndarray) -> np.ndarray:
    """Whether the text ends within these four letters."""
    return (key & np.uint64(0xFFFF)) == 0


def suffix_array(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions ordered by the ``depth`` letters that begin there, and their first four letters."""
    sa = np.argsort(key)
    first = key[sa]
    tied = np.zeros(len(sa), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    tied &= ~_ended(first)
    where = np.flatnonzero(tied)
    group = np.cumsum(np.concatenate([[True], ~same]))[where] if len(sa) else where
    step = 4
    while step < depth and len(where):
        at = sa[where]
        nxt = key[np.minimum(at + step, len(key) - 1)]
        order = np.lexsort((nxt, group))
        sa[where] = at[order]
        nxt, group = nxt[order], group[order]
        same = (group[1:] == group[:-1]) & (nxt[1:] == nxt[:-1])
        tied = np.zeros(len(where), bool)
        tied[1:] |= same
        tied[:-1] |= same
        tied &= ~_ended(nxt)
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        where = where[tied]
        step += 4
    return sa, first


def _bounds(q: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest key that agrees with q in its first ``left`` letters."""
    rest = np.uint64(16) * (4 - np.minimum(left, 4)).astype(np.uint64)
    low = (np.uint64(1) << rest) - np.uint64(1)
    return q & ~low, q | low


def _extended(q: np.ndarray, p: np.ndarray, words: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where suffix q stands at p on full hashes, as far as it needs, and for how many words."""
    size = np.zeros(len(q), np.int64)
    live = np.arange(len(q))
    for k in range(tests.depth):
        a, b = tests.words[tests.at[q[live]] + k], words[np.minimum(p[live] + k, len(words) - 1)]
        live = live[(a == b) & (a != 0)]
        if not len(live):
            break
        size[live] += 1
    good = size >= tests.need[q]
    return q[good], p[good], size[good]


def search(words: np.ndarray, tests: Tests) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Left-maximal matches in a shard of zero-ended documents, some at a time: suffix number, position, length."""
    if not len(words) or not len(tests.at):
        return
    key, test_key = _packed(words), _packed(tests.words)
    sa, first = suffix_array(key, tests.depth)
    lo_key, hi_key = _bounds(test_key[tests.at], tests.need)
    lo, hi = np.searchsorted(first, lo_key, "left"), np.searchsorted(first, hi_key, "right")
    found_q, found_p, held = [], [], 0
    for q in np.flatnonzero(hi > lo):
        a, b, done = int(lo[q]), int(hi[q]), 4
        while done < tests.need[q] and b > a:
            x, y = _bounds(test_key[tests.at[q] + done : tests.at[q] + done + 1], tests.need[q : q + 1] - done)
            inner = key[np.minimum(sa[a:b] + done, len(key) - 1)]
            a, b = a + int(np.searchsorted(inner, x[0], "left")), a + int(np.searchsorted(inner, y[0], "right"))
            done += 4
        if b > a:
            p = sa[a:b]
            before = tests.words[tests.at[q] - 1] if tests.pos[q] else np.uint64(0)
            p = p[(p == 0) | (words[p - 1] != before) | (before == 0)]
            found_q.append(np.full(len(p), q))
            found_p.append(p)
            held += len(p)
        if held >= PLACES:
            yield _extended(np.concatenate(found_q), np.concatenate(found_p), words, tests)
            found_q, found_p, held = [], [], 0
    if held:
        yield _extended(np.concatenate(found_q), np.concatenate(found_p), words, tests)


def _best(row: np.ndarray, item: np.ndarray, n: np.ndarray, at: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row and item the longest match, then that of the least places."""
    order = np.lexsort((pos, at, -n, item, row))
    row, item = row[order], item[order]
    lead = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])[: len(row)]
    return row[lead], item[lead], *(x[order][lead] for x in (n, at, pos))


def shard_matches(column: pa.Array, tests: Tests) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, item number, words, document position and item position of the matches in a batch, some at a time."""
    data, offs = buffers(column)
    for lo, hi in pieces(offs, 8 << 20):
        rows, hashes = [], []
        for a, b in pieces(offs[lo : hi + 1]):
            own = offs[lo + a : lo + b + 1]
            w = Words(data[own[0] : own[-1]], own - own[0])
            h = np.zeros(len(w) + b - a, np.uint64)
            h[np.arange(len(w)) + w.doc] = w.hashes()
            hashes.append(h)
            rows.append(w.count + 1)
        size = np.concatenate(rows)
        start = np.cumsum(size) - size
        for q, p, n in search(np.concatenate(hashes), tests):
            row = np.searchsorted(start, p, "right") - 1
            yield _best(row + lo, tests.item[q], n, p - start[row], tests.pos[q])


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """The test items in lists of bounded size. The driver holds one list at a time."""
    own = benchmark.select(field("item_id").alias("item_id"), field("text").alias("text")).where("text is not null")
    rows, held = [], 0
    for r in own.toLocalIterator():
        rows.append((r.item_id, r.text))
        held += 4 * len(r.text)
        if held >= PASS_BYTES:
            yield rows
            rows, held = [], 0
    yield rows


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """doc_id, item_id, match_words, doc_pos, item_pos: the longest match of each document and item."""
    modest(spark)
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    own = docs.select(field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    schema = f"doc_id {doc_kind.simpleString()}, item_no int, match_words int, doc_pos int, item_pos int"
    out = None
    for rows in _passes(benchmark):
        ids = [r[0] for r in rows]
        shared = spark.sparkContext.broadcast(prepare(rows, min_words, least_item))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, item, n, at, pos in shard_matches(batch.column(1), shared.value):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (item, n, at, pos))], ["doc_id", "item_no", "match_words", "doc_pos", "item_pos"])

        names = spark.createDataFrame(list(enumerate(ids)), f"item_no int, item_id {item_kind.simpleString()}")
        best = own.mapInArrow(scan, schema).groupBy("doc_id", "item_no").agg(F.min(F.struct((-F.col("match_words")).alias("m"), "doc_pos", "item_pos")).alias("b"))
        part = best.join(F.broadcast(names), "item_no").select("doc_id", "item_id", (-F.col("b.m")).alias("match_words"), F.col("b.doc_pos").alias("doc_pos"), F.col("b.item_pos").alias("item_pos"))
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(shared):
    @F.arrow_udf("boolean")
    def leaks(text: pa.Array) -> pa.Array:
        found = np.zeros(len(text), bool)
        for row, *_ in shard_matches(text, shared.value):
            found[row] = True
        return pa.array(found)

    return leaks


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The documents without those that hold a match; all columns as they were."""
    modest(spark)
    (hit,) = free(docs, "hit")
    for rows in _passes(benchmark):
        leaks = _leaks(spark.sparkContext.broadcast(distinct(prepare(rows, min_words, least_item))))
        docs = docs.withColumn(hit, leaks(field("text").cast("string"))).where(~F.col(hit)).drop(hit)
    return docs
