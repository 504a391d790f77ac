from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gatelight.llm import packing as pk

from .test_tokens import REAL


def plain(sizes, capacity):
    """Best fit, largest first, by looking at every bin."""
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in range(len(bins)) if room[b] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: (room[b], b))
            bins[b].append(i)
            room[b] -= sizes[i]
        else:
            bins.append([i])
            room.append(capacity - sizes[i])
    return bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    assert pk.best_fit(np.array(sizes, np.int64), 50) == plain(sizes, 50)


def check(docs, bins, capacity):
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(len(REAL.encode_ordinary(r.text or "")) + 1)
    pieces = defaultdict(list)
    for b in bins:
        assert b.used == sum(b.lengths) <= capacity and len(b.doc_ids) == len(b.starts) == len(b.lengths)
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths):
            pieces[d].append((s, n))
    assert set(pieces) == set(want)
    for d, sizes in want.items():
        cut = sorted((s, min(capacity, n - s)) for n in sizes for s in range(0, n, capacity))
        assert sorted(pieces[d]) == cut
    assert len({b.bin_id for b in bins}) == len(bins)


def test_every_token_once(spark, odd_docs, small):
    for docs, capacity in ((odd_docs, 64), (spark.read.parquet(f"{small}/documents.parquet").repartition(20), 512)):
        bins = pk.pack(spark, docs, capacity=capacity, fan=3).collect()
        check(docs, bins, capacity)
        total = sum(b.used for b in bins)
        assert len(bins) <= 1.15 * total / capacity + 2


def test_levels_merge_what_is_left(spark):
    rows = [(i, "a " * 30) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id")
    bins = pk.pack(spark, docs, capacity=400, fan=2).collect()
    check(docs, bins, 400)
    size = len(REAL.encode_ordinary("a " * 30)) + 1
    assert len(bins) <= -(-64 // (400 // size)) + 1


def test_empty(spark, no_docs):
    assert pk.pack(spark, no_docs).count() == 0
