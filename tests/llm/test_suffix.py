import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gatelight.llm import suffix as sx

from .conftest import words


def brute(docs, items, least=sx.MIN_WORDS, short=sx.LEAST_ITEM):
    """(doc_id, item_id) -> longest match and its least places."""
    best = {}
    for i, t in docs:
        d = (t or "").split()
        for j, text in items:
            if text is None:
                continue
            w = text.split()
            need = min(least, len(w))
            if len(w) < min(short, least):
                continue
            for a in range(len(d)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(d) and b + n < len(w) and d[a + n] == w[b + n]:
                        n += 1
                    if n >= need:
                        key = (i, j)
                        best[key] = min(best.get(key, (0, 0, 0)), (-n, a, b)) if key in best else (-n, a, b)
    return {k: (-n, a, b) for k, (n, a, b) in best.items()}


@pytest.fixture(scope="module")
def tables(spark, odd_docs, bench_items):
    import random

    rng = random.Random(4)
    items = [(100 + k, words(rng, rng.randint(4, 25), 12 if k % 3 else 5000)) for k in range(25)]
    docs = []
    for k in range(120):
        text = words(rng, rng.randint(0, 60), 12 if k % 2 else 5000).split()
        if k % 3 == 0:
            w = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(w) - 8))
            text[len(text) // 2 : len(text) // 2] = w[a : a + rng.randint(6, 25)]
        docs.append((1000 + k, " ".join(text)))
    return odd_docs.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True), bench_items.unionByName(spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("pass_bytes", [sx.PASS_BYTES, 200])
def test_equals_brute_force(spark, tables, monkeypatch, pass_bytes):
    monkeypatch.setattr(sx, "PASS_BYTES", pass_bytes)
    docs, items = tables
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 10_000]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    got = sx.matches(spark, docs, items).collect()
    assert {(r.doc_id, r.item_id): (r.match_words, r.doc_pos, r.item_pos) for r in got} == want and len(want) > 20
    kept = sx.decontaminate(spark, docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect() if not any(k[0] == r.doc_id for k in want))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 4, 500).astype(np.uint64) << np.uint64(20)
    w[[100, 200, 499]] = 0
    sa, _ = sx.suffix_array(sx._packed(w), 30)

    def suffix(i):
        out = []
        while i < len(w) and w[i] and len(out) < 30:
            out.append(int(w[i] >> np.uint64(17)) % 65535)
            i += 1
        return out

    got = [suffix(i) for i in sa]
    assert sorted(sa) == list(range(500)) and got == sorted(got)


def test_empty(spark, no_docs, odd_docs, bench_items):
    assert sx.matches(spark, no_docs, bench_items).count() == sx.matches(spark, odd_docs, bench_items.limit(0)).count() == 0
    assert sx.decontaminate(spark, no_docs, bench_items).count() == 0
    assert sx.decontaminate(spark, odd_docs, bench_items.limit(0)).count() == odd_docs.count()


def test_items_that_begin_alike_are_not_held_all_at_once():
    head = "choose the best answer from the options given below"
    tests = sx.prepare([(i, f"{head} q{i} and r{i}") for i in range(200)])
    texts = pa.array([f"d{i} {head} x{i} " * 20 for i in range(1500)])
    for own, pairs in ((tests, 1500 * 200), (getattr(sx, "distinct", lambda t: t)(tests), 1500)):
        n = 0
        tracemalloc.start()
        for part in sx.shard_matches(texts, own):
            n += len(part[0])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == pairs and peak < 150e6


def test_some_at_a_time_and_distinct(rng, monkeypatch):
    """The same best matches however few are held; the same documents by one suffix of those that begin alike."""
    items = [(i, words(rng, rng.randint(3, 14), 3)) for i in range(40)]
    items += [(i, " ".join(["a"] * rng.randint(4, 12))) for i in range(40, 44)]
    texts = [words(rng, rng.randint(0, 30), 3) for _ in range(60)] + [" ".join(["a"] * n) for n in (4, 5, 7, 8, 30)]
    for places in (1, 7, 1 << 20):
        monkeypatch.setattr(sx, "PLACES", places)
        for least, short in ((8, 5), (5, 5), (11, 4)):
            want = brute(list(enumerate(texts)), items, least, short)
            tests = sx.prepare(items, least, short)
            best = {}
            for part in sx.shard_matches(pa.array(texts), tests):
                for row, item, n, at, pos in zip(*(x.tolist() for x in part)):
                    best[row, item] = min(best.get((row, item), (0, 0, 0)), (-n, at, pos))
            assert {k: (-n, at, pos) for k, (n, at, pos) in best.items()} == want
            few = sx.distinct(tests)
            rows = {r for part in sx.shard_matches(pa.array(texts), few) for r in part[0].tolist()}
            assert rows == {k[0] for k in want} and len(few.at) <= len(tests.at)
