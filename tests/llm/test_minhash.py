import pytest
from pyspark.sql import functions as F

from gatelight.llm import minhash as mh

from .conftest import words


def shingle_set(text, n=mh.N):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    import random

    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = words(rng, rng.randint(30, 120), 5000).split()
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(copy)))
    return odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def components(ids, edges):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_groups_against_brute_force(spark, docs):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id is not None and r.text and r.text.split():
            texts[r.doc_id] = min(r.text, texts.get(r.doc_id, r.text))
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    edges = {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= mh.LEAST}
    want = components(ids, edges)
    got = {r.id: r.group for r in mh.groups_of(spark, docs).collect()}
    found = [e for e in edges if got.get(e[0], e[0]) == got.get(e[1], e[1])]
    assert len(found) >= 0.97 * len(edges) and len(edges) > 50
    assert all(want[i] == want[g] for i, g in got.items())  # never joined without cause
    assert all(i in got for e in found for i in e)


def test_keep_one(spark, docs):
    out = mh.keep_one(spark, docs)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text").collect()
    kept = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(kept) == len(set(kept)) and 1 in kept and 2 not in kept
    assert sum(r.doc_id is None for r in rows) == 2 and {3, 4, 5, 6, 7} <= set(kept)
    report = {r.doc_id: r for r in mh.near_duplicates(spark, docs).collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None} - set(kept)
    assert gone == {i for i, r in report.items() if r.kept_id != i}
    assert report[2].kept_id == 1 and report[2].group_size == 2


def test_edited_copies(spark, rng):
    """Copies with five or six of 60 words replaced, of similarity 0.59 or 0.53."""
    rows = []
    for g in range(30):
        base = [f"b{g}x{k}" for k in range(60)]
        copy = [f"z{g}y{k}" if k % 9 == 4 and k // 9 < 5 + g % 2 else w for k, w in enumerate(base)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    kept = {r.doc_id for r in mh.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * g for g in range(30)} <= kept and len(kept) <= 30 + 4


def test_two_texts_of_an_id(spark):
    copied, alone = "these words stand in two of the documents here", "a text of its own that has no copy at all"
    rows = [(1, copied), (2, copied), (2, alone), (3, None), (3, "another text that is nowhere else to be found")]
    got = mh.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in got} == {rows[0], rows[2], rows[3], rows[4]}


def test_no_text_goes_without_a_kept_copy(spark):
    """Ids that share different, null and blank texts, and repeated rows, against a plain loop."""
    import random

    rng = random.Random(4)
    pool = [words(rng, 12, 5000) for _ in range(25)]
    pool += [" ".join(["other", *t.split()[1:]]) for t in pool[:12]]  # near copies of the first ones
    rows = [(rng.randrange(40), rng.choice(pool)) for _ in range(120)] + [(i, x) for i in range(6) for x in (None, "", " \n")] + [(None, pool[0]), (None, None)]
    got = [(r.doc_id, r.text) for r in mh.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    judged = sorted({(i, t) for i, t in rows if i is not None and t and t.split()})
    edges = [(a, b) for a in judged for b in judged if a < b and jaccard(shingle_set(a[1]), shingle_set(b[1])) >= mh.LEAST]
    want = components(judged, edges)
    kept = [x for x in got if x in want]
    assert len(kept) == len(set(kept)) == len({*want.values()})  # one row of one document of each group
    assert {want[x] for x in kept} == {*want.values()}
    assert min(x[0] for x in kept) == min(x[0] for x in judged) and all(x[0] == want[x][0] for x in kept)
    rest = lambda table: sorted(map(str, (x for x in table if x not in want)))
    assert rest(got) == rest(rows)
    report = {(r.doc_id, r.kept_id) for r in mh.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert report == {(x[0], want[x][0]) for x in judged if sum(g == want[x] for g in want.values()) > 1}


@pytest.mark.parametrize(("block", "limit"), [(2, mh.BROADCAST_BYTES), (256, -1)])
def test_blocks_and_shuffled_filters(spark, docs, block, limit):
    """Small blocks, and filters too large to broadcast, give the same groups."""
    want = {(r.id, r.group) for r in mh.groups_of(spark, docs).collect()}
    assert want and {(r.id, r.group) for r in mh.groups_of(spark, docs, block=block, broadcast_bytes=limit).collect()} == want


def test_blocks_find_every_pair():
    """All pairs of a block and between two blocks, by sets."""
    import random

    import pyarrow as pa

    rng = random.Random(6)
    sets = [sorted(rng.sample(range(30), rng.randint(3, 20))) for _ in range(40)]
    table = pa.table({"id": pa.array(range(40)), "label": pa.array([i // 2 for i in range(40)]), "s": pa.array(sets, pa.list_(pa.int32())), "side": pa.array([0] * 40)})
    alike = {(i, j) for i in range(40) for j in range(i + 1, 40) if i // 2 != j // 2 and jaccard(set(sets[i]), set(sets[j])) >= 0.4}
    got = mh._compare(table, 0.4).to_pylist()
    assert {(r["a"], r["b"]) for r in got} == alike and alike
    apart = table.set_column(3, "side", pa.array([i % 2 for i in range(40)]))
    assert {tuple(sorted((r["a"], r["b"]))) for r in mh._compare(apart, 0.4).to_pylist()} == {e for e in alike if e[0] % 2 != e[1] % 2}


def test_many_copies_and_empty(spark, no_docs):
    text = "one text that stands in a thousand documents word for word"
    many = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    assert [r.doc_id for r in mh.keep_one(spark, many).collect()] == [0]
    assert mh.keep_one(spark, no_docs).count() == mh.near_duplicates(spark, no_docs).count() == 0
