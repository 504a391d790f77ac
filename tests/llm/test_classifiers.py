import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.llm import linear, ordinal, toxicity

from .conftest import words


@pytest.fixture(scope="module")
def rated(spark):
    import random

    rng = random.Random(7)
    rows = []
    for i in range(900):
        grade = i % 3
        toxic = int(rng.random() < 0.25)
        text = words(rng, rng.randint(20, 60)).split()
        text += [["bad", "poor", "junk"], ["fair", "plain", "mid"], ["fine", "great", "rich"]][grade][:2] * 2
        if toxic:
            text += rng.sample(["moron", "scum", "trash", "idiot"], 2)
        rng.shuffle(text)
        rows.append((i, " ".join(text), grade, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int, toxic int")


def halves(df):
    return df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")


def test_chain_on_held_out_rows(spark, rated):
    train, test = halves(rated)
    got = toxicity.scored(spark, test.select("doc_id", "text").union(train.select("doc_id", "text")), train.select("doc_id", "toxic")).join(test.select("doc_id", "toxic"), "doc_id").toPandas()
    assert ((got.p_toxic >= 0.5) == (got.toxic == 1)).mean() > 0.97
    assert list(got.columns)[1:4] == ["p_kind_1", "p_kind_2", "p_toxic"]
    assert (got.is_toxic == (got.p_toxic >= toxicity.CUT)).all()


def test_chain_feeds_earlier_odds():
    rng = np.random.default_rng(1)
    n = 400
    first = rng.random(n) < 0.4
    feats = [np.array([5 if f else 9]) for f in first]
    chain = toxicity.fit_rows(feats, {"a": first.astype(float), "b": first.astype(float)}, "b")
    assert chain.feed[0].shape == (0,) and chain.feed[1].shape == (1,) and chain.feed[1][0] > 0


def plain_logistic(rows, extra, y, l2=0.3, steps=100):
    """Adam with one weight at a time, rows as sets."""
    names = sorted({f for r in rows for f in r})
    k = len(extra[0]) if extra else 0
    keys = [*names, *[("e", j) for j in range(k)], "bias"]
    rate = min(max(sum(y) / len(y), 1e-4), 1 - 1e-4)
    w = {key: 0.0 for key in keys} | {"bias": math.log(rate / (1 - rate))}
    m, v = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    for t in range(1, steps + 1):
        g = dict.fromkeys(keys, 0.0)
        for r, e, target in zip(rows, extra, y):
            z = w["bias"] + sum(w[f] for f in r) + sum(w["e", j] * e[j] for j in range(k))
            d = 1 / (1 + math.exp(-min(30, max(-30, z)))) - target
            for f in r:
                g[f] += d
            for j in range(k):
                g["e", j] += d * e[j]
            g["bias"] += d
        for key in keys:
            own = g[key] + (l2 * w[key] if key != "bias" else 0)
            m[key] += 0.1 * (own - m[key])
            v[key] += 0.02 * (own * own - v[key])
            w[key] -= 0.5 * (m[key] / (1 - 0.9**t)) / (math.sqrt(v[key] / (1 - 0.98**t)) + 1e-8) * (1 - 0.9 * t / steps)
            if key in names:
                w[key] = max(0.0, w[key])
    return w


def plain_odds(w, r, e):
    return min(30, max(-30, w["bias"] + sum(w.get(f, 0.0) for f in r) + sum(w["e", j] * e[j] for j in range(len(e)))))


def test_chain_equals_plain_python():
    """Three categories, each row's earlier log-odds from models that didn't see it."""
    rng = np.random.default_rng(6)
    n = 200
    y = {"a": rng.random(n) < 0.4, "b": rng.random(n) < 0.4}
    y["c"] = y["a"] | y["b"]
    rows = [{x for x in (1 if y["a"][i] and rng.random() < 0.8 else 0, 2 if y["b"][i] and rng.random() < 0.8 else 0, int(rng.integers(3, 6))) if x} for i in range(n)]
    target = {c: v.astype(float) for c, v in y.items()}
    chain = toxicity.fit_rows([np.array(sorted(r)) for r in rows], target, "c")
    chosen = set(np.flatnonzero(chain.slot < len(chain.weights) - 1).tolist())
    own = [r & chosen for r in rows]
    assert {1, 2} <= chosen
    earlier = [[] for _ in range(n)]
    for k, c in enumerate("abc"):
        w = plain_logistic(own, earlier, list(target[c]))
        assert all(abs(w[f] - chain.weights[chain.slot[f], k]) < 1e-6 for f in chosen if f in w) and abs(w["bias"] - chain.bias[k]) < 1e-6
        assert all(abs(w["e", j] - chain.feed[k][j]) < 1e-6 for j in range(k))
        odds = [0.0] * n
        for fold in range(toxicity.FOLDS):
            seen = [i for i in range(n) if i % toxicity.FOLDS != fold]
            model = plain_logistic([own[i] for i in seen], [earlier[i] for i in seen], [target[c][i] for i in seen])
            for i in range(fold, n, toxicity.FOLDS):
                odds[i] = plain_odds(model, own[i], earlier[i])
        earlier = [[*e, o] for e, o in zip(earlier, odds)]


def test_scores_equal_plain_python(spark):
    """What a document gets, from its words and heads, one by one."""
    rows = [(i, f"{'vile rubbish' if i % 3 == 0 else 'fair words'} in row {i % 7}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    chain = toxicity.fit(spark, docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(spark, docs, labels).collect()}
    for i, text in rows[:20]:
        import pyarrow as pa

        doc, col = linear.presence(*linear.buffers(pa.array([text])))
        odds = []
        for k in range(3):
            odds.append(min(30, max(-30, sum(chain.weights[chain.slot[f], k] for f in set(col.tolist())) + sum(a * b for a, b in zip(odds, chain.feed[k])) + chain.bias[k])))
        assert [got[i].p_kind_1, got[i].p_kind_2, got[i].p_toxic] == pytest.approx([1 / (1 + math.exp(-z)) for z in odds], abs=2e-6)
        assert got[i].is_toxic == (i % 3 == 0)


def test_labels_of_any_schema(spark, odd_docs, labels):
    """Other categories are links; no toxic column, other cases, odd values and clashing names do no harm."""
    for given in (labels.select("doc_id"), labels.drop("toxic"), labels.selectExpr("doc_id", "'x' AS toxic"), labels.selectExpr("doc_id", "double('NaN') AS toxic")):
        got = toxicity.scored(spark, odd_docs, given)
        assert got.count() == odd_docs.count() and got.where("p_toxic > 0 or is_toxic").isEmpty()
        assert toxicity.reject(spark, odd_docs, given).count() == odd_docs.count()
    upper = labels.selectExpr("doc_id", "toxic AS Toxic", "quality AS INSULT", "1 AS h", "2 AS id", "3 AS y_toxic")
    assert toxicity.scored(spark, odd_docs, upper).columns == ["doc_id", "p_insult", "p_toxic", "is_toxic"]
    assert ordinal.scored(spark, odd_docs, labels.select("doc_id")).where("expected_grade != 0").isEmpty()


def test_labels_without_a_document_take_no_place(spark):
    docs = spark.range(300).selectExpr("id * 1000 AS doc_id", "concat('word', id % 50) AS text")
    many = spark.range(300_000).selectExpr("id AS doc_id", "CAST(id % 3000 = 0 AS INT) AS toxic")
    table = linear.sample(docs, many, [F.col("toxic")], ["toxic"], 200, linear.presence)
    got = table.collect()
    want = sorted((r.h, r.doc_id) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect())[:200]
    assert sorted((r.h, r.id) for r in got) == want
    assert all(r.y_toxic == (r.id % 3000 == 0) for r in got)


def test_kinds_part_the_toxic_rows():
    rng = np.random.default_rng(3)
    feats = [np.sort(rng.choice(10, 4, replace=False) + (20 if i % 4 == 0 else 40 if i % 4 == 1 else 60)) for i in range(80)]
    row, col = np.repeat(np.arange(80), 4), np.concatenate(feats)
    kind = toxicity.kinds(linear.Sparse(row, col, 80, 100), np.arange(80) % 4 < 2, 2)
    assert (kind[2::4] == -1).all() and len(set(kind[0::4])) == len(set(kind[1::4])) == 1 and kind[0] != kind[1]


def test_chain_edges(spark, odd_docs, no_docs, labels):
    for given in (labels, labels.limit(0), labels.where("toxic = 1"), labels.drop("quality")):
        got = toxicity.scored(spark, odd_docs, given)
        assert got.count() == odd_docs.count()
        kept = toxicity.reject(spark, odd_docs, given)
        assert kept.columns == odd_docs.columns
    assert toxicity.scored(spark, odd_docs, labels.limit(0)).where("is_toxic or p_toxic > 0.001").isEmpty()
    assert toxicity.reject(spark, odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert toxicity.scored(spark, no_docs, labels).count() == toxicity.reject(spark, no_docs, labels).count() == 0


def test_ordinal_on_held_out_rows(spark, rated):
    train, test = halves(rated)
    got = ordinal.scored(spark, rated.select("doc_id", "text"), train.select("doc_id", "grade"), tail=2).join(test.select("doc_id", "grade"), "doc_id").toPandas()
    assert (got.expected_grade.round() == got.grade).mean() > 0.9
    assert ((got.tail_probability >= 0.5) == (got.grade == 2)).mean() > 0.93
    assert got.expected_grade.between(0, 2).all()


def test_thresholds_are_ordered(spark, rated):
    model = ordinal.fit(spark, rated, rated.select("doc_id", "grade"))
    assert model.grades == [0, 1, 2] and (np.diff(model.cuts) > 0).all()


def test_fit_equals_plain_python():
    """The same steps with one number at a time, and what documents get from the fit."""
    rng = np.random.default_rng(8)
    n = 60
    docs = [sorted(set(rng.integers(0, 9, rng.integers(1, 5)).tolist())) for _ in range(n)]
    y = np.array([min(2, sum(f in (1, 2) for f in d)) * 0.25 + 0.5 for d in docs])  # fractions
    model = ordinal.fit_rows(np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate(docs), y, steps=40)
    assert model.grades == [0.5, 0.75, 1.0]
    share = [float((y >= g).mean()) for g in model.grades[1:]]
    at = [-math.log(s / (1 - s)) for s in share]
    theta = {f: 0.0 for d in docs for f in d} | {"cut": at[0], "step": math.log(max(at[1] - at[0], 1e-3))}
    m, v = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    sig = lambda z: 1 / (1 + math.exp(-z))
    for t in range(1, 41):
        g = {k: 0.05 * w if isinstance(k, int) else 0.0 for k, w in theta.items()}
        cuts = [theta["cut"], theta["cut"] + math.exp(theta["step"])]
        for d, target in zip(docs, y):
            z = sum(theta[f] for f in d) / math.sqrt(len(d))
            p = [1.0, sig(z - cuts[0]), sig(z - cuts[1]), 0.0]
            r = model.grades.index(target)
            own = max(p[r] - p[r + 1], 1e-12)
            slope = [q * (1 - q) for q in p]
            for f in d:
                g[f] += -(slope[r] - slope[r + 1]) / own / math.sqrt(len(d))
            for j in (1, 2):
                part = (slope[j] if r == j else 0) / own - (slope[j] if r + 1 == j else 0) / own
                g["cut"] += part
                if j == 2:
                    g["step"] += part * math.exp(theta["step"])
        for key in theta:
            m[key] += 0.1 * (g[key] - m[key])
            v[key] += 0.02 * (g[key] ** 2 - v[key])
            theta[key] -= 0.3 * (m[key] / (1 - 0.9**t)) / (math.sqrt(v[key] / (1 - 0.98**t)) + 1e-8) * (1 - 0.95 * t / 40)
    assert model.cuts == pytest.approx([theta["cut"], theta["cut"] + math.exp(theta["step"])], abs=1e-6)
    assert all(model.weights[f] == pytest.approx(theta[f], abs=1e-6) for f in theta if isinstance(f, int))


def test_scored_equals_plain_python(spark):
    """Features by hand: words, first four and last three bytes, from the fitted weights."""
    from gatelight.llm.words import Words, buffers, hash_spans

    rows = [(i, f"{['poor', 'middling', 'excellent'][i % 3]} text of row number {i % 11}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 / 2) for i in range(90)], "doc_id long, grade double")
    model = ordinal.fit(spark, docs, labels)
    got = {r.doc_id: r for r in ordinal.scored(spark, docs, labels).collect()}
    one = lambda b: hash_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
    for i, text in rows[:12]:
        seen = set()
        for w in text.encode().split():
            for k, part in enumerate((w, w[:4], w[-3:])):
                if k == 0 or len(w) > 3:
                    seen.add(int((one(part) * np.uint64(0x9E3779B97F4A7C15 + 2 * k))[0] >> np.uint64(64 - ordinal.BITS)))
        z = sum(model.weights[f] for f in seen) / math.sqrt(len(seen))
        p = [1 / (1 + math.exp(-(z - c))) for c in model.cuts]
        assert got[i].expected_grade == pytest.approx(0.5 * sum(p), abs=2e-6) and got[i].tail_probability == pytest.approx(p[1], abs=2e-6)
        assert abs(got[i].expected_grade - i % 3 / 2) < 0.25


def test_gradient():
    """The fit ends near a point where no small move lowers the loss."""
    rng = np.random.default_rng(4)
    n = 300
    row, col = np.repeat(np.arange(n), 2), rng.integers(0, 4, 2 * n)
    key = np.unique(row * 10 + col)
    row, col = key // 10, key % 10
    score = np.bincount(row, np.array([2.0, -2, 0.5, 0])[col], n) + rng.logistic(size=n)
    y = np.searchsorted([-1, 1], score)
    model = ordinal.fit_rows(row, col, y, steps=600)

    def loss(w, cuts):
        x = np.bincount(row, w[col] / np.sqrt(np.bincount(row, minlength=n))[row], n)
        p = np.column_stack([np.ones(n), 1 / (1 + np.exp(cuts[None] - x[:, None])), np.zeros(n)])
        return -np.log(p[np.arange(n), y] - p[np.arange(n), y + 1]).sum() + 0.025 * (w**2).sum()

    w = model.weights[:4]
    base = loss(w, model.cuts)
    for k in range(4):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, model.cuts) > base - 0.02


def test_ordinal_edges(spark, odd_docs, no_docs, labels):
    for given in (labels, labels.limit(0), labels.where("quality = 1"), labels.drop("toxic")):
        got = ordinal.scored(spark, odd_docs, given)
        assert got.count() == odd_docs.count() and got.where("expected_grade is null or selected is null").isEmpty()
    none = ordinal.scored(spark, odd_docs, labels.limit(0)).first()
    assert none.expected_grade == 0 and none.tail_probability == 0 and not none.selected
    assert ordinal.scored(spark, no_docs, labels).count() == 0
    grades = {r.doc_id: r.grade for r in ordinal.graded(labels.where("doc_id in (1, 2, 77)")).collect()}
    assert grades == {1: 2.0, 2: 0.0, 77: 1.0}
    assert ordinal.graded(labels.withColumn("grade", F.lit(4))).first().grade == 4
