import random
from difflib import SequenceMatcher

import pytest

from gatelight.functions import matching
from gatelight.operators import duplicates

LETTERS = "abcdefghijklmnopqrstuvwxyzéß汉字的一是不了人我在有他这中大来上国"


def changed(rng, text, kinds):
    for _ in range(rng.randint(0, 10)):
        x = rng.randint(0, len(text))
        text = text[:x] + "".join(rng.choice(LETTERS[:kinds]) for _ in range(rng.randint(0, 20))) + text[x + rng.randint(0, 30) :]
    return text


def prose(rng, words):
    return " ".join(rng.choice(["the", "and", "ing", "tion", "on", "er", "her", "at", "re"]) + rng.choice(["", "ed", "in", "es", "ou", "st. Th", ", "]) for _ in range(words))


@pytest.mark.parametrize("arrays", [0, 50, 4_000_000])
def test_ratio_is_the_librarys(monkeypatch, arrays):
    """On either side of the length from which common characters count as junk; walked through, as arrays and as lists."""
    monkeypatch.setattr(matching, "ARRAYS", arrays)
    rng = random.Random(arrays)
    for k in range(100):
        kinds = rng.choice([2, 5, 30, len(LETTERS)])
        a = prose(rng, rng.randint(1, 150)) if k % 3 == 0 else "".join(rng.choice(LETTERS[:kinds]) for _ in range(rng.choice([1, 150, 199, 200, 260, 700])))
        b = changed(rng, a, kinds)
        want = SequenceMatcher(None, a, b).ratio() if b else None
        for threshold in (0.0, 0.8):
            assert matching.ratio_at_least(a, b, threshold) == (want if want is not None and want >= threshold else None)


def test_bound_loses_none_and_leaves_few():
    """Of texts of one vocabulary, few pairs but the similar ones are let through to the ratio."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(100, 200)) for _ in range(50)] + [prose(rng, rng.randint(1, 30)) for _ in range(10)]
    texts += [changed(rng, t, 26) for t in texts]
    held = matching.Texts(list(range(len(texts))), texts)
    let = {(int(i), j) for j, t in enumerate(texts) for i in held.possible(j, t, 0.8, before=True)}
    want = {(i, j): s for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a and b and (s := SequenceMatcher(None, a, b).ratio()) >= 0.8}
    assert want.keys() <= let and len(want) > 5
    unlike = [(i, j) for i, j in let - want.keys() if j - i != 60 and min(len(texts[i]), len(texts[j])) >= 400]
    assert len(unlike) < 50  # of 4,900 pairs of unlike long texts
    assert {(i, j): s for i, j, s in held.within(0.8)} == want


def test_pairs_over_many_chunks(spark, monkeypatch):
    """A site cut into many chunks, several held at a time, and sites that fit in one: every pair once, none of two sites."""
    monkeypatch.setattr(duplicates, "CHUNK", 3000)
    monkeypatch.setattr(duplicates, "ABREAST", 2)
    rng = random.Random(11)
    texts = [t for _ in range(16) for t in [prose(rng, rng.randint(5, 100))] for t in (t, changed(rng, t, 26), t)]
    rows = [("s" if i % 5 else f"t{i % 2}", i * 3 % 97, f"u{i}", t, len(t)) for i, t in enumerate(texts) if t]
    got = duplicates.similar_pairs(spark.createDataFrame(rows, "site string, seq long, url string, text string, n int")).collect()
    want = {(a[0], a[1], b[1]): s for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (s := SequenceMatcher(None, a[3], b[3]).ratio()) >= 0.8}
    assert len(got) == len(want) and {(r.site, r.i, r.j): r.sim for r in got} == want and len(want) > 5
