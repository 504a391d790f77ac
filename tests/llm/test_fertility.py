import math
from collections import Counter

import numpy as np
import pytest
import regex

from gatelight.llm import fertility as fe
from gatelight.llm.tokens import word_pieces

from .conftest import words
from .test_tokens import REAL


def measures(text):
    ids = REAL.encode_ordinary(text or "")
    if not ids:
        return 0, None, None, None
    model = word_pieces().model
    cut = [i for w in text.split() for i in model.encode(w)] if text else []
    counts = Counter(ids)
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    return len(ids), len(text) / len(ids), sum(map(model.is_byte, cut)) / max(1, len(cut)), bits / math.log2(len(ids)) if len(ids) > 1 else 1.0


def quartile(values, q):
    ranked = sorted(round(v * 256) for v in values)
    return ranked[max(0, math.ceil(q * len(ranked)) - 1)] / 256


def test_equals_brute_force(spark, odd_docs, rng):
    rows = [(100 + i, words(rng, rng.randint(30, 200)), rng.choice(["en", "fr", None])) for i in range(220)]
    rows += [(500, "🎉🎊🎈" * 60, "en"), (501, "aaaa " * 200, "fr"), (502, "текст на другом языке " * 20, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = {str((r.doc_id, r.n_tokens)): r for r in fe.fertility(spark, docs).collect()}
    table = docs.select("doc_id", "text", "lang").collect()
    found = [(r.doc_id, r.lang, *measures(r.text)) for r in table]
    groups = {}
    for r, m in zip(table, found):
        band = got[str((r.doc_id, m[2]))].band
        assert r.lang is None or band == r.lang
        size = int(math.log2(max(1, m[2])) / 2 + 1e-9)
        if m[2] >= fe.LEAST_TOKENS:
            groups.setdefault((band, size), []).append(m[3:])
            groups.setdefault((None, size), []).append(m[3:])
    for m in found:
        r = got[str((m[0], m[2]))]
        for name, x in zip(fe.METRICS, m[3:]):
            assert (r[name] is None) == (x is None) and (x is None or abs(r[name] - x) < 1e-5)
        size = int(math.log2(max(1, m[2])) / 2 + 1e-9)
        own = groups.get((r.band, size), [])
        own = own if len(own) >= fe.LEAST_DOCS else groups.get((None, size), [])
        out = False
        if m[2] >= fe.LEAST_TOKENS and len(own) >= fe.LEAST_DOCS:
            for k, floor in enumerate(fe.METRICS.values()):
                a, b = (quartile([v[k] for v in own], q) for q in (0.25, 0.75))
                wide = max(fe.REACH * (b - a), floor)
                out = out or not a - wide <= round(m[3 + k], 6) <= b + wide
        assert r.rejected == out
    assert got[str((501, found[[m[0] for m in found].index(501)][2]))].rejected


def test_sparse_lengths_are_judged(spark, rng):
    rows = [(i, words(rng, rng.randint(40, 100)), "en") for i in range(80)]
    rows += [(100, words(rng, 9000), "en"), (101, "a" * 90000, "en"), (102, "🎉🎊🎈" * 9000, "fr"), (103, words(rng, 18), None)]  # alone in their size classes
    got = {r.doc_id: r.rejected for r in fe.fertility(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), borrow=True).collect()}
    assert {i for i, x in got.items() if x} == {101, 102}
    few = spark.createDataFrame([*rows[:9], *rows[81:83]], "doc_id long, text string, lang string")  # fewer than any band asks for
    assert {r.doc_id for r in fe.fertility(spark, few, borrow=True).where("rejected").collect()} == {101, 102}


def test_empty_and_script(spark, no_docs, odd_docs):
    assert fe.fertility(spark, no_docs).count() == 0
    got = {r.doc_id: r.band for r in fe.fertility(spark, odd_docs.drop("lang")).collect()}
    assert got[4] == "script:none" and got[1] == "script:latin"


TEXTS = {
    "latin": "Việt ngữ có những chữ riêng ấ ờ ỡ", "greek": "Ελληνικά και ἀρχαῖος λόγος", "cyrillic": "русский текст і українська", "armenian": "հայերեն տեքստ", "hebrew": "טקסט בעברית", "arabic": "نص عربي",
    "devanagari": "हिन्दी पाठ", "tamil": "தமிழ் உரை", "thai": "ข้อความไทย", "georgian": "ქართული ტექსტი", "ethiopic": "አማርኛ ጽሑፍ", "myanmar": "မြန်မာစာ", "hangul": "한국어 문장", "kana": "ひらがなとカタカナ", "han": "中文文本漢字𠀀", "yi": "ꆈꌠꉙ", "none": "123 … 🎉 €",
}


@pytest.mark.parametrize("name", TEXTS)
def test_script_of_a_text(name):
    raw = TEXTS[name].encode()
    script = fe.measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
    assert fe.SCRIPTS[script[0]] == name


def test_scripts_by_the_unicode_tables():
    """Every letter's script is that of the regex library's tables, for the scripts that are told apart."""
    names = {"canadian": "Canadian_Aboriginal", "kana": "Hiragana"}
    tests = {s: regex.compile(rf"[\p{{Script={names.get(s, s)}}}{'\\p{Script=Katakana}' if s == 'kana' else ''}]") for s in fe.SCRIPTS[1:]}
    letter = regex.compile(r"[\p{Ll}\p{Lu}\p{Lo}]")
    codes = [c for c in [*range(0x3100), *range(0xA000, 0xD7FF, 3), *range(0x4E00, 0xA000, 97), *range(0x20000, 0x20100)] if not 0xD800 <= c < 0xE000 and letter.match(chr(c))]
    raw = "".join(map(chr, codes)).encode()
    data = np.frombuffer(raw, np.uint8)
    got = fe.scripts(data, (data & 0xC0) != 0x80)
    wrong = [(hex(c), fe.SCRIPTS[k]) for c, k in zip(codes, got.tolist()) if (k and not tests[fe.SCRIPTS[k]].match(chr(c))) or (not k and any(t.match(chr(c)) for t in tests.values()))]
    assert len(wrong) <= 0.004 * len(codes), wrong[:40]


def test_bands_by_a_shuffle(spark, rng):
    rows = [(i, words(rng, rng.randint(40, 100)), f"l{i % 3}") for i in range(180)] + [(999, "aaaa " * 150, "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = [sorted(map(str, fe.fertility(spark, docs, borrow=True, broadcast_rows=n).collect())) for n in (fe.BROADCAST_ROWS, 0)]
    assert both[0] == both[1]
