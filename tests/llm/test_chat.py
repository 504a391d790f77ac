import json
import math
import random

import pytest

from gatelight.llm import chat

from .test_tokens import REAL


def parts(text):
    return [(p["type"], p.get("text", p.get("url"))) for p in chat.parts(text)]


def test_markdown():
    assert parts("see ![a](x.png) and [b](c.MP3?v=1), [doc](d.pdf#2), [site](http://e/)") == [("text", "see "), ("image", "x.png"), ("text", " and "), ("audio", "c.MP3?v=1"), ("text", ", "), ("document", "d.pdf#2"), ("text", ", [site](http://e/)")]
    assert parts("plain") == [("text", "plain")] and parts("") == [] and parts("[1, 2]") == [("text", "[1, 2]")] and parts("[{broken}]") == [("text", "[{broken}]")]


def test_typed():
    typed = json.dumps([{"type": "text", "text": "hi <|image_1|>"}, {"type": "image", "url": "a", "width": 1025, "height": 10}, {"type": "audio", "url": "b", "seconds": 1.5}, {"type": "document", "url": "c", "pages": 3}, {"type": "video", "url": "v"}, {"type": "image"}])
    text, found = chat.flatten([{"role": None, "turn": 1, "text": typed}, {"role": "assistant", "turn": 2, "text": "![x](y)"}, {"role": "user", "turn": 3, "text": None}])
    assert text.startswith("<|user|>\nhi <| image_1|><|image_1|><|audio_2|><|document_3|>{")
    assert text.endswith("<|end|>\n<|assistant|>\n<|image_4|><|end|>\n<|user|>\n<|end|>\n")
    assert [(a["no"], a["kind"], a["ref"], a["turn"], a["tokens"]) for a in found] == [(1, "image", "a", 1, 85 + 3 * 170), (2, "audio", "b", 1, 38), (3, "document", "c", 1, 1800), (4, "image", "y", 2, 255)]


def test_table(spark, small):
    odd = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "![i](u.png) a"), (1, 2, "user", "b"), (1, None, "user", "last"), (None, 0, None, None), (None, 1, "user", ""), (2, 0, "user", "long " * 50_000)], "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS attachments", "1 AS m")
    for table in (odd, spark.read.parquet(f"{small}/conversations.parquet")):
        want = {}
        for r in sorted(table.collect(), key=lambda r: (r.turn is None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or "")):
            want.setdefault(r.conv_id, []).append({"role": r.role, "turn": r.turn, "text": r.text})
        got = chat.formatted(spark, table).collect()
        assert {r.conv_id for r in got} == set(want)
        for r in got:
            text, found = chat.flatten(want[r.conv_id])
            assert r.text == text and [a.asDict() for a in r.attachments] == found and r.n_turns == len(want[r.conv_id])
            assert r.text_tokens == len(REAL.encode_ordinary(text)) and r.n_tokens == r.text_tokens + sum(a["tokens"] for a in found)
    assert chat.formatted(spark, odd.limit(0)).count() == 0


AUDIO, DOCS = {"mp3", "wav", "flac", "ogg", "m4a", "opus"}, {"pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "epub", "txt", "csv"}


def plain_parts(text):
    """Parts by reading one character after the other, without the module's patterns."""
    try:
        found = json.loads(text) if text.strip().startswith("[") else None
    except ValueError:
        found = None
    if isinstance(found, list) and found and all(isinstance(x, dict) and "type" in x for x in found):
        for x in found:
            if x["type"] == "text" and isinstance(x.get("text"), str):
                yield "text", x["text"], {}
            elif x["type"] in ("image", "audio", "document") and x.get("url"):
                yield x["type"], x["url"], x
            else:
                yield "text", json.dumps(x, ensure_ascii=False), {}
        return
    held, i = "", 0
    while i < len(text):
        j = i + (text[i] == "!")
        close = text.find("](", j) if j < len(text) and text[j] == "[" else -1
        end = text.find(")", close) if close > 0 else -1
        label, ref = (text[j + 1 : close], text[close + 2 : end]) if end > 0 else ("[", "")
        if ref and not any(c in "[]" for c in label) and not any(c in "()" or c.isspace() for c in ref):
            name = ref.split("?")[0].split("#")[0]
            last = name.split(".")[-1].lower() if "." in name else name.lower()
            kind = "image" if text[i] == "!" else "audio" if last in AUDIO else "document" if last in DOCS else None
            if kind:
                if held:
                    yield "text", held, {}
                yield kind, ref, {}
                held, i = "", end + 1
                continue
        held += text[i]
        i += 1
    if held:
        yield "text", held, {}


def plain_chat(rows):
    out, found = "", []
    safe = lambda s: s.replace("<|", "<| ")
    for turn, role, text in rows:
        out += "<|" + safe("user" if role is None else role) + "|>\n"
        for kind, value, x in plain_parts(text or ""):
            if kind == "text":
                out += safe(value)
                continue
            if kind == "image":
                tokens = 85 + 170 * (math.ceil(x["width"] / 512) * math.ceil(x["height"] / 512) if x.get("width") and x.get("height") else 1)
            elif kind == "audio":
                tokens = math.ceil(25 * (x.get("seconds") or 30))
            else:
                tokens = 600 * math.ceil(x.get("pages") or 1)
            found.append((len(found) + 1, kind, value, turn, tokens))
            out += f"<|{kind}_{len(found)}|>"
        out += "<|end|>\n"
    return out, found


def made(rng):
    """A message of random parts: Markdown with links of all kinds, or typed parts, some of them odd."""
    if rng.random() < 0.4:
        kinds = [{"type": "text", "text": "said <|image_1|>"}, {"type": "image", "url": "a.png", "width": rng.randint(1, 3000), "height": rng.randint(1, 3000)}, {"type": "image", "url": "b"}, {"type": "audio", "url": "c.wav", "seconds": rng.randint(1, 99) / 4}, {"type": "document", "url": "d.pdf", "pages": rng.randint(1, 40)}, {"type": "video", "url": "e"}, {"type": "image"}]
        return json.dumps(rng.choices(kinds, k=rng.randint(1, 6)))
    bits = ["words ", "![alt](i.png)", "[clip](s.mp3)", "[paper](p.PDF?v=2)", "[site](https://e.org/x)", "!", "[", "](", ")", " (a) ", "![two words](a b)", "[n [m](x.pdf)", "<|end|>", "\n"]
    return "".join(rng.choices(bits, k=rng.randint(0, 9)))


@pytest.mark.parametrize("seed", range(3))
def test_chats_equal_plain_python(spark, seed):
    """Conversations with parts of every kind, against a reader that shares no code with the module."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), made(rng)) for c in range(40) for t in range(rng.randint(1, 5))]
    got = {r.conv_id: r for r in chat.formatted(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    kinds = set()
    for c in range(40):
        text, found = plain_chat([(t, role, x) for i, t, role, x in rows if i == c])
        assert got[c].text == text and [(a.no, a.kind, a.ref, a.turn, a.tokens) for a in got[c].attachments] == found
        size = len(REAL.encode_ordinary(text))
        assert (got[c].text_tokens, got[c].n_tokens) == (size, size + sum(f[4] for f in found))
        kinds |= {f[1] for f in found}
    assert kinds == {"image", "audio", "document"}
