"""Chat formatting with typed content parts.

A conversation's messages, in order of their turns, become one text. A visitor walks each message's
parts: text stays, and an image, audio or document part becomes a placeholder (``<|image_1|>``), counted
over the conversation in order. Each placeholder has an attachment: its number, kind, reference, turn,
and how many tokens it expands to. Text is counted with the byte-level BPE vocabulary.

A message's text holds parts in one of two ways:

* A JSON list of objects with a ``type`` of text, image, audio or document (``text``; ``url``; and
  ``width`` and ``height``, ``seconds``, or ``pages``). An object of another type or without what it
  needs stays in the text as JSON. Text that isn't such a list, broken JSON included, is Markdown.
* Markdown: ``![..](ref)`` is an image, ``[..](ref)`` an audio or document part by ref's extension, and
  everything else, other links included, is text.

Expanded tokens: an image has ``base`` and ``tile`` for each tile of 512 pixels (one tile if its size
isn't known), audio ``rate`` a second (30 s if not known), a document ``page`` a page (one if not known).

* A null text is an empty message; a null role is ``user``. Roles are taken as they are.
* Turns in order, null turns last; ties by role, then text. Repeated rows are repeated messages.
* Rows with a null conv_id make one conversation. An empty table gives none. Other columns are not read.
* Placeholder-like strings in text are broken with a space (``<| image_1|>``), so none is counterfeit.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import field
from .tokens import byte_bpe
from .words import buffers

BASE, TILE, RATE, PAGE = 85, 170, 25, 600
AUDIO, DOCUMENT = ("mp3", "wav", "flac", "ogg", "m4a", "opus"), ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "epub", "txt", "csv")
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(([^()\s]+)\)")
_CONTROL = re.compile(r"<\|")


class Visitor:
    """Flattens the parts of one conversation."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.turn: int | None = None

    def message(self, role: str | None, turn: int | None, text: str | None) -> None:
        self.turn = turn
        self.out.append(f"<|{_CONTROL.sub('<| ', role if role is not None else 'user')}|>\n")
        for part in parts(text or ""):
            getattr(self, f"visit_{part['type']}")(part)
        self.out.append("<|end|>\n")

    def visit_text(self, part: dict) -> None:
        self.out.append(_CONTROL.sub("<| ", part["text"]))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        no = len(self.attachments) + 1
        self.attachments.append({"no": no, "kind": kind, "ref": part["url"], "turn": self.turn, "tokens": tokens})
        self.out.append(f"<|{kind}_{no}|>")

    def visit_image(self, part: dict) -> None:
        wide, high = part.get("width"), part.get("height")
        tiles = math.ceil(wide / 512) * math.ceil(high / 512) if _size(wide) and _size(high) else 1
        self.attach("image", part, BASE + TILE * tiles)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self.attach("audio", part, math.ceil((seconds if _size(seconds) else 30) * RATE))

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        self.attach("document", part, math.ceil((pages if _size(pages) else 1)) * PAGE)


def _size(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and 0 < x < 1e9


def _typed(x: object) -> dict:
    if isinstance(x, dict):
        if x.get("type") == "text" and isinstance(x.get("text"), str):
            return {"type": "text", "text": x["text"]}
        if x.get("type") in ("image", "audio", "document") and isinstance(x.get("url"), str) and x["url"]:
            return x
    return {"type": "text", "text": json.dumps(x, ensure_ascii=False)}


def parts(text: str) -> list[dict]:
    """The typed parts of a message in order."""
    bare = text.strip()
    if bare.startswith("[") and bare.endswith("]") and "{" in bare:
        try:
            found = json.loads(bare)
        except (ValueError, RecursionError):
            found = None
        if found and all(isinstance(x, dict) and "type" in x for x in found):
            return [_typed(x) for x in found]
    out, at = [], 0
    if "](" in text:
        for m in _LINK.finditer(text):
            bang, _, ref = m.groups()
            end = re.split(r"[?#]", ref)[0].rpartition(".")[2].lower()
            kind = "image" if bang else "audio" if end in AUDIO else "document" if end in DOCUMENT else None
            if kind:
                out += [{"type": "text", "text": text[at : m.start()]}] if m.start() > at else []
                out.append({"type": kind, "url": ref})
                at = m.end()
    return out + ([{"type": "text", "text": text[at:]}] if at < len(text) else [])


def flatten(messages: list[dict]) -> tuple[str, list[dict]]:
    v = Visitor()
    for m in messages:
        v.message(m["role"], m["turn"], m["text"])
    return "".join(v.out), v.attachments


_KIND = "struct<text: string, attachments: array<struct<no: int, kind: string, ref: string, turn: bigint, tokens: bigint>>, text_tokens: bigint>"


def formatted(spark: SparkSession, conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, text, attachments, text_tokens, and n_tokens with the attachments expanded."""

    @F.arrow_udf(_KIND)
    def walk(chats: pa.Array) -> pa.Array:
        texts, found = [], []
        for chat in chats.to_pylist():
            text, attachments = flatten(chat)
            texts.append(text)
            found.append(attachments)
        text = pa.array(texts, pa.string())
        size = byte_bpe(path).batch(*buffers(text))[1] if len(texts) else np.zeros(0, np.int64)
        item = pa.struct([("no", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("tokens", pa.int64())])
        return pa.StructArray.from_arrays([text, pa.array(found, pa.list_(item)), pa.array(size, pa.int64())], ["text", "attachments", "text_tokens"])

    turn = field("turn").cast("bigint")
    one = F.struct(turn.isNull().alias("last"), turn.alias("turn"), field("role").cast("string").alias("role"), field("text").cast("string").alias("text"))
    chats = conversations.select(field("conv_id").alias("conv_id"), one.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    out = chats.select("conv_id", F.size("m").alias("n_turns"), walk("m").alias("c")).select("conv_id", "n_turns", "c.*")
    more = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"])
    return out.withColumn("n_tokens", F.col("text_tokens") + more)
