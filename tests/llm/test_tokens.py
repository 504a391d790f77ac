import base64
import random

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gatelight.llm.tokens import byte_bpe, folder, word_pieces
from gatelight.llm.words import Words, buffers

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{folder()}/byte_bpe_50k.tiktoken", "rb"))}
REAL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks, special_tokens={})
_ALPHABET = st.text(alphabet=st.one_of(st.sampled_from(list("ab Zé×÷'\n\t.,!?19ßstmdrevl ")), st.characters(blacklist_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(_ALPHABET, max_size=6))
def test_ids_equal_the_library(texts):
    ids, size = byte_bpe().batch(*buffers(pa.array(texts, pa.string())))
    want = [REAL.encode_ordinary(t) for t in texts]
    assert size.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_pieces_equal_the_library():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["house", "élan", "日本", "x1", "🎉", "the"]) for _ in range(20)) for _ in range(10)] + ["", " "]
    model = word_pieces()
    ids, size = model.batch(*buffers(pa.array(texts)))
    want = [[i for w in t.split() for i in model.model.encode(w)] for t in texts]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert model.is_byte[np.array(model.model.encode("𓀀"))].any()


def test_words():
    texts = ["a bb  c", "", " x ", "é\nü", None]
    w = Words(*buffers(pa.array(texts)))
    assert w.count.tolist() == [3, 0, 1, 2, 0]
    h = w.hashes()
    again = Words(*buffers(pa.array(["c a"]))).hashes()
    assert h[2] == again[0] and h[0] == again[1] and len(set(h.tolist())) == 6
