"""Public tokenizer vocabularies over whole Arrow batches, exact to the libraries' own results.

A byte-level BPE never merges across the pieces that its pattern cuts, and the sentence-piece model
is applied word by word. So texts are cut and hashed in bulk, and each distinct piece is encoded once
while it stays in a worker's cache.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from .words import Words, hash_spans, pieces

#: Where the vocabulary files are; every operator that reads one takes the folder as a parameter.
TOKENIZERS = os.environ.get("GATELIGHT_TOKENIZERS", "/opt/tokenizers")
#: Slots of a worker's cache, and ids that it holds before it starts anew. Results don't depend on them.
SLOTS, POOL = 1 << 21, 1 << 24

_LETTER, _DIGIT, _BLANK, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[128:192] = _LETTER  # what may follow 0xC3, but for the two below
_CLASS[0xC3] = _LETTER
_loaded: dict[tuple, object] = {}


def folder(path: str | None = None) -> str:
    path = path or TOKENIZERS
    if not os.path.isdir(path) and (spec := importlib.util.find_spec("public_tokenizers")) and spec.origin:
        path = os.path.dirname(spec.origin)
    return path


class Cache:
    """Direct-mapped: a piece's hash to its ids, which lie in one pool."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self.encode = encode
        self.keys, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def ids(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of ids of each."""
        n = len(h)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.used > POOL:
            self.keys[:] = 0
            self.used = 0
        order = np.argsort(h)
        ranked = h[order]
        new = np.empty(n, bool)
        new[0], new[1:] = True, ranked[1:] != ranked[:-1]
        uniq, rep = ranked[new], order[new]
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(new) - 1
        slot = (uniq & np.uint64(SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != uniq)
        if len(miss):
            raw = data.tobytes()
            coded = self.encode([raw[a:b] for a, b in zip(starts[rep[miss]].tolist(), ends[rep[miss]].tolist())])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            total = int(sizes.sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, total), np.int32)])
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(coded), np.int32, total)
            at[miss], size[miss] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += total
            self.keys[slot[miss]], self.at[slot[miss]], self.size[slot[miss]] = uniq[miss], at[miss], size[miss]
        size = size[group].astype(np.int64)
        out = np.cumsum(size)
        pos = np.arange(out[-1]) + np.repeat(at[group] - (out - size), size)
        return self.pool[pos], size


class ByteBPE:
    """byte_bpe_50k and its like: ids equal tiktoken's ``encode_ordinary``.

    Texts of ASCII and Latin-1 letters are cut in bulk; a text with any other character goes to the
    library whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = max(ranks.values()) + 1
        self.exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        single = self.exact._core_bpe.encode_single_piece
        self.cache = Cache(lambda cut: [single(x) for x in cut])

    @staticmethod
    def plain(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which documents can be cut in bulk."""
        kind = _CLASS[data]
        odd = kind == _ODD
        high = data >= 128
        if high.any():
            lead = data == 0xC3
            tail = high & ~lead & (data < 0xC0)
            after = np.zeros(len(data), bool)
            after[1:] = lead[:-1]
            odd |= (tail & ~after) | (high & (data >= 0xC0) & ~lead) | (after & ((data == 0x97) | (data == 0xB7)))
        bad = np.concatenate([[0], np.cumsum(odd)])
        return bad[offs[1:]] == bad[offs[:-1]]

    @staticmethod
    def cut(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where the pieces of plain documents begin; the pieces cover all bytes."""
        n = len(data)
        kind = _CLASS[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        run = np.empty(n, bool)
        run[0], run[1:] = True, kind[1:] != kind[:-1]
        run |= edge[:-1]
        run_at = np.flatnonzero(run)
        run_end = np.append(run_at[1:], n)
        start = np.zeros(n + 1, bool)
        blank = kind[run_at] == _BLANK
        a, b = run_at[blank], run_end[blank]
        last = edge[b]
        space = data[b - 1] == 32
        start[a[last]] = True  # the blanks that end a document
        longer = ~last & (b - 1 > a)
        start[a[longer]] = True
        start[b[~last] - 1] = True  # the last blank: a space goes with the next run, another stands alone
        p = run_at[~blank]
        own = edge[p]
        before = np.where(p > 0, data[p - 1], 0)
        start[p[own | (before != 32)]] = True
        # contractions: a lone apostrophe that no space precedes
        e = run_end[~blank]
        q = p[(data[p] == 39) & (e - p == 1) & (own | (before != 32))]
        q = q[(q + 1 < n) & ~edge[q + 1]]
        if len(q):
            one = data[q + 1]
            two = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], data[np.minimum(q + 2, n - 1)], 0)
            short = np.isin(one, list(b"stmd"))
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hit, size in ((q[short], 2), (q[long], 3)):
                start[hit + 1] = False
                stop = hit + size
                inside = stop[~edge[stop]]
                start[inside[kind[inside] != _BLANK]] = True
        del space
        return np.flatnonzero(start[:n])

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and each text's number of ids."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(offs) - 1, np.int64)
        for lo, hi in pieces(offs):
            own, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            if not len(own):
                continue
            plain = self.plain(own, at)
            if plain.all():
                ids, size = self._bulk(own, at)
                counts[lo:hi] = size
                parts.append(ids)
                continue
            keep = np.repeat(plain, np.diff(at))
            short = np.concatenate([[0], np.cumsum(np.where(plain, np.diff(at), 0))])
            ids, size = self._bulk(own[keep], short) if keep.any() else (np.zeros(0, np.int32), np.zeros(hi - lo, np.int64))
            cut = np.concatenate([[0], np.cumsum(size)])
            for i in range(hi - lo):
                if plain[i]:
                    one = ids[cut[i] : cut[i + 1]]
                else:
                    one = np.array(self.exact.encode_ordinary(own[at[i] : at[i + 1]].tobytes().decode()), np.int32)
                counts[lo + i] = len(one)
                parts.append(one)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def _bulk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.cut(data, offs)
        ends = np.append(starts[1:], len(data))
        ids, size = self.cache.ids(hash_spans(data, starts, ends), data, starts, ends)
        total = np.concatenate([[0], np.cumsum(size)])
        cut = np.searchsorted(starts, offs)
        return ids, total[cut[1:]] - total[cut[:-1]]


class WordPieces:
    """piece_bpe_32k applied to each white-space separated word; knows which ids are byte fallbacks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.vocab)])
        self.cache = Cache(lambda cut: self.model.encode([x.decode() for x in cut], num_threads=1))

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all texts in order, and each text's number of ids."""
        w = Words(data, offs)
        ids, size = self.cache.ids(w.hashes(), data, w.starts, w.ends)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[w.first[1:]] - total[w.first[:-1]]


def byte_bpe(path: str | None = None, name: str = "byte_bpe_50k") -> ByteBPE:
    if (key := ("byte", path, name)) not in _loaded:
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _loaded[key] = ByteBPE(os.path.join(folder(path), f"{name}.tiktoken"), pattern)
    return _loaded[key]


def word_pieces(path: str | None = None, name: str = "piece_bpe_32k") -> WordPieces:
    if (key := ("piece", path, name)) not in _loaded:
        _loaded[key] = WordPieces(os.path.join(folder(path), f"{name}.model"))
    return _loaded[key]
