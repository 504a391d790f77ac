"""Which texts of two sets reach a ratio of matching blocks: a bound on common runs of characters, then the ratio itself.

The ratio is that of ``difflib.SequenceMatcher(None, a, b)``. Of a text b of 200 characters or more that
library looks only for the rarer characters (at most 1 % of b, and one), so each of its blocks holds one of
them, but for one block where both texts begin. A block of L characters holds L - Q + 1 runs of Q characters,
and blocks overlap in neither text. So M matched characters in B blocks leave at least M - (Q - 1) B runs that
both texts hold, each counted as often as both hold it. B is at most one more than the common occurrences of
b's rarer characters, and one more than the characters without a match. What can't reach the threshold by that goes
without a look at its texts; nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .exact import lcs

#: Characters in a run. Longer runs are rarer between texts that have nothing in common, but blocks have fewer of them.
RUN = 8
#: From so many characters on, the library leaves common characters of the second text out.
JUNK_FROM = 200
_ROOM = 1e-6  # for rounding: bounds let a pair through that they meet but for this


def _rare_limit(n: int) -> int:
    """The most occurrences of a character that is looked for in a text of n characters."""
    return n // 100 + 1 if n >= JUNK_FROM else n


def _common(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from a[i] and b[j] on are the same, up to ``most``."""
    done, step = 0, 32
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done, step = done + step, step * 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return done


def _common_back(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters before a[i] and b[j] are the same, up to ``most``."""
    done, step = 0, 32
    while done < most:
        step = min(step, most - done)
        if a[i - done - step : i - done] == b[j - done - step : j - done]:
            done, step = done + step, step * 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return done


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


#: Places alike that are looked at as arrays; with more, a part is walked through instead. With few, lists take less time.
ARRAYS, LISTS = 4_000_000, 48


class _Places:
    """Where two texts have the same rarer character of the second one: (i, j, length of the run of such places that ends there)."""

    def __init__(self, a: str, b: str) -> None:
        ca, cb = _codes(a), _codes(b)
        chars, which, n = np.unique(cb, return_inverse=True, return_counts=True)
        which = np.where((n <= _rare_limit(len(b)))[which], which, -1)
        found = np.minimum(np.searchsorted(chars, ca), len(chars) - 1)
        # the rarer characters by number; -1 elsewhere in b, -2 in a
        self.b, self.a = which, np.where((chars[found] == ca) & (n[found] <= _rare_limit(len(b))), found, -2)
        self.kinds = len(chars)

    def count(self, alo: int, ahi: int, blo: int, bhi: int) -> int:
        own, other = (np.bincount(x[x >= 0], minlength=self.kinds) for x in (self.a[alo:ahi], self.b[blo:bhi]))
        return int(own @ other)

    def arrays(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All of a part, by i, then j."""
        i, j = (lo + np.flatnonzero(x[lo:hi] >= 0) for x, lo, hi in ((self.a, alo, ahi), (self.b, blo, bhi)))
        j = j[np.argsort(self.b[j], kind="stable")]
        per = np.bincount(self.b[j], minlength=self.kinds)
        n = per[self.a[i]]
        end = np.cumsum(n)
        first = (np.cumsum(per) - per)[self.a[i]]
        i, j = np.repeat(i, n), j[np.repeat(first - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        runs = np.ones(len(i), np.int64)
        after = np.flatnonzero((i > alo) & (j > blo) & (self.a[i - 1] == self.b[j - 1]))  # there is a place before it
        after = after[np.lexsort((i[after], i[after] - j[after]))]
        x, d = i[after], i[after] - j[after]
        begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)))[: len(x)])
        runs[after] = 2 + np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        return i, j, runs

    def walk(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The first longest run of a part, with little memory."""
        at: dict[int, list[int]] = {}
        for j in (blo + np.flatnonzero(self.b[blo:bhi] >= 0)).tolist():
            at.setdefault(int(self.b[j]), []).append(j)
        i0, j0, best, before, last = alo, blo, 0, {}, -2
        for i in (alo + np.flatnonzero(self.a[alo:ahi] >= 0)).tolist():
            if i != last + 1:
                before = {}
            last, now = i, {}
            for j in at.get(int(self.a[i]), ()):
                k = now[j] = before.get(j - 1, 0) + 1
                if k > best:
                    i0, j0, best = i - k + 1, j - k + 1, k
            before = now
        return i0, j0, best


def _longest(places: tuple | list, alo: int, blo: int) -> tuple[int, int, int]:
    """The first longest run within a part that begins at (alo, blo)."""
    if isinstance(places, list):
        i0, j0, best = alo, blo, 0
        for i, j, k in places:
            if k > best and (k := min(k, i - alo + 1, j - blo + 1)) > best:
                i0, j0, best = i - k + 1, j - k + 1, k
        return i0, j0, best
    i, j, k = places
    k = np.minimum(k, np.minimum(i - alo, j - blo) + 1)
    p = int(k.argmax())
    best = int(k[p])
    return int(i[p]) - best + 1, int(j[p]) - best + 1, best


def _within(places: tuple | list, alo: int, ahi: int, blo: int, bhi: int) -> tuple | list:
    if isinstance(places, list):
        return [p for p in places if alo <= p[0] < ahi and blo <= p[1] < bhi]
    lo, hi = np.searchsorted(places[0], (alo, ahi))
    i, j, k = (x[lo:hi] for x in places)
    own = (j >= blo) & (j < bhi)
    i, j, k = i[own], j[own], k[own]
    return list(zip(i.tolist(), j.tolist(), k.tolist())) if len(i) <= LISTS else (i, j, k)


def ratio_at_least(a: str, b: str, threshold: float) -> float | None:
    """``SequenceMatcher(None, a, b).ratio()``, or None where it is under the threshold or a text is empty.

    The library's own blocks, found by its rules. Where texts have no rarer character in common there is none, but
    for one where both begin. It stops once the parts not yet looked at can't make up for what is missing.
    """
    if not a or not b:
        return None
    if a == b:
        return 1.0
    size = len(a) + len(b)
    need = threshold * size / 2 - _ROOM
    every = _Places(a, b)
    # parts with their places alike, once those are few enough, and how much may match in all of them
    todo, matched, left = [((0, len(a), 0, len(b)), None)], 0, min(len(a), len(b))
    while todo:
        (alo, ahi, blo, bhi), places = todo.pop()
        left -= min(ahi - alo, bhi - blo)
        if places is None and every.count(alo, ahi, blo, bhi) <= ARRAYS:
            places = _within(every.arrays(alo, ahi, blo, bhi), alo, ahi, blo, bhi)
        i0, j0, best = every.walk(alo, ahi, blo, bhi) if places is None else _longest(places, alo, blo)
        back = _common_back(a, i0, b, j0, min(i0 - alo, j0 - blo))
        i0, j0, best = i0 - back, j0 - back, best + back
        best += _common(a, i0 + best, b, j0 + best, min(ahi - i0 - best, bhi - j0 - best))
        if best:
            matched += best
            for part in ((alo, i0, blo, j0), (i0 + best, ahi, j0 + best, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    own = None if places is None else _within(places, *part)
                    if own is None or len(own) or part[0] == part[2] == 0:
                        todo.append((part, own))
                        left += min(part[1] - part[0], part[3] - part[2])
        if matched + left < need:
            return None
    found = 2.0 * matched / size
    return found if found >= threshold else None


def _runs(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each run of RUN characters and its how-manieth occurrence in the text. Equal hashes of different runs only raise the bound."""
    if len(codes) < RUN:
        return np.zeros(0, np.uint32)
    h = codes.astype(np.uint64)
    step = 1
    while step < RUN:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    h.sort()
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    times = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + times.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences by character, those alike in their last 8 bits together; and those of rarer characters alone."""
    chars, n = np.unique(codes, return_counts=True)
    rare = np.where(n <= _rare_limit(len(codes)), n, 0)
    return tuple(np.bincount(chars & 255, weights=x, minlength=256).astype(np.int32) for x in (n, rare))


class Texts:
    """Texts with their keys, to be found by the runs that they hold."""

    def __init__(self, keys: list[int], texts: list[str]) -> None:
        self.keys, self.texts = np.array(keys, np.int64), texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.counts, self.rare = np.zeros((len(texts), 256), np.int32), np.zeros((len(texts), 256), np.int32)
        total = int(np.maximum(self.n - RUN + 1, 0).sum())
        bits = min(22, max(8, total.bit_length()))
        self.shift = np.uint32(32 - bits)
        entry, at = np.empty(total, np.uint64), 0
        for k, t in enumerate(texts):
            codes = _codes(t)
            self.counts[k], self.rare[k] = _counts(codes)
            own = _runs(codes)
            entry[at : at + len(own)] = (own >> self.shift).astype(np.uint64) << np.uint64(32) | np.uint64(k)
            at += len(own)
        entry.sort()
        self.first = np.searchsorted(entry, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)
        self.holder = entry.astype(np.uint32).astype(np.int32, copy=False)
        self.rare_total = self.rare.sum(1)

    def held(self, runs: np.ndarray) -> np.ndarray:
        """How many of the runs each text holds, at least."""
        slot = runs >> self.shift
        first, n = self.first[slot], self.first[slot + np.uint32(1)]
        n = n - first
        some = n > 0
        first, n = first[some], n[some]
        end = np.cumsum(n)
        if not len(end):
            return np.zeros(len(self.texts), np.int64)
        return np.bincount(self.holder[np.repeat(first - end + n, n) + np.arange(end[-1])], minlength=len(self.texts))

    def possible(self, key: int, text: str, threshold: float, before: bool) -> np.ndarray:
        """The texts, by place, that may reach the threshold with this one; ``before``: only those of lesser keys. A pair's lesser key comes first."""
        codes = _codes(text)
        size = self.n + len(text)
        need = threshold * size / 2 - _ROOM
        fit = (np.minimum(self.n, len(text)) >= need) & (self.keys < key if before else self.keys != key)
        if not fit.any():
            return np.zeros(0, np.int64)
        counts, rare = _counts(codes)
        later = self.keys > key  # then it is the text held here whose rarer characters count
        least = np.where(later, self.n, len(text)) < JUNK_FROM  # every character is looked for: only what has no match bounds the blocks
        gaps = size * (1 - threshold) + 2 * _ROOM + 1
        blocks = np.where(least, gaps, np.minimum(np.where(later, self.rare_total, rare.sum()) + 1, gaps))
        runs = self.held(_runs(codes))
        found = np.flatnonzero(fit & (runs + (RUN - 1) * blocks >= need))
        if len(found):
            found = found[np.minimum(self.counts[found], counts).sum(1) >= need[found]]
        if len(found):
            own = np.where(later[found], np.minimum(self.rare[found], counts).sum(1), np.minimum(self.counts[found], rare).sum(1)) + 1
            found = found[runs[found] + (RUN - 1) * np.where(least[found], gaps[found], np.minimum(own, gaps[found])) >= need[found]]
        return found

    def within(self, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(lesser key, greater key, ratio) of the pairs of these texts that reach the threshold."""
        for key, text in zip(self.keys.tolist(), self.texts):
            yield from self.similar(key, text, threshold, before=True)

    def similar(self, key: int, text: str, threshold: float, before: bool = False) -> Iterator[tuple[int, int, float]]:
        """The same of this text and each text here."""
        for k in self.possible(key, text, threshold, before):
            other, held = int(self.keys[k]), self.texts[k]
            a, b = (text, held) if other > key else (held, text)
            need = threshold * (len(a) + len(b)) / 2
            if len(b) < JUNK_FROM and lcs(a, b, need) < need:  # the longest common subsequence bounds the blocks; for short texts it takes less
                continue
            if (sim := ratio_at_least(a, b, threshold)) is not None:
                yield min(key, other), max(key, other), sim
