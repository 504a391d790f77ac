"""Token ids as compressed binary: an adaptive context-mixing range coder in independent blocks.

A block of up to ``BLOCK`` ids is coded by one number in [0, 1) that a range coder narrows down id by id:

* Order 2 predicts the last two different ids that followed the two preceding ids, order 1 the last two that
  followed the one preceding id.
* How likely each prediction is, and that none holds, is mixed from two sets of counts, one by order 2's
  context (how often in a row it has been right lately, and how its prediction fared here), one by order 1's.
  The mixture's weights are learned too: each set's share of what was given to what came, apart for how
  long order 2 has been right.
* Order 0 codes what none predicts: counts of the block's ids so far, on a prior that falls with the id's rank,
  without the ids that were predicted in vain.

Contexts take effect with each id, the mixture's counts and weights every ``_STEP`` ids, order-0 counts every 256
(sooner at the beginning), so many blocks can be coded, and decoded, in lockstep. Only sums, products and
quotients in a fixed order are taken, of integers, IEEE singles or doubles, so every machine gives the same.

Every block begins with an empty model and carries the CRC-32 of its ids (little-endian 16 bit); a
decoder checks it. A lost or damaged block harms no other. Carries of the range coder are resolved
when a block is complete.

* A document is its ids and an end-of-document id; blocks run over document borders, and list which
  tokens of which documents they hold: (doc_id, first token, number of tokens).
* A null or empty text is the end-of-document id alone. Repeated rows are coded again. An empty table
  has no block. Other columns are not read, whatever their names.
* Blocks don't cross input partitions, so where they end depends on how the table is split; the tokens
  don't.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import field
from .tokens import byte_bpe
from .words import buffers

BLOCK = 16_384
#: Blocks coded in lockstep.
LANES = 512
EOD = 50_256
VOCAB = 50_257
#: Ids by which counts and weights of the mixture lag at most.
_STEP = 64
#: The range is shared out in 2^26 parts. Order 0 keeps at least so many, more than its counts' total can be.
_T, _REST = 26, 1 << 21
_TIMES = 96
_PRIOR = 1 + 8192 // (np.arange(VOCAB, dtype=np.int64) + 64)
_BELOW = np.concatenate([[0], np.cumsum(_PRIOR)])
_PRIORS, _BELOWS = _PRIOR.tolist(), _BELOW.tolist()
_LOW = np.uint64((1 << 32) - 1)
#: Contexts of the two sets of counts, and classes of the weights.
_SIZES, _CLASSES = (8 * 11 * 3, 4 * 11 * 3), 8
_NONE = 4  # the kind of an id that none of the four predictions gives
_START, _BOTH = np.float32(0.4), np.float32(2)
#: How often in a row a context gave the same id, and how often order 2 was right, as classes.
_RUN = np.array([0, 1, 2, 3, 4, 4, 4, 4, 5], np.int32)
_HITS = np.array([0, 1, 2, 3, 4, 4, 4, 4, *[5] * 8, *[6] * 16, 7], np.int32)
_RUNS, _HIT = _RUN.tolist(), _HITS.tolist()
_STATE = 2 * _RUN - 1


def segments(n: int) -> list[int]:
    """Where order-0 counts are brought up to date: 64, 128, 256 and then each 256 ids."""
    out, at = [], 64
    while at < n:
        out.append(at)
        at += min(at, 256)
    return [*out, n]


#: The places in a block; between which two updates of order 0 each lies, and where that stretch begins.
_AT = np.arange(1 << 14, dtype=np.int32)
_STRETCH = np.searchsorted(segments(1 << 14), _AT, "right")
_BEGIN = np.array([0, *segments(1 << 14)], np.int32)[_STRETCH]


def _history(ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last id that followed each id's context, the last other one before it (-1: none), and a state."""
    n = len(ids)
    t = _AT[:n]
    ranked = np.sort((key << 14) | t)
    order = ranked & 0x3FFF
    x = ids.take(order)
    ranked >>= 14
    known = np.zeros(n, bool)
    np.equal(ranked[1:], ranked[:-1], out=known[1:])
    same = known.copy()
    same[1:] &= x[1:] == x[:-1]
    # where the run of the one before begins, and where the context does
    run = np.maximum.accumulate(np.where(same, 0, t))
    begin = np.maximum.accumulate(np.where(known, 0, t))
    run[1:], run[:1] = run[:-1].copy(), 0
    other = run > begin
    other &= known
    out = np.empty((3, n), np.int32)
    last = np.full(n, -1, np.int32)
    np.copyto(last[1:], x[:-1], where=known[1:])
    out[0, order] = last
    out[1, order] = np.where(other, x.take(run - 1, mode="wrap"), -1)
    state = _STATE.take(np.minimum(t - run, 8))
    state += other
    state *= known
    out[2, order] = state
    return out[0], out[1], out[2]


def prepared(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a block's coding needs of each id: both contexts and the class, as one number each; which of the four
    predictions count; which holds (4: none); and, where none does, begin, share and total of order 0."""
    ids = ids.astype(np.int32)
    n = len(ids)
    if n > 1 << 14:
        raise ValueError(f"a block holds at most {1 << 14} ids")
    one, two = np.full(n, EOD, np.int32), np.full(n, EOD, np.int64)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    a2, b2, s2 = _history(ids, (two << 16) | one)
    a1, b1, s1 = _history(ids, one)
    there = np.empty((_NONE, n), bool)
    np.greater_equal(a2, 0, out=there[0])
    np.greater_equal(b2, 0, out=there[1])
    for c, ok in ((a1, there[2]), (b1, there[3])):
        np.greater_equal(c, 0, out=ok)
        ok &= c != a2
        ok &= c != b2
    right = a2 == ids
    kind = np.full(n, _NONE, np.int8)
    for k, hit in ((3, there[3] & (b1 == ids)), (2, there[2] & (a1 == ids)), (1, b2 == ids), (0, right)):
        kind[hit] = k
    t = _AT[:n]
    miss = np.maximum.accumulate(np.where(right, -1, t))
    hits = np.zeros(n, np.int32)
    hits[1:] = t[1:] - 1 - miss[:-1]
    h = _HITS.take(np.minimum(hits, 32))
    agree = (a1 != a2) + np.int8(1)
    agree *= there[0]
    own = np.stack([(h * 11 + s2) * 3 + agree, (np.minimum(h, 3) * 11 + s1) * 3 + agree, h]).astype(np.int16)
    # order 0, only of the ids that no prediction gives; a row of counts for each stretch between two updates
    tail = np.zeros((3, n), np.uint32)
    none = np.flatnonzero(kind == _NONE)
    held = np.zeros(VOCAB, bool)
    held[ids] = True
    known = np.flatnonzero(held)
    m = len(known)
    rank = np.full(VOCAB + 1, m, np.int32)  # the last is for no prediction, the count of which is 0
    rank[known] = _AT[:m]
    stretch = _STRETCH[:n]
    rows = int(stretch[-1]) + 1 if n else 0
    count = np.zeros((rows, m + 1), np.int32)
    if rows:
        count[0, :m] = _PRIOR[known]
        upto = segments(n)[-2] if rows > 1 else 0
        count[1:] = np.bincount(stretch[:upto] * (m + 1) + rank.take(ids[:upto]), minlength=(rows - 1) * (m + 1)).reshape(rows - 1, m + 1)
        count[1:] *= _TIMES
        for before, after in zip(count, count[1:]):
            after += before
    below = np.cumsum(count, axis=1, dtype=np.int32)
    mine = rank.take(ids[none])
    row = stretch[none] * (m + 1)
    own_count = count.take(row + mine)
    # the priors of ids that the block doesn't hold
    lacking = (_BELOW[known] - (np.cumsum(_PRIOR[known]) - _PRIOR[known])).astype(np.int32)
    low = lacking.take(mine) + below.take(row + mine) - own_count
    total = (_BELOWS[-1] + _TIMES * _BEGIN[:n].take(none)).astype(np.int32)
    for c, ok in zip((a2, b2, a1, b1), there):
        g = rank.take(np.where(ok, c, VOCAB)[none])
        gone = count.take(row + g)
        total -= gone
        gone *= g < mine
        low -= gone
    tail[0, none], tail[1, none], tail[2, none] = low, own_count, total
    return own, there, kind, tail


class _Mixer:
    """Counts and weights of some blocks, one block a lane."""

    def __init__(self, lanes: int) -> None:
        self.lanes = lanes
        self.tally = [np.full((_NONE + 1, lanes * size), _START, np.float32) for size in _SIZES]
        self.weight = np.full((2, lanes * _CLASSES), _BOTH, np.float32)

    def masses(self, lane: np.ndarray, own: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Parts of 2^26 for the four predictions, and what ``learn`` needs."""
        at = [lane * size + c for size, c in zip(_SIZES, own)]
        place = lane * _CLASSES + own[2]
        weights = self.weight.take(place, axis=1)
        whole = weights[0] + weights[1]
        given = []
        for tally, where, w in zip(self.tally, at, weights):
            c = tally.take(where, axis=1)
            scale = c[0] + c[1]
            for x in c[2:]:
                scale += x
            scale *= whole
            np.divide(w, scale, out=scale)
            c *= scale
            given.append(c)
        p = given[0] + given[1]
        q = p[:_NONE] * there
        scale = q[0] + q[1]
        for x in (q[2], q[3], p[_NONE]):
            scale += x
        np.divide(np.float32((1 << _T) - _REST - 64), scale, out=scale)
        q *= scale
        mass = q.astype(np.int32)
        mass += there
        return mass, (at, place, given[0], p)

    def learn(self, made: tuple, kind: np.ndarray) -> None:
        """Take in what came, in the order of the arrays."""
        at, place, first, p = made
        for tally, where, size in zip(self.tally, at, _SIZES):
            np.add.at(tally.reshape(-1), (kind * (self.lanes * size) + where).ravel(), np.float32(1))
        came = _picked(kind)
        share = first.take(came)
        share /= p.take(came)
        np.add.at(self.weight[0], place.ravel(), share)
        np.add.at(self.weight[1], place.ravel(), np.float32(1) - share)


def _picked(kind: np.ndarray) -> np.ndarray:
    """Where in arrays of one more axis, in front, the items lie that kind picks along it."""
    return kind.ravel() * kind.size + np.arange(kind.size)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's code, all of them coded in lockstep."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    size = np.array([len(blocks[i]) for i in order])
    n, lanes = int(size.max(initial=0)), len(blocks)
    own, tail = np.zeros((3, lanes, n), np.int16), np.zeros((3, lanes, n), np.uint32)
    there, kind = np.zeros((_NONE, lanes, n), bool), np.zeros((lanes, n), np.int8)
    for lane, i in enumerate(order):
        if k := len(blocks[i]):
            own[:, lane, :k], there[:, lane, :k], kind[lane, :k], tail[:, lane, :k] = prepared(blocks[i])
    mixer = _Mixer(lanes)
    wide = np.full(lanes, 1 << 56, np.uint64)
    live = np.searchsorted(-size, -np.arange(n), "left")
    own_bits, t32, t24, least = np.uint64(_T), np.uint64(32), np.uint64(24), np.uint64(1 << 32)
    step = np.arange(lanes)[:, None]
    for a in range(0, n, _STEP):
        b = min(a + _STEP, n)
        k = int(live[a])
        what = kind[:k, a:b].astype(np.int64)
        mass, made = mixer.masses(step[:k], own[:, :k, a:b].astype(np.int64), there[:, :k, a:b])
        begin, share = (np.empty((_NONE + 1, k, b - a), np.int32) for _ in range(2))
        begin[0], share[:_NONE] = 0, mass
        for j in range(_NONE):
            np.add(begin[j], mass[j], out=begin[j + 1])
        # products of less than 2^47 are exact as doubles, and totals of less than 2^21 leave quotients far enough from
        # the next integer, so this rounds down as integers do
        rest = ((1 << _T) - begin[_NONE]).astype(np.float64)
        x = tail[:, :k, a:b]
        total = np.maximum(x[2], 1)
        first = (x[0] * rest / total).astype(np.int32)
        np.subtract(((x[0] + x[1]) * rest / total).astype(np.int32), first, out=share[_NONE])
        begin[_NONE] += first
        came = _picked(what).reshape(what.shape).T
        begin, share = (y.take(came).astype(np.uint64) for y in (begin, share))
        # the ranges, id by id; what is added to the code follows from them
        part, small = np.empty((b - a, k), np.uint64), np.empty((2, b - a, k), bool)
        w = wide[:k]
        for p, m, once, twice in zip(part, share, *small):
            np.right_shift(w, own_bits, out=p)
            np.multiply(p, m, out=w)
            for s in (once, twice):
                np.less(w, least, out=s)
                np.left_shift(w, t24, out=w, where=s)
        part *= begin
        # in place of what isn't needed any more: the number added, and by how many words the code moves on then
        tail[0, :k, a:b], tail[1, :k, a:b] = (part >> t32).T, (part & _LOW).T
        kind[:k, a:b] = (small[0].view(np.int8) + small[1].view(np.int8)).T
        # positions beyond a lane's end change only what it no longer uses
        mixer.learn(made, what)
    codes: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        if k := int(size[lane]):
            codes[i] = _joined(tail[0, lane, :k], tail[1, lane, :k], kind[lane, :k])
    return codes


def _joined(high: np.ndarray, low: np.ndarray, moves: np.ndarray) -> bytes:
    """The sum of the numbers, each 24 bits lower for each move before it, in words of 24 bits."""
    at = np.cumsum(moves, dtype=np.int64)
    first = np.append(0, np.flatnonzero(moves[:-1]) + 1)  # of the numbers in the same place
    x = np.add.reduceat(high, first, dtype=np.uint64) << np.uint64(32)
    x += np.add.reduceat(low, first, dtype=np.uint64)
    words = np.zeros(at[-1] + 3, np.uint64)
    place = at[first] - moves[first]
    words[place] += x >> np.uint64(32)
    words[place + 1] += (x >> np.uint64(8)) & np.uint64(0xFFFFFF)
    words[place + 2] += (x & np.uint64(0xFF)) << np.uint64(16)
    while (carry := words[1:] >> np.uint64(24)).any():
        words[1:] &= np.uint64(0xFFFFFF)
        words[:-1] += carry
    return words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


class _Model:
    """What a decoder knows of one block: its contexts and order-0 counts so far."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.contexts: tuple[dict, dict] = ({}, {})
        self.seen: list[int] = []  # the counted ids in order
        self.upto, self.hits = 64, 0

    def look(self) -> tuple[int, int, int, bool, bool, bool, bool]:
        """The two contexts and the class, and which predictions count."""
        one = self.ids[-1] if self.ids else EOD
        two = self.ids[-2] if len(self.ids) > 1 else EOD
        self.key = ((two, one), one)
        a2, b2, run2 = self.contexts[0].get(self.key[0], (-1, -1, 0))
        a1, b1, run1 = self.contexts[1].get(one, (-1, -1, 0))
        self.cands = (a2, b2, a1, b1)
        s2, s1 = (2 * _RUNS[min(r, 8)] - 1 + (b >= 0) if r else 0 for r, b in ((run2, b2), (run1, b1)))
        h, agree = _HIT[min(self.hits, 32)], 0 if a2 < 0 else 1 if a1 == a2 else 2
        self.there = (a2 >= 0, b2 >= 0, a1 >= 0 and a1 not in (a2, b2), b1 >= 0 and b1 not in (a2, b2))
        return (h * 11 + s2) * 3 + agree, (min(h, 3) * 11 + s1) * 3 + agree, h, *self.there

    def _upto(self, x: int) -> int:
        return _BELOWS[x] + _TIMES * bisect_left(self.seen, x)

    def rest(self, v: int, rest: int) -> tuple[int, int, int]:
        """The id in whose part of the rest v lies, and that part's begin and size."""
        vain = sorted((c, self._upto(c + 1) - self._upto(c)) for c, ok in zip(self.cands, self.there) if ok)
        total = _BELOWS[-1] + _TIMES * len(self.seen) - sum(n for _, n in vain)
        v = ((v + 1) * total - 1) // rest
        gone = 0
        for c, n in vain:
            if v + gone >= self._upto(c):
                gone += n
        a, b = 0, VOCAB  # the greatest id that begins at v or before it
        while b - a > 1:
            mid = (a + b) >> 1
            if self._upto(mid) <= v + gone:
                a = mid
            else:
                b = mid
        low, high = self._upto(a) - gone, self._upto(a + 1) - gone
        return a, low * rest // total, high * rest // total - low * rest // total

    def add(self, x: int) -> None:
        self.hits = self.hits + 1 if self.cands[0] == x else 0
        for table, key in zip(self.contexts, self.key):
            a, b, run = table.get(key, (-1, -1, 0))
            table[key] = (a, b, run + 1) if a == x else (x, a, 1)
        self.ids.append(x)
        if len(self.ids) == self.upto:
            self.seen = sorted(self.ids)
            self.upto += min(self.upto, 256)


def decode(code: bytes, n: int, crc: int | None = None) -> np.ndarray:
    """The ids of a block; ValueError if they don't have the checksum."""
    return decode_all([code], [n], None if crc is None else [crc])[0]


def decode_all(codes: list[bytes], sizes: list[int], crcs: list[int] | None = None) -> list[np.ndarray]:
    """The ids of some blocks, decoded in lockstep; ValueError if any hasn't its checksum."""
    order = sorted(range(len(codes)), key=lambda i: -sizes[i])
    lanes, n = len(codes), max(sizes, default=0)
    raw = [codes[i] for i in order]
    value, at, wide = [int.from_bytes(c[:7].ljust(7, b"\0")) for c in raw], [7] * lanes, [1 << 56] * lanes
    mixer, models = _Mixer(lanes), [_Model() for _ in range(lanes)]
    live = np.searchsorted([-sizes[i] for i in order], -np.arange(n + 1), "left").tolist()
    pending: list[tuple] = []
    for t in range(n):
        k = live[t]
        seen = np.array([m.look() for m in models[:k]], np.int64).T
        mass, made = mixer.masses(np.arange(k), seen[:3], seen[3:] > 0)
        kinds = []
        for i, own in enumerate(zip(*(m.tolist() for m in mass))):
            m, part = models[i], wide[i] >> _T
            v = min(value[i] // part, (1 << _T) - 1)
            kind, begin = 0, 0
            while kind < _NONE and v >= begin + own[kind]:
                begin += own[kind]
                kind += 1
            if kind < _NONE:
                x, share = m.cands[kind], own[kind]
            else:
                x, first, share = m.rest(v - begin, (1 << _T) - begin)
                begin += first
            value[i] -= part * begin
            wide[i] = part * share
            while 0 < wide[i] < 1 << 32:
                wide[i] <<= 24
                value[i] = (value[i] << 24) | int.from_bytes(raw[i][at[i] : at[i] + 3].ljust(3, b"\0"))
                at[i] += 3
            if not wide[i]:
                raise ValueError("the block is damaged: it can't be read")
            m.add(x)
            kinds.append(kind)
        pending.append((made, np.array(kinds)))
        if len(pending) == _STEP or t + 1 == n:
            for one in pending:
                mixer.learn(*one)
            pending = []
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for i, m in zip(order, models):
        out[i] = np.array(m.ids, np.int64)
        if crcs is not None and checksum(out[i]) != crcs[i]:
            raise ValueError("the block is damaged: its checksum differs")
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())


def _coded(batches: Iterator[pa.RecordBatch], block: int, lanes: int, path: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list[np.ndarray] = []  # ids not yet in a block
    docs: list[tuple[object, int]] = []  # (doc_id, ids) of the documents not yet in a block
    n, skip, no = 0, 0, 0  # ids held; ids of the first document that are in earlier blocks; blocks so far
    kind = pa.int64()

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, docs, n, skip, no
        ids = np.concatenate(held) if held else np.zeros(0, np.int32)
        full = -(-n // block) if last else n // block
        for lo in range(0, full, lanes):
            many = range(lo, min(lo + lanes, full))
            cut = [ids[i * block : (i + 1) * block] for i in many]
            codes = encode(cut)
            cols: list[list] = [[], [], []]
            at = 0
            for one in cut:
                need, names, starts, sizes = len(one), [], [], []
                while need:
                    name, size = docs[at]
                    take = min(need, size - skip)
                    names.append(name)
                    starts.append(skip)
                    sizes.append(take)
                    need -= take
                    skip += take
                    if skip == size:
                        at, skip = at + 1, 0
                for col, x in zip(cols, (names, starts, sizes)):
                    col.append(x)
            docs = docs[at:]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int32()), pa.array(range(no, no + len(cut)), pa.int32()), pa.array([len(x) for x in cut], pa.int32()), pa.array([checksum(x) for x in cut], pa.int64()), pa.array(codes, pa.binary()), pa.array(cols[0], pa.list_(kind)), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32()))], ["part", "block", "n_tokens", "crc", "code", "doc_ids", "starts", "lengths"])
            no += len(cut)
        held = [ids[full * block :]]
        n = max(0, n - full * block)

    for batch in batches:
        kind = batch.schema.field(0).type
        ids, size = byte_bpe(path).batch(*buffers(batch.column(1)))
        if not len(size):
            continue
        # an end-of-document id after each text
        ends = np.cumsum(size + 1)
        own = np.full(ends[-1], EOD, np.int32)
        own[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
        held.append(own)
        docs += zip(batch.column(0).to_pylist(), (size + 1).tolist())
        n += len(own)
        if n >= block * lanes:
            yield from out(False)
    if n:
        yield from out(True)


def coded(spark: SparkSession, docs: DataFrame, block: int = BLOCK, lanes: int = LANES, path: str | None = None) -> DataFrame:
    """part, block, n_tokens, crc, code, and doc_ids, starts, lengths of what each block holds, in order."""
    own = docs.select(field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _coded(it, block, lanes, path), f"part int, block int, n_tokens int, crc long, code binary, doc_ids array<{kind}>, starts array<int>, lengths array<int>")


def decoded(blocks: DataFrame) -> DataFrame:
    """part, block and the ids, from the table that ``coded`` gives; a damaged block raises."""

    @F.arrow_udf("array<int>")
    def ids(code: pa.Array, n: pa.Array, crc: pa.Array) -> pa.Array:
        found: list[list[int]] = []
        for lo in range(0, len(code), LANES):
            found += [x.tolist() for x in decode_all(*(c.slice(lo, LANES).to_pylist() for c in (code, n, crc)))]
        return pa.array(found, pa.list_(pa.int32()))

    return blocks.select("part", "block", ids("code", "n_tokens", "crc").alias("ids"))
