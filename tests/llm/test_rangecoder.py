import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelight.llm import rangecoder as rc

from .test_tokens import REAL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, rc.VOCAB - 1) | st.integers(0, 5), min_size=1, max_size=400), min_size=1, max_size=5))
def test_round_trip(blocks):
    blocks = [np.array(b) for b in blocks]
    for b, code in zip(blocks, rc.encode(blocks)):
        assert (rc.decode(code, len(b), rc.checksum(b)) == b).all()
        assert code == rc.encode([b])[0]  # lanes don't touch each other


def test_gains_from_contexts():
    rng = np.random.default_rng(2)
    noise = rng.integers(0, rc.VOCAB, 6000)
    same = np.tile(rng.integers(0, rc.VOCAB, 50), 120)
    skew = rng.integers(0, 16, 6000)
    sizes = [len(c) * 8 / 6000 for c in rc.encode([noise, same, skew])]
    assert sizes[0] < 18.5 and sizes[1] < 1.5 and sizes[2] < 6


def test_damage_is_found():
    ids = np.random.default_rng(3).integers(0, 500, 3000)
    (code,) = rc.encode([ids])
    hurt = bytearray(code)
    hurt[len(hurt) // 2] ^= 16
    with pytest.raises(ValueError, match="checksum"):
        rc.decode(bytes(hurt), len(ids), rc.checksum(ids))


@pytest.mark.parametrize("block", [7, 4096])
def test_documents_come_back(spark, odd_docs, block):
    blocks = rc.coded(spark, odd_docs.repartition(3, "n_chars"), block=block, lanes=4)
    ids = {(r.part, r.block): r.ids for r in rc.decoded(blocks).collect()} if block > 100 else None
    rows = sorted(blocks.collect(), key=lambda r: (r.part, r.block))
    assert all(sum(r.lengths) == r.n_tokens <= block for r in rows)
    docs, last = [], None
    for r in rows:
        got = ids[r.part, r.block] if ids else rc.decode(bytes(r.code), r.n_tokens, r.crc).tolist()
        at = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            if s == 0:
                docs.append((d, []))
            else:
                assert last == d and len(docs[-1][1]) == s
            docs[-1][1].extend(got[at : at + n])
            at, last = at + n, d
    want = sorted(str((r.doc_id, [*REAL.encode_ordinary(r.text or ""), rc.EOD])) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted(map(str, docs)) == want


def test_empty(spark, no_docs):
    assert rc.coded(spark, no_docs).count() == 0
    assert rc.encode([]) == []


def test_damaged_table_raises(spark, odd_docs):
    bad = rc.coded(spark, odd_docs).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="checksum"):
        rc.decoded(bad).collect()


def test_beats_order_0_and_a_general_compressor(small):
    """On real ids: less than 8.1 bits an id, than the entropy of single ids, and than LZMA block by block."""
    import lzma

    import pyarrow as pa
    import pyarrow.parquet as pq

    from gatelight.llm.tokens import byte_bpe
    from gatelight.llm.words import buffers

    text = pq.read_table(f"{small}/../sf0.01/documents.parquet").column("text").combine_chunks().cast(pa.large_string())
    ids, size = byte_bpe().batch(*buffers(text))
    whole = np.insert(ids, np.cumsum(size), rc.EOD)
    blocks = [whole[a : a + rc.BLOCK] for a in range(0, len(whole), rc.BLOCK)]
    codes = rc.encode(blocks)
    bits = sum(map(len, codes)) * 8 / len(whole)
    share = np.bincount(whole)[np.unique(whole)] / len(whole)
    plain = sum(len(lzma.compress(b.astype("<u2").tobytes(), preset=9)) for b in blocks) * 8 / len(whole)
    assert bits < 8.1 and bits < -(share * np.log2(share)).sum() and bits < plain
    some = [0, 7, len(blocks) - 1]
    for i, got in zip(some, rc.decode_all([codes[i] for i in some], [len(blocks[i]) for i in some], [rc.checksum(blocks[i]) for i in some])):
        assert (got == blocks[i]).all()


def test_odd_blocks():
    """Empty blocks, blocks of one id, of equal ids, and of the least and greatest ids; a block too long."""
    blocks = [np.zeros(0, np.int64), np.array([rc.EOD]), np.zeros(5000, np.int64), np.array([0, rc.VOCAB - 1] * 300), np.arange(2000) * 25 % rc.VOCAB]
    codes = rc.encode(blocks)
    for got, want in zip(rc.decode_all(codes, [len(b) for b in blocks], [rc.checksum(b) for b in blocks]), blocks):
        assert (got == want).all()
    assert len(codes[0]) == 0 and len(codes[2]) < 300
    with pytest.raises(ValueError, match="at most"):
        rc.encode([np.zeros(rc.BLOCK + 1, np.int64)])


def test_coding_costs_little_more_than_tokenizing(small):
    """CPU seconds of ``encode``, by those of making its ids: 4.5 to 8 before order 0 was counted, and the code summed up, in bulk."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    from gatelight.llm.tokens import byte_bpe
    from gatelight.llm.words import buffers

    column = pq.read_table(f"{small}/../sf0.01/documents.parquet").column("text").combine_chunks().cast(pa.large_string())
    text = pa.concat_arrays([column] * 3)

    def spent(f):
        begin = time.thread_time()
        return f(), time.thread_time() - begin

    (ids, _), _ = spent(lambda: byte_bpe().batch(*buffers(text)))  # fills the tokenizer's cache
    blocks = [ids[a : a + rc.BLOCK] for a in range(0, len(ids), rc.BLOCK)]
    tokens, coding = (min(x) for x in zip(*[(spent(lambda: byte_bpe().batch(*buffers(text)))[1], spent(lambda: rc.encode(blocks))[1]) for _ in range(5)]))
    assert coding < 3.8 * tokens, coding / tokens


def test_codes_stay_as_they_are():
    """The codes of fixed ids, as the coder made them when it put the code together id by id."""
    import hashlib

    t = np.arange(rc.BLOCK, dtype=np.int64)
    noise = (t * 2654435761 >> 7) % rc.VOCAB
    blocks = [noise, noise[:5000] % 300, (t * t >> 5) % 50, np.where(t % 3 == 0, noise % 7, t % 11), np.tile([0, rc.VOCAB - 1], 100), np.zeros(0, np.int64), noise[:65], noise[:1]]
    assert hashlib.sha256(b"|".join(rc.encode(blocks))).hexdigest() == "3e33f696ad49f25662c8b90a8a6ce1e670c3ff4d2caeb1ac42ca96f77699ccec"


def test_carries_run_through():
    """A carry over many full words, against the sum in one long integer."""
    moves = np.ones(3000, np.int8)
    moves[[5, 9, 700]] = 0, 2, 2
    high, low = np.full(3000, 0xFFFFFF, np.uint32), np.full(3000, 0, np.uint32)
    high[0], high[5:7], low[-1] = 1, 5, 0xFFFFFFFF
    high[-1], low[-2] = 0xFFFFFF, 0xFFFFFFFF
    words = int(moves.sum()) + 3
    total, at = 0, 0
    for h, l, m in zip(high.tolist(), low.tolist(), moves.tolist()):
        total += ((h << 32) + l << 16) << 24 * (words - at - 3)
        at += m
    assert rc._joined(high, low, moves) == total.to_bytes(3 * words)
