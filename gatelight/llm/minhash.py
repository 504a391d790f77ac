"""Near-duplicates by MinHash with tensored banding, and verified candidates.

Two collections of ``groups`` bands are made, each band of ``band`` minhashes of the document's word
shingles. A table is a pair of bands, one of either collection: groups x groups tables from
2 x groups x band minhashes, where separate bands of that width would take groups times as many. With
the defaults 40 minhashes give 100 tables of four; a pair of Jaccard similarity s shares one with
probability (1 - (1 - s^2)^10)^2: 0.89 at s = 0.5, 0.98 at 0.6, 0.998 at 0.7.

Table keys that only one document has go nowhere: a twice-seen Bloom filter finds the others. Candidates
are verified on their whole shingle sets, which the texts are turned into where they lie, for candidates only.
Verification goes by rounds that skip what is settled: first each bucket's members against its least member,
then against the least member of its least component; at last the members of a bucket that aren't all
connected meet in blocks of ``BLOCK``, which are compared by one matrix product each. So the groups are
those that testing all candidate pairs would give, whatever a bucket's size, while a bucket of n true copies
takes about n tests, and no pair but a verified one is ever written down.

* Shingles are ``n`` neighbouring words, lower-cased, cut at ASCII white space; a text of fewer words
  is one shingle. Texts of the same words in the same order are copies without further test.
* Groups are the connected components of verified pairs with similarity >= ``least``; ties at the
  threshold count. The document with the least doc_id of a group stays.
* Rows that share a doc_id and a text are one document, and one of them stays if it does. Rows that share a
  doc_id with different texts are documents of their own (the lesser is the one whose text has the lesser
  hash), so no text goes without a near-duplicate that stays.
* Rows with a null doc_id, a null text or no word are in no group and always stay.
* Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .scratch import materialize
from .tables import field, free, modest
from .words import SPACE_CLASS, Words, buffers, mix, ngrams, pieces

LEAST = 0.5
N = 3
GROUPS, BAND = 10, 2
#: Members of a bucket that are compared with one another, or with another such block, in one step.
BLOCK = 256
#: Filters up to this size are broadcast; beyond it rows are shuffled instead, with the same result.
BROADCAST_BYTES = 64 << 20

_A = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, where each document's begin (n + 1 offsets), and the words' own hashes."""
    h = w.hashes()
    at = np.arange(len(h)) + w.doc * (n - 1)
    padded = np.zeros(len(h) + len(w.count) * (n - 1), np.uint64)
    padded[at] = h
    size = np.where(w.count > 0, np.maximum(1, w.count - n + 1), 0)
    first = np.concatenate([[0], np.cumsum(size)])
    pos = np.arange(first[-1]) + np.repeat(w.first[:-1] + np.arange(len(size)) * (n - 1) - first[:-1], size)
    return ngrams(padded, n)[pos], first, h


def signatures(data: np.ndarray, offs: np.ndarray, n: int, groups: int, band: int) -> tuple[np.ndarray, ...]:
    """For each document with words: its number, two hashes of its word sequence, and its bands."""
    w = Words(data, offs)
    full = np.flatnonzero(w.count)
    if not len(full):
        return full, np.zeros((0, 2), np.uint64), np.zeros((0, 2 * groups), np.uint64)
    s, first, h = shingles(w, n)
    place = (np.arange(len(h)) - np.repeat(w.first[:-1], w.count)).astype(np.uint64)
    at = w.first[:-1][full]
    same = np.stack([np.add.reduceat(mix(h + (place + np.uint64(1)) * _A[254 + k]), at) for k in range(2)], 1)
    bands = np.zeros((len(full), 2 * groups), np.uint64)
    for g in range(2 * groups):
        for b in range(band):
            k = g * band + b
            low = np.minimum.reduceat((s * _A[k]) >> np.uint64(20), first[:-1][full])
            bands[:, g] = mix(bands[:, g] + low + np.uint64(k + 1))
    return full, same, bands


def _signed(batches: Iterator[pa.RecordBatch], n: int, groups: int, band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = buffers(batch.column(1))
        for lo, hi in pieces(offs):
            full, same, bands = signatures(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n, groups, band)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + lo)), pa.array(same[:, 0].copy().view(np.int64)), pa.array(same[:, 1].copy().view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * 2 * groups, pa.int32()), flat)], ["id", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = buffers(batch.column(1))
        for lo, hi in pieces(offs):
            s, first, _ = shingles(Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), n)
            doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first))
            key = np.unique((doc << np.uint64(32)) | (s >> np.uint64(32)))
            at = np.searchsorted((key >> np.uint64(32)).astype(np.int64), np.arange(hi - lo + 1))
            flat = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["id", "s"])


def _worded(text: Column) -> Column:
    return F.rlike(text, F.lit(SPACE_CLASS.replace("[", "[^")))


def _keys(bands: np.ndarray, groups: int) -> np.ndarray:
    """Each table's key of each document, from one band of either collection."""
    i, j = np.divmod(np.arange(groups * groups), groups)
    return mix(bands[:, i] * _A[250] + bands[:, groups + j] * _A[251] + np.arange(1, groups * groups + 1).astype(np.uint64) * _A[252])


def _bands(batch: pa.RecordBatch, groups: int) -> np.ndarray:
    column = batch.column("bands")
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), 2 * groups)


def documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, lower-cased text) of every row that has an id and a word, and the ids that occur more than once, if any.

    If any do, an id is a struct of the doc_id and the text's hash, so rows with different texts are apart.
    """
    own = docs.select(field("doc_id").alias("id"), field("text").cast("string").alias("text")).where(F.col("id").isNotNull() & _worded(F.col("text")))
    again = materialize(own.groupBy("id").count().where("count > 1").select("id"))
    if again.isEmpty():
        return own.select("id", F.lower("text").alias("text")), None
    return own.select(_apart(F.col("id"), F.col("text")).alias("id"), F.lower("text").alias("text")), again


def _apart(key: Column, text: Column) -> Column:
    return F.struct(key.alias("id"), F.xxhash64(text).alias("v"))


def held(spark: SparkSession, rows: DataFrame, key: Column, keys: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """rows split in two: those whose key the filter of ``keys`` doesn't hold, and the few others, which it may."""
    segments = bloom.segments_for(keys.count())
    filters = bloom.members(keys.select(F.xxhash64(keys.columns[0])), segments)
    if bloom.size(filters) > broadcast_bytes:
        return rows.limit(0), rows
    maybe = bloom.maybe(spark, filters, segments)(F.xxhash64(key))
    return rows.where(~maybe), rows.where(maybe)


def components(edges: DataFrame) -> DataFrame:
    """id, label for every vertex of the edges (a, b): the least vertex that it is connected with."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hop = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = materialize(step.join(hop, F.col("label") == F.col("via")).select("id", "old", F.least("label", "far").alias("label")))
        if new.where("old != label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _members(spark: SparkSession, reps: DataFrame, kind: str, groups: int, broadcast_bytes: int) -> DataFrame:
    """key, id, lead of every document in every table's bucket of two documents or more; lead is the least of them."""
    segments = bloom.segments_for(reps.count() * groups * groups)
    pack = bloom.packer(segments)
    filters = bloom.repeats(reps.select("bands").mapInArrow(lambda it: pack(_keys(_bands(b, groups), groups).view(np.int64).ravel() for b in it), bloom.PACKETS))

    def keyed(batches: Iterator[pa.RecordBatch], own=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(_bands(batch, groups), groups).view(np.int64).ravel()
            at = np.flatnonzero(bloom.probe(own.value, segments, key)) if own else np.arange(len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column("id").take(pa.array(at // (groups * groups)))], ["key", "id"])

    schema = f"key long, id {kind}"
    if bloom.size(filters) > broadcast_bytes:
        every = reps.select("id", "bands").mapInArrow(keyed, schema)
        found = every.join(bloom.found_in(every.select(F.col("key").alias("h")), filters, segments), F.col("key") == F.col("h"), "left_semi")
    else:
        own = bloom.shared(spark, filters)
        found = reps.select("id", "bands").mapInArrow(lambda it: keyed(it, own), schema)
    found = materialize(found)
    lead = found.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("other")).where("lead != other").select("key", "lead")
    return materialize(found.join(lead, "key"))


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers that are equal where the ids are."""
    if not pa.types.is_struct(ids.type):
        return ids.dictionary_encode().indices.to_numpy()
    first, second = (_codes(x).astype(np.int64) for x in ids.flatten())
    return first * (second.max(initial=0) + 1) + second


def _compare(table: pa.Table, least: float) -> pa.Table:
    """The verified pairs of a block, or between two blocks (``side`` 0 and 1), that have different labels."""
    s = table.column("s").combine_chunks()
    size = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    side, label = table.column("side").to_numpy(), _codes(table.column("label").combine_chunks())
    owner, value = np.repeat(np.arange(len(size)), size), s.flatten().to_numpy(zero_copy_only=False)
    _, at, times = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # only what two of them hold
    keep = times[at] > 1
    owner, at = owner[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(size), len(size)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        x = np.zeros((len(size), 4096), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        common += x @ x.T
    good = common >= least * (size[:, None] + size[None, :] - common)
    good &= label[:, None] != label[None, :]
    good &= (side[:, None] < side[None, :]) if side.any() else np.triu(np.ones(good.shape, bool), 1)
    i, j = np.nonzero(good)
    ids = table.column("id").combine_chunks()
    return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))})


def _grouped(spark: SparkSession, docs: DataFrame, least: float, n: int, groups: int, band: int, block: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """id, group for every document that has a near-duplicate, and the doc_ids of several rows, as ``documents`` gives them."""
    modest(spark)
    text, again = documents(docs)
    kind = text.schema["id"].dataType.simpleString()
    signed = materialize(text.mapInArrow(lambda it: _signed(it, n, groups, band), f"id {kind}, k1 long, k2 long, bands array<bigint>"))
    alike = materialize(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    copies = materialize(signed.select("id", "k1", "k2").join(alike, ["k1", "k2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    alone, some = held(spark, signed, F.col("k1"), alike.select("k1"), broadcast_bytes)
    several = some.join(alike.select("k1", "k2", "rep"), ["k1", "k2"], "left").where("rep is null or id = rep").select("id", "bands").dropDuplicates(["id"])
    reps = materialize(alone.select("id", "bands").unionByName(several))
    member = _members(spark, reps, kind, groups, broadcast_bytes)
    active = materialize(member.select("id").distinct())
    # written between the two, so that no task has two Python processes at a time
    some = materialize(held(spark, text, F.col("id"), active, broadcast_bytes)[1])
    sets = some.mapInArrow(lambda it: _sets(it, n), f"id {kind}, s array<int>")
    sets = materialize(sets if again is None else sets.dropDuplicates(["id"]))
    size = sets.select("id", F.size("s").alias("n"))

    def end(x: str, value: DataFrame, name: str) -> DataFrame:
        return value.select(F.col("id").alias(x), F.col(name).alias(f"{name}{x}"))

    def needed(ids: DataFrame) -> DataFrame:
        """The sets of these ids, and few others."""
        return held(spark, sets, F.col("id"), ids.distinct(), broadcast_bytes)[1]

    def verified(pairs: DataFrame) -> DataFrame:
        # sizes alone rule out many; sets go only to the others
        fit = materialize(pairs.join(end("a", size, "n"), "a").join(end("b", size, "n"), "b").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")).select("a", "b"))
        both = fit.join(end("a", needed(fit.select("a")), "s"), "a").join(end("b", needed(fit.select("b")), "s"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.where(common >= F.lit(least) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))

    def mixed(edges: DataFrame) -> DataFrame:
        """key, id, label, top of the buckets that hold more than one component; top is the least of (label, id)."""
        label = components(edges)
        known = member.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        ends = known.groupBy("key").agg(F.min(F.struct("label", "id")).alias("top"), F.max("label").alias("end"), F.count("*").alias("n")).where("top.label != end")
        return materialize(known.join(ends, "key").select("key", "id", "label", "top", "n"))

    tested = materialize(member.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    edges = verified(tested)
    left = mixed(edges)
    if not left.isEmpty():
        more = left.where("label != top.label").select(F.least("top.id", "id").alias("a"), F.greatest("top.id", "id").alias("b")).distinct()
        more = materialize(more.join(tested, ["a", "b"], "left_anti"))
        edges = edges.unionByName(verified(more))
        left = mixed(edges)
    if not left.isEmpty():
        blocks = F.ceil(F.col("n") / block).cast("int")
        own = left.select("key", "id", "label", F.pmod(F.xxhash64("id", "key"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
        each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("key", "id", "label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
        last = each.join(needed(left.select("id")), "id").groupBy("key", "p", "q").applyInArrow(lambda table: _compare(table, least), f"a {kind}, b {kind}")
        edges = edges.unionByName(materialize(last.distinct()))
    return components(edges.unionByName(copies)).select("id", F.col("label").alias("group")), again


def groups_of(spark: SparkSession, docs: DataFrame, least: float = LEAST, n: int = N, groups: int = GROUPS, band: int = BAND, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, group for every document that has a near-duplicate; group is the least doc_id among them."""
    found, again = _grouped(spark, docs, least, n, groups, band, block, broadcast_bytes)
    return found if again is None else found.select("id.id", F.col("group.id").alias("group"))


def near_duplicates(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, kept_id, group_size for every document of a group; kept_id is the one that stays."""
    found, again = _grouped(spark, docs, least, N, GROUPS, BAND, BLOCK, BROADCAST_BYTES)
    size = found.groupBy("group").agg(F.count("*").alias("group_size"))
    pick = (lambda c: c) if again is None else (lambda c: f"{c}.id")
    return found.join(size, "group").select(F.col(pick("id")).alias("doc_id"), F.col(pick("group")).alias("kept_id"), "group_size")


def keep_one(spark: SparkSession, docs: DataFrame, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one document of each group, and one row of each document; all columns as they were."""
    found, again = _grouped(spark, docs, least, N, GROUPS, BAND, BLOCK, broadcast_bytes)
    key, row = free(docs, "gl_id", "gl_row")
    gone = materialize(found.where("id != group").select(F.col("id").alias(key)))
    own = field("doc_id") if again is None else _apart(field("doc_id"), field("text").cast("string"))
    aside, some = held(spark, docs, own, gone, broadcast_bytes)
    out = aside.unionByName(some.join(gone, own == F.col(key), "left_anti"))
    if again is None:
        return out
    # of rows that share both, any one; a table of such rows alone has their ids
    single = field("doc_id").isNull() | ~F.coalesce(_worded(field("text").cast("string")), F.lit(False))
    aside, some = held(spark, out, field("doc_id"), again, broadcast_bytes)
    every = [field(c) for c in docs.columns]
    one = some.where(~single).groupBy(field("doc_id"), field("text")).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias(row)).select(f"{row}.*")
    return aside.unionByName(some.where(single)).unionByName(one)
