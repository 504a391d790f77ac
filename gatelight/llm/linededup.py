"""Line dedup with two Bloom filters: hashes seen once, and hashes seen twice.

1. Each task packs the hashes of its lines, by segment of the hash space, as the sparse filter that
   they set: four bytes for a distinct line, kept apart for those met once and those met again.
2. Per segment the packets are merged: a hash that the once-seen filter already holds goes into the
   twice-seen filter. Only the twice-seen filter is kept, two bytes for a line that repeats.
3. Every line is probed. A line that the twice-seen filter doesn't hold is unique and goes nowhere;
   the suspected ones alone are shuffled, by their text, which confirms the repeat and finds the first
   occurrence. False positives of the filters cost a little shuffling and change nothing.
4. Lines are taken out where the documents lie. The commonest repeated lines (``HOT_LINES`` at most, each of
   ``HOT_BYTES`` at most, so of a known size) are broadcast with their first occurrences. Of the others the
   removals go by document, and a filter of the ids that they touch lets all other documents pass unshuffled.

The twice-seen filters and those of touched ids are broadcast while they are small (``BROADCAST_BYTES``);
beyond that hashes, or the documents, are shuffled instead, with the same result.

* A line is what stands between newlines. Lines shorter than ``min_chars`` characters, or of white
  space only, are kept wherever they stand.
* The first occurrence is the one with the least (doc_id, line number), null ids last. Rows that share
  a doc_id count as one document; if such rows hold a line at the same number, both keep it.
* A document that loses lines and keeps nothing but white space is dropped. One that had no text to
  begin with (empty, blank or null) is kept as it is.
* Repeats within a document are removed too. Order and all other columns stay; n_chars follows. Other columns
  are not read, whatever their names.
* A text is handled in time linear in its lines, however many it has or loses. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .scratch import materialize
from .tables import field, free, modest, with_text
from .words import buffers, pieces

MIN_CHARS = 10
BROADCAST_BYTES = 64 << 20
HOT_LINES, HOT_BYTES = 20_000, 1000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    own = docs.select(field("doc_id").alias("id"), F.posexplode(F.split(field("text").cast("string"), "\n", -1)).alias("pos", "line"))
    return own.where((F.length("line") >= min_chars) & F.rlike("line", F.lit(r"[^ \t\x0B\f\r]"))).withColumn("h", F.xxhash64("line"))


def suspects(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, pos, line of every line that may repeat: all that do, and few others."""
    lines = _lines(docs, min_chars)
    # a line that counts has min_chars bytes and a newline, so this bounds the lines of a segment
    total = docs.agg(F.sum(F.octet_length(field("text").cast("string")))).first()[0] or 0
    segments = bloom.segments_for(total // (max(min_chars, 1) + 1))
    pack = bloom.packer(segments)
    filters = bloom.repeats(lines.select("h").mapInArrow(lambda it: pack(b.column(0).to_numpy(zero_copy_only=False) for b in it), bloom.PACKETS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if bloom.size(filters) > broadcast_bytes:
        return lines.join(bloom.found_in(lines, filters, segments), "h", "left_semi").select("id", "pos", "line")
    shared = bloom.shared(spark, filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom.probe(shared.value, segments, batch.column("h").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit)).select(["id", "pos", "line"])

    return lines.mapInArrow(probe, f"id {kind}, pos int, line string")


def repeated(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, hot_lines: int = HOT_LINES) -> tuple[DataFrame, DataFrame]:
    """The commonest repeated lines (line, first), and of all others what goes: id and the line numbers."""
    found = materialize(suspects(spark, docs, min_chars, broadcast_bytes).withColumn("at", F.struct(F.col("id").isNull().alias("last"), "id", "pos")))
    lines = materialize(found.groupBy("line").agg(F.min("at").alias("first"), F.max("at").alias("final"), F.count("*").alias("n")).where("first != final").select("line", "first", F.floor(F.log2("n")).cast("int").alias("e"), (F.octet_length("line") <= HOT_BYTES).alias("short")))
    # lines by the power of two of their number: the commonest powers that together stay within the bound
    room, least = hot_lines, 64
    for r in sorted(lines.where("short").groupBy("e").count().collect(), key=lambda r: -r.e):
        room -= r["count"]
        if room < 0:
            break
        least = r.e
    is_hot = F.col("short") & (F.col("e") >= least)
    hot = lines.where(is_hot).select("line", "first")
    others = found.join(F.broadcast(hot.select("line")), "line", "left_anti")
    lost = others.join(lines.where(~is_hot).select("line", "first"), "line").where("at != first").groupBy("id").agg(F.collect_set("pos").alias("gone"))
    return hot, lost


def _remover(spark: SparkSession, hot: DataFrame, touched=None, segments: int = 0):
    """A function of (text, id, gone, hash of id): the text without the lines at ``gone`` and without hot ones that stand
    elsewhere first, how many went, and whether the filter ``touched`` may hold the id."""
    table = hot.select("line", F.col("first.id").alias("id"), F.col("first.pos").alias("pos")).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((table.column("line").combine_chunks(), table.column("id").combine_chunks(), table.column("pos").combine_chunks()))

    def piece(text: pa.Array, ids: pa.Array, gone: pa.Array) -> tuple[pa.Array, np.ndarray]:
        known, first_id, first_pos = shared.value
        n = len(text)
        lists = pc.split_pattern(text, "\n")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = lists.flatten()
        doc = np.repeat(np.arange(n), size)
        pos = np.arange(at[-1]) - at[doc]
        out = np.zeros(at[-1], bool)
        if len(known):
            which = pc.index_in(flat, known)
            hit = np.flatnonzero(pc.is_valid(which).to_numpy(zero_copy_only=False))
            if len(hit):
                which = which.take(pa.array(hit))
                mine, its = ids.take(pa.array(doc[hit])), first_id.take(which).cast(ids.type)
                same = pc.fill_null(pc.equal(mine, its), False).to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(mine), pc.is_null(its)).to_numpy(zero_copy_only=False)
                out[hit] = ~(same & (pos[hit] == first_pos.take(which).to_numpy(zero_copy_only=False)))
        many = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
        if many.sum():
            own = np.repeat(np.arange(n), many)
            p = gone.flatten().to_numpy(zero_copy_only=False)
            inside = p < size[own]  # rows that share an id needn't have as many lines
            out[at[own[inside]] + p[inside]] = True
        lost = np.bincount(doc[out], minlength=n)
        touched = np.flatnonzero(lost)
        if not len(touched):
            return text, lost
        stay = (lost[doc] > 0) & ~out
        offs = np.concatenate([[0], np.cumsum((size - lost)[touched])])
        left = pc.binary_join(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat.filter(pa.array(stay))), pa.scalar("\n", text.type))
        return pc.replace_with_mask(text, pa.array(lost > 0), left), lost

    @F.arrow_udf("struct<text: string, n: int, more: boolean>")
    def remove(text: pa.Array, ids: pa.Array, gone: pa.Array, h: pa.Array) -> pa.Array:
        texts, counts = [], []
        for lo, hi in pieces(buffers(text)[1]):
            new, lost = piece(text.slice(lo, hi - lo), ids.slice(lo, hi - lo), gone.slice(lo, hi - lo))
            texts.append(new)
            counts.append(lost)
        more = bloom.probe(touched.value, segments, h.to_numpy(zero_copy_only=False)) if touched else np.zeros(len(h), bool)
        return pa.StructArray.from_arrays([pa.concat_arrays(texts) if texts else text, pa.array(np.concatenate(counts) if counts else [], pa.int32()), pa.array(more)], ["text", "n", "more"])

    # evaluated once a row: else the filters on what it returns would run it again
    return remove.asNondeterministic()


def _without(spark: SparkSession, docs: DataFrame, min_chars: int, broadcast_bytes: int, hot_lines: int, names: list[str]) -> DataFrame:
    """docs with a struct column of the text that stays and the number of lines that went."""
    modest(spark)
    new, key, gone = names
    hot, lost = repeated(spark, docs, min_chars, broadcast_bytes, hot_lines)
    lost = materialize(lost.select(F.col("id").alias(key), F.col("gone").alias(gone)))
    text, own = field("text").cast("string"), field("doc_id")
    n = lost.count()
    segments = bloom.segments_for(n)
    filters = bloom.members(lost.select(F.xxhash64(key)), segments)
    if bloom.size(filters) > broadcast_bytes:
        both = docs.join(lost, own.eqNullSafe(F.col(key)), "left")
        return both.withColumn(new, _remover(spark, hot)(text, own, F.col(gone), F.xxhash64(own))).drop(key, gone)
    # one pass settles the documents that the filter doesn't hold; the others are read again, and meet their removals
    aside = docs.withColumn(new, _remover(spark, hot, bloom.shared(spark, filters), segments)(text, own, F.lit(None).cast("array<int>"), F.xxhash64(own)))
    aside = aside.where(~F.col(new)["more"])
    if n == 0:
        return aside
    # written, so that no task has two Python processes at a time
    some = materialize(docs.where(bloom.maybe(spark, filters, segments)(F.xxhash64(own))))
    both = some.join(lost, own.eqNullSafe(F.col(key)), "left")
    return aside.unionByName(both.withColumn(new, _remover(spark, hot)(text, own, F.col(gone), F.xxhash64(own))).drop(key, gone))


def dedup(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """docs without the repeated lines; a document left blank is dropped."""
    names = free(docs, "gl_new", "gl_id", "gl_gone")
    done = _without(spark, docs, min_chars, broadcast_bytes, hot_lines, names)
    new = F.col(names[0])
    stays = done.where((new["n"] == 0) | F.rlike(new["text"], F.lit(r"[^ \t\n\x0B\f\r]")))
    return with_text(stays, new["text"]).select(*[field(c) for c in docs.columns])


def report(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, the text that stays, and how many lines went, for every document that isn't dropped."""
    own = docs.select(field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    out = _without(spark, own, min_chars, broadcast_bytes, hot_lines, ["new", "lost_id", "gone"]).select("doc_id", "new.text", F.col("new.n").alias("n_removed"))
    return out.where((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^ \t\n\x0B\f\r]")))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
ranked AS (
  SELECT doc_id, pos, line, length(line) >= {MIN_CHARS} AND regexp_matches(line, '[^ \\t\\x0B\\f\\r]') AS counts,
         row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) AS nth
  FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT counts OR nth = 1) AS text,
         CAST(count(*) FILTER (WHERE counts AND nth > 1) AS INTEGER) AS n_removed
  FROM ranked GROUP BY doc_id)
SELECT doc_id, text, n_removed FROM kept
WHERE n_removed = 0 OR regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')
"""
