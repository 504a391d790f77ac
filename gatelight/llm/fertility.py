"""Tokenizer fertility: how well public vocabularies fit a text, and bands outside which it is rejected.

Per document, over the whole text:

* ``chars_per_token``: characters by ids of the byte-level BPE vocabulary (``byte_bpe_50k``).
* ``fallback_share``: byte-fallback ids by all ids of the word-piece vocabulary (``piece_bpe_32k``),
  which is applied word by word.
* ``token_entropy``: Shannon entropy in bits of the document's byte-BPE ids, by the log2 of their
  number, so that it lies between 0 and 1 whatever the length; 1.0 for a single id.

Bands are kept per group: the document's ``lang``, or ``script:<name>`` (its commonest script by
characters) where lang is null or missing, together with its size class, since short texts scatter
more and entropy falls with length (class c: 4^c to 4^(c+1) - 1 ids). A band is the group's quartiles,
widened on either side by ``reach`` times their distance or ``floor``, whichever is more. Quartiles are
of all judged documents of the group, taken from an exact count of the metrics' values rounded to
1/256, so they add up over any partitioning. A group of fewer than ``least_docs`` judged documents
takes the band of its size class over all groups. With ``borrow``, as in the query, a class as small
takes in its neighbours on either side, one step more at a time, until it has so many, and at last all
documents, however few; so every judged document has a band. As longer texts have lower entropy but more
bits of it, a band of other lengths holds by whichever of the two is wider, with the classes' middle
lengths. Without ``borrow`` nothing of such a class is rejected.

* Documents of fewer than ``least_tokens`` ids are measured and never rejected, nor do they shape bands.
* A null or blank text has zero ids, null metrics and is not rejected. Ties with a band's edge are inside.
* Rows are independent: repeated ids are each measured. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .tables import field
from .tokens import byte_bpe, word_pieces
from .words import buffers, pieces

REACH, LEAST_TOKENS, LEAST_DOCS = 3.0, 32, 50
METRICS = {"chars_per_token": 0.25, "fallback_share": 0.05, "token_entropy": 0.1}
_GRID = 256
#: Bands up to so many are broadcast to the documents; beyond that (odd values of lang) they are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Scripts and their ranges of code points, letters and marks; what is in none (digits, punctuation, symbols) has no script.
_RANGES = {
    "latin": "41-5A 61-7A AA BA C0-D6 D8-F6 F8-2B8 2E0-2E4 1D00-1D25 1D6B-1D77 1D79-1D9A 1E00-1EFF 2C60-2C7F A722-A787 A78B-A7DD A7F2-A7FF AB30-AB5A AB60-AB64 AB66-AB68 212A-212B 2132 214E 2183-2184 FB00-FB06 FF21-FF3A FF41-FF5A",
    "greek": "370-373 376-377 37B-37D 37F 386 388-38A 38C 38E-3A1 3A3-3E1 3F0-3FF 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FBC 1FBE 1FC2-1FC4 1FC6-1FCC 1FD0-1FD3 1FD6-1FDB 1FE0-1FEC 1FF2-1FF4 1FF6-1FFC 1D26-1D2A 2126 AB65",
    "cyrillic": "400-484 487-52F 1C80-1C8A 1D2B 2DE0-2DFF A640-A69F", "armenian": "531-556 559-58A", "hebrew": "591-5C7 5D0-5EA 5EF-5F4 FB1D-FB36 FB38-FB3C FB46-FB4F",
    "arabic": "870-88E 610-61A 620-63F 641-64A 656-66F 671-6DC 6DE-6FF 750-77F 8A0-8E1 8E3-8FF FB50-FBB1 FBD3-FD3D FD50-FD8F FE70-FE74 FE76-FEFC", "syriac": "710-74A 74D-74F 860-86A", "thaana": "780-7B1",
    "devanagari": "900-950 955-963 966-97F A8E0-A8FF", "bengali": "980-983 985-9FE", "gurmukhi": "A01-A76", "gujarati": "A81-AFF", "oriya": "B01-B77", "tamil": "B82-BFA", "telugu": "C00-C7F", "kannada": "C80-CF3", "malayalam": "D00-D7F", "sinhala": "D81-DF4",
    "thai": "E01-E3A E40-E5B", "lao": "E81-EDF", "tibetan": "F00-FD4", "myanmar": "1000-109F A9E0-A9FE AA60-AA7F", "georgian": "10A0-10C5 10C7 10CD 10D0-10FA 10FC-10FF 1C90-1CBA 1CBD-1CBF 2D00-2D25 2D27 2D2D", "hangul": "1100-11FF 3131-318E A960-A97C AC00-D7A3 D7B0-D7FB FFA0-FFDC",
    "ethiopic": "1200-139F 2D80-2DDE AB01-AB2E", "cherokee": "13A0-13F5 13F8-13FD AB70-ABBF", "canadian": "1400-167F 18B0-18F5", "khmer": "1780-17DD 17E0-17E9", "mongolian": "1810-1819 1820-18AA",
    "kana": "3041-3096 309D-309F 30A1-30FA 30FD-30FF 31F0-31FF FF66-FF6F FF71-FF9D", "bopomofo": "3105-312F 31A0-31BF", "yi": "A000-A48C A490-A4C6", "han": "2E80-2E99 2E9B-2EF3 2F00-2FD5 3005 3007 3021-3029 3038-303B 3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 20000-323AF",
}
SCRIPTS = ("none", *_RANGES)


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Where ranges begin, in order, and the script from there on."""
    cut = [(0, 0)]
    for k, name in enumerate(_RANGES, 1):
        for part in _RANGES[name].split():
            lo, hi = (int(x, 16) for x in (part.split("-") * 2)[:2])
            cut += [(lo, k), (hi + 1, 0)]
    # a range that begins where another ends goes before that end
    cut.sort(key=lambda c: (c[0], c[1] > 0))
    return np.array([c[0] for c in cut]), np.array([c[1] for c in cut])


_FROM, _KIND = _table()


def scripts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The script number of each character of UTF-8 text, by its code point."""
    at = np.flatnonzero(begins)
    lead = data[at].astype(np.int64)
    code = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        own, p = lead[wide], at[wide]
        size = np.where(own < 0xE0, 2, np.where(own < 0xF0, 3, 4))
        value = own & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            nxt = data[np.minimum(p + k, len(data) - 1)].astype(np.int64) & 0x3F
            value = np.where(size > k, (value << 6) | nxt, value)
        code[wide] = value
    return _KIND[np.searchsorted(_FROM, code, "right") - 1]


def measure(data: np.ndarray, offs: np.ndarray, path: str | None = None) -> tuple[np.ndarray, ...]:
    """Characters, script number, byte-BPE ids, fallback share and entropy of each text."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    begins = (data & 0xC0) != 0x80
    chars = np.bincount(doc[begins], minlength=n)
    seen = np.bincount(doc[begins] * len(SCRIPTS) + scripts(data, begins), minlength=n * len(SCRIPTS)).reshape(n, -1)
    seen[:, 0] = 0
    script = np.where(seen.any(1), seen.argmax(1), 0)
    ids, size = byte_bpe(path).batch(data, offs)
    entropy = np.ones(n)
    if len(ids):
        key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), size) << np.uint64(32)) | ids.astype(np.uint64))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(at, len(key)))
        own = (key[at] >> np.uint64(32)).astype(np.int64)
        total = np.maximum(size, 1)
        bits = np.log2(total) - np.bincount(own, times * np.log2(times), n) / total
        entropy = np.where(size > 1, bits / np.log2(np.maximum(size, 2)), 1.0)
    model = word_pieces(path)
    cut, count = model.batch(data, offs)
    fallback = np.bincount(np.repeat(np.arange(n), count), model.is_byte[cut].astype(float), n) / np.maximum(count, 1)
    return chars, script, size, fallback, entropy


def _measured(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    names = pa.array(SCRIPTS)
    for batch in batches:
        data, offs = buffers(batch.column(2))
        for lo, hi in pieces(offs):
            own, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            chars, script, size, fallback, entropy = measure(own, at, path)
            none = size == 0
            part = batch.slice(lo, hi - lo)
            ratio = chars / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names.take(pa.array(script)), pa.array(size, pa.int64()), *(pa.array(np.round(x, 6), pa.float64(), mask=none) for x in (ratio, fallback, entropy))], ["doc_id", "lang", "script", "n_tokens", *METRICS])


def _grouped(found: DataFrame) -> DataFrame:
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1))) / 2 + 1e-9).cast("int")
    return found.withColumns({"band": F.coalesce("lang", F.concat(F.lit("script:"), "script")), "size_class": size})


def _lenders(by_class: DataFrame, least_docs: int) -> DataFrame:
    """size_class, lender, n: the classes whose documents make the band of each class; itself alone where it is large enough."""
    size = by_class.groupBy("size_class", "metric").agg(F.sum("n").alias("n")).groupBy("size_class").agg(F.max("n").alias("n"))
    pair = size.select("size_class").crossJoin(size.select(F.col("size_class").alias("lender"), "n")).withColumn("far", F.abs(F.col("size_class") - F.col("lender")))
    nearer = Window.partitionBy("size_class").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    return pair.withColumn("had", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where((F.col("far") == 0) | (F.col("had") < least_docs)).select("size_class", "lender", "n")


def bands(found: DataFrame, reach: float, floors: dict[str, float], least_tokens: int, least_docs: int, borrow: bool = False) -> DataFrame:
    """band and size_class, then low and high of each metric; a null band is that of all groups."""
    long = found.where(F.col("n_tokens") >= least_tokens).select("band", "size_class", F.explode(F.create_map(*[x for m in floors for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    group = ["band", "size_class", "metric"]
    counted = long.groupBy(*group, F.round(F.col("value") * _GRID).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    by_class = counted.groupBy("size_class", "metric", "bin").agg(F.sum("n").alias("n"))
    lenders = materialize(_lenders(by_class, least_docs if borrow else 0))
    # log2 of a class's middle length is 2c + 1
    scale = lenders.groupBy("size_class").agg((F.sum(F.col("n") * (2 * F.col("lender") + 1)) / F.sum("n")).alias("lent")).select("size_class", (F.col("lent") / (2 * F.col("size_class") + 1)).alias("scale"))
    lent = by_class.withColumnRenamed("size_class", "lender").join(F.broadcast(lenders.drop("n")), "lender")
    whole = lent.groupBy("size_class", "metric", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("band"), "size_class", "metric", "bin", "n")
    both = counted.unionByName(whole)
    own = Window.partitionBy(*group)
    both = both.withColumn("total", F.sum("n").over(own)).withColumn("upto", F.sum("n").over(own.orderBy("bin")))

    def quartile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) / _GRID

    cut = both.groupBy(*group).agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"), F.max("total").alias("total"))
    floor = F.coalesce(*[F.when(F.col("metric") == m, F.lit(x)) for m, x in floors.items()])
    wide = F.greatest((F.col("b") - F.col("a")) * reach, floor)
    cut = cut.where((F.lit(borrow) & F.col("band").isNull()) | (F.col("total") >= least_docs)).join(F.broadcast(scale), "size_class")
    by_length = F.when(F.col("band").isNull() & (F.col("metric") == "token_entropy"), F.col("scale")).otherwise(1.0)
    cut = cut.select(*group, ((F.col("a") - wide) * F.least(F.lit(1.0), by_length)).alias("low"), ((F.col("b") + wide) * F.greatest(F.lit(1.0), by_length)).alias("high"))
    return cut.groupBy("band", "size_class").agg(*[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{e}_{m}") for m in floors for e in ("low", "high")])


def fertility(spark: SparkSession, docs: DataFrame, reach: float = REACH, floors: dict[str, float] | None = None, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, path: str | None = None, borrow: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, band, n_tokens, the three metrics, and whether the document is rejected, for each row."""
    floors = floors or METRICS
    lang = field("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(field("doc_id").alias("doc_id"), lang.alias("lang"), field("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = own.mapInArrow(lambda it: _measured(it, path), f"doc_id {kind}, lang string, script string, n_tokens long, " + ", ".join(f"{m} double" for m in METRICS))
    found = _grouped(materialize(found))
    # some rows for each language or script; few, unless lang holds odd values
    cut = materialize(bands(found, reach, floors, least_tokens, least_docs, borrow))
    whole = cut.where("band is null").select("size_class", *[F.col(c).alias(f"all_{c}") for c in cut.columns[2:]])
    named = cut.where("band is not null")
    named = F.broadcast(named) if named.count() <= broadcast_rows else named
    both = found.join(named, ["band", "size_class"], "left").join(F.broadcast(whole), "size_class", "left")
    outside = [(F.col(m) < F.coalesce(f"low_{m}", f"all_low_{m}")) | (F.col(m) > F.coalesce(f"high_{m}", f"all_high_{m}")) for m in floors]
    rejected = F.lit(False)
    for x in outside:
        rejected = rejected | F.coalesce(x, F.lit(False))
    return both.select("doc_id", "band", "n_tokens", *METRICS, ((F.col("n_tokens") >= least_tokens) & rejected).alias("rejected"))
