import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gatelight.llm import linededup as ld

from .conftest import words

BLANK = re.compile(r"[^ \t\n\x0b\f\r]")


def brute(rows, min_chars=ld.MIN_CHARS):
    """doc_id and kept text by the docstring's rules."""
    where = {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if t is not None and len(line) >= min_chars and BLANK.search(line):
                where.setdefault(line, set()).add((i is None, i or 0, pos))
    first = {line: min(at) for line, at in where.items()}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        lines = t.split("\n")
        keep = [x for pos, x in enumerate(lines) if first.get(x, (i is None, i or 0, pos)) == (i is None, i or 0, pos)]
        if len(keep) == len(lines):
            out.append((i, t))
        elif BLANK.search("\n".join(keep)):
            out.append((i, "\n".join(keep)))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    import random

    rng = random.Random(2)
    pool = [words(rng, 6) for _ in range(60)] + ["short", "", "  \t        "]
    rows = [(1000 + i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 5, 10**6) for _ in range(rng.randint(1, 8)))) for i in range(150)]
    return odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")), allowMissingColumns=True)


@pytest.mark.parametrize("limit", [ld.BROADCAST_BYTES, -1])
def test_equals_brute_force(spark, docs, limit):
    got = ld.dedup(spark, docs, broadcast_bytes=limit)
    assert got.columns == docs.columns
    rows = got.select("doc_id", "text", "n_chars").collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in rows)


def test_suspects_hold_all_repeats_and_few_others(spark, docs):
    lines = ld._lines(docs, ld.MIN_CHARS)
    twice = {r.line for r in lines.groupBy("line").count().where("count > 1").collect()}
    found = {r.line for r in ld.suspects(spark, docs).select("line").collect()}
    assert twice <= found and len(found) <= len(twice) * 1.1 + 5


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(map(str, con.execute(ld.SQL).fetchall()))
    got = ld.report(spark, spark.read.parquet(f"{small}/documents.parquet")).select("doc_id", "text", "n_removed").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_empty(spark, no_docs):
    assert ld.dedup(spark, no_docs).count() == ld.report(spark, no_docs).count() == 0


@pytest.mark.parametrize("hot", [0, 3])
def test_cold_and_hot_lines_alike(spark, docs, hot):
    rows = ld.dedup(spark, docs, hot_lines=hot).select("doc_id", "text").collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_many_lines_in_linear_time(spark):
    import time

    lines = "\n".join(f"line number {i} of a long text" for i in range(100_000))
    docs = spark.createDataFrame([(1, lines), (2, lines + "\nand one that is its own")], "doc_id long, text string")
    ld.dedup(spark, docs.limit(0)).collect()
    for hot in (0, ld.HOT_LINES):
        began = time.time()
        assert {r.doc_id: r.text for r in ld.dedup(spark, docs, hot_lines=hot).collect()} == {1: lines, 2: "and one that is its own"}
        assert time.time() - began < 10


def test_report_with_clashing_names(spark, docs):
    clash = docs.withColumns({"new": F.lit("x"), "lost_id": F.lit(1), "gone": F.lit("y"), "line": F.lit("z"), "first": F.lit(0)})
    got = ld.report(spark, clash).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_ids_that_are_texts(spark):
    rows = [("b", "one line of some length\nother"), ("a", "one line of some length"), (None, "one line of some length\nlast line of all"), ("c", "one line of some length\nkept")]
    got = ld.dedup(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [("a", rows[1][1]), ("b", "other"), ("c", "kept"), (None, "last line of all")]))
