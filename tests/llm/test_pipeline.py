"""Every stage against its own brute force on the stage's own input, then the whole run."""

import corpus_pipeline as cp
import pytest

from gatelight.llm import linededup, minhash, packing, suffix, toxicity
from gatelight.llm.tables import read

from .test_linededup import brute as brute_lines
from .test_minhash import jaccard, shingle_set
from .test_packing import check
from .test_suffix import brute as brute_matches


def pairs(df):
    return sorted(str((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = read(spark, small, "documents"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        out.append((docs, spark.read.parquet(str(folder / name))))
        docs = out[-1][1]
    return out


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_toxicity(spark, small, stages):
    before, after = stages[0]
    scored = toxicity.scored(spark, before, read(spark, small, "labels"))
    assert pairs(after) == pairs(before.join(scored.where("not is_toxic").select("doc_id"), "doc_id"))


def test_lines(stages):
    before, after = stages[1]
    assert pairs(after) == brute_lines([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], linededup.MIN_CHARS)


def test_near(stages):
    before, after = stages[2]
    sets = {r.doc_id: shingle_set(r.text) for r in before.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    alike = [(a, b, j) for a in sets for b in sets if a < b and sets[a] and (j := jaccard(sets[a], sets[b])) >= minhash.LEAST]
    missed = [j for a, b, j in alike if a in kept and b in kept]
    # tables are made to find nine in ten at the threshold, and nearly all from 0.6 on
    assert kept <= set(sets) and len(missed) <= 0.1 * len(alike) and sum(j >= 0.6 for j in missed) <= 0.05 * sum(j >= 0.6 for _, _, j in alike)
    touched = {i for a, b, _ in alike for i in (a, b)}
    assert set(sets) - kept <= touched  # none goes without a near-duplicate


def test_leaks(spark, small, stages):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()]
    starts = {tuple(t.split()[i : i + suffix.LEAST_ITEM]) for _, t in items for i in range(len(t.split()))}
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    maybe = [(i, t) for i, t in rows if any(tuple(w[k : k + suffix.LEAST_ITEM]) in starts for w in [(t or "").split()] for k in range(len(w)))]
    dirty = {i for i, _ in brute_matches(maybe, items)}
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _ in rows} - dirty and dirty


def test_bins(spark, small, stages):
    before, after = stages[4]
    check(before, after.collect(), packing.CAPACITY)
    run = cp.run(spark, small)
    assert sorted(d for b in run.select("doc_ids").collect() for d in b.doc_ids) == sorted(d for b in after.select("doc_ids").collect() for d in b.doc_ids)


def test_odd_rows(spark, odd_docs, no_docs, labels, bench_items, tmp_path):
    """What stays of odd rows after each stage: null, blank and long texts, repeated rows, null ids."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    blank = [(3, None), (4, ""), (5, "  \n\t ")]
    kept = {
        "toxicity": lambda i, t: True,  # four labels tell nothing, so no document has more than the base rate
        "line_dedup": lambda i, t: i != 2,  # its only line stands in document 1, whose two rows count as one
        "near_dedup": lambda i, t: True,
        "decontamination": lambda i, t: i != 1,
    }
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    docs, show = odd_docs, lambda table: sorted(map(str, table))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns
        rows = [(i, t) for i, t in rows if kept[name](i, t)]
        if name == "line_dedup":
            rows = [(i, "line one is long enough\nother line of text" if i == 9 else t) for i, t in rows]
        if name == "near_dedup":
            rows.remove(next(r for r in rows if r[0] == 1))  # one of its rows
        assert show((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) == show(rows), name
    assert set(blank) <= set(rows) and sum(i is None for i, _ in rows) == 2
    bins = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check(docs, bins, packing.CAPACITY)
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
