"""Every audit query with SQL gives the SQL's rows; the entry works without the llm folders."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from gatelight import oracle, queries

from .conftest import ROOT


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name in oracle.SQL:
        want = duck.execute(oracle.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_llm(tmp_path, pipeline):
    """With both llm folders deleted, with and without the pipeline's file: the entry works and the other tests run."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"]))
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=skip)
    env = os.environ | {"PYTHONPATH": str(root)}
    code = "import __spark_entry__ as e; n = set(e.queries()); assert 'text_depth' in n and 'pipeline' not in n and not any(x.startswith('op1_') for x in n); assert set(e.oracle_sql()) <= n; print(e.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=env, capture_output=True, text=True).stdout
    assert out.startswith(str(root))
    run = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"]
    every = subprocess.run([*run, "--collect-only"], cwd=root, env=env, capture_output=True, text=True)
    assert every.returncode == 0 and "error" not in every.stdout.lower().split("\n")[-2]
    if pipeline:
        some = subprocess.run([*run, "-k", "text_depth or decision or test_phrases or test_registry or test_diff or test_leaders"], cwd=root, env=env, capture_output=True, text=True)
        assert some.returncode == 0, some.stdout[-2000:]


def test_nothing_imports_llm():
    for base, _, files in os.walk(os.path.join(ROOT, "gatelight")):
        if os.sep + "llm" not in base:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(base, f), encoding="utf-8").read(), f
