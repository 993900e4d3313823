from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 2000


@pytest.mark.parametrize("gone", [["windrose/llm", "tests/llm", "corpus_pipeline.py"], ["windrose/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_optional_parts(tmp_path, gone):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    there = tmp_path / "repo"
    shutil.copytree(here, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = there / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import json, __spark_entry__ as e, bench; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {**os.environ, "PYTHONPATH": str(there)}
    out = subprocess.run([sys.executable, "-c", code], cwd=there, env=env, capture_output=True, text=True, check=True).stdout
    made, sql = json.loads(out.strip().splitlines()[-1])
    assert set(CORE) == {n for n in sql if not n.startswith("op")} and "pipeline" not in made and set(sql) <= set(made)
    assert any(n.startswith("op") for n in made) == ("windrose/llm" not in gone and os.path.isdir(os.path.join(here, "windrose/llm")))
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=there, env=env, capture_output=True, text=True)
    assert collected.returncode == 0 or gone == ["corpus_pipeline.py"], collected.stdout
