"""Every registered query of the ledger against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

from talliq.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def same(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in (r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert same(rows, df.columns) == same(got.fetchall(), names)


def test_limits_see_a_payload_of_every_event(spark, monkeypatch):
    from talliq.operators import merge

    seen, observed = [], merge.observed_limits
    monkeypatch.setattr(merge, "observed_limits", lambda frame, *a: seen.append(frame) or observed(frame, *a))
    for name in ("limits_change", "prune_preview"):
        QUERIES[name](spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert [f.count() for f in seen] == [events, events]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["talliq/llm", "tests/llm"], ["talliq/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_package(tmp_path, gone):
    """The rest imports and tells its queries; a folder that holds only caches doesn't count as the package."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name) if name.count(".") == 0 else os.remove(copy / name)
    os.makedirs(copy / "talliq/llm/__pycache__")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert got.returncode == 0, got.stderr[-2000:]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_costs_are_broadcast_and_no_python_runs(spark):
    plan = QUERIES["summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_breakdowns_are_ordered(spark):
    rows = [(r["bucket"], r["grp"]) for r in QUERIES["rollup_week_model"](spark, DATA).collect()]
    assert rows[-1][0] == "TOTAL" and rows[:-1] == sorted(rows[:-1]) and len(rows) > 3
