"""The registered queries agree with their SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from plumbline.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no standard tables here")


def plain(rows):
    same = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(same, r)) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got, want = QUERIES[name](spark, DATA), c.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_the_rest_works_without_these_operators(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline still imports, lists its queries and collects the other tests."""
    import shutil

    root = Path(__file__).resolve().parents[2]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *filter(None, [os.environ.get("PYTHONPATH")])])}
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert said.stdout.split()[1:] == ["False", "False", "True"], said.stderr
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert listed.returncode == 0 and "test_columns" in listed.stdout, listed.stdout[-2000:]
