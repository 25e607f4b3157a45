"""Every registered query against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without ``lectern/llm`` and ``tests/llm``: registry, SQL, bench and flagship import; no name of theirs is left."""
    here = Path(entry.__file__).parent
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e, bench; from lectern.plans import registry; assert set(e.queries()) == set(registry.QUERIES), set(e.queries()) ^ set(registry.QUERIES); assert set(e.oracle_sql()) == set(registry.ORACLE_SQL)"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, check=False)
        assert done.returncode == 0, done.stderr
