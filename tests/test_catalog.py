"""Every catalog query with an oracle against DuckDB on the smallest tables, and the entry points."""

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quadrille import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = Counter(tuple(map(plain, r)) for r in found.select(*columns).collect())
    if name in catalog.ORACLES:
        oracle = catalog.ORACLES[name]
        assert sorted(db.sql(oracle).columns) == columns
        assert rows == Counter(tuple(map(plain, r)) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({oracle})").fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    """The package and the entry points import where the llm folders and the pipeline are gone."""
    root = os.path.dirname(__spark_entry__.__file__)
    for item in ("__spark_entry__.py", "quadrille"):
        os.symlink(f"{root}/{item}", tmp_path / item) if item.endswith(".py") else subprocess.run(["cp", "-r", f"{root}/{item}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "quadrille" / "llm"], check=True)
    code = "import __spark_entry__ as e; assert 'range_2d' in e.queries() and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()); e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    subprocess.run(["cp", f"{root}/__spark_entry__.py", tmp_path], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
