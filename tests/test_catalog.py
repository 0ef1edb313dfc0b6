"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import normalise
from heliotab.catalog import all_queries
from heliotab.catalog.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    got = QUERIES[key](spark, SF)
    rows = got.toPandas()
    want = duck.sql(ORACLES[key]).df()
    assert sorted(rows.columns) == sorted(want.columns)
    assert len(want) > 0
    assert normalise(rows) == normalise(want)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    report = entry_point.entry(spark)
    assert report.columns[0] == "session"
    assert report.count() == 15


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_point_lives_without_the_subpackage(tmp_path, with_pipeline):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "heliotab", tmp_path / "heliotab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'Q1' in q, 'Q1' in o, 'pipeline' in q)"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": ""})
    assert ran.returncode == 0, ran.stderr
    n, *flags = ran.stdout.split()
    assert int(n) == len(all_queries()[0]) and flags == ["True", "True", "False"]
