"""Every registered query of the library with SQL against DuckDB, and that it imports without the training-data subpackage."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from loomstead.plans.catalogue import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return f"{float(value):.4f}"
    return str(value).removesuffix(" 00:00:00")


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[names].astype(object).itertuples(index=False, name=None)), names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, names = rows_of(QUERIES[name](spark, SF).toPandas())
    want, wanted_names = rows_of(duck.sql(SQL[name]).df())
    assert names == wanted_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "loomstead", tmp_path / "loomstead", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))], done.stderr
