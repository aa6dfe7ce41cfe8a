"""Registered queries against their SQL, on the smallest tables."""

import collections
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from outlens.queries import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Seeded or iterative: no SQL says the same.
WITHOUT_SQL = {"score_min_cov_det", "gaussian_mixture", "stream_damped"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, list):
        return tuple(map(cell, v))
    if isinstance(v, int | float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    rows = df.collect()
    sql = all_oracles().get(name)
    if not sql:
        # Held against planted rows and closed forms in test_operators and test_streaming.
        assert name in WITHOUT_SQL and len(rows) > 0 and df.columns
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(c) for c in sorted(names)]
    theirs = [names.index(c) for c in sorted(names)]
    got = collections.Counter(tuple(cell(r[i]) for i in order) for r in rows)
    assert got == collections.Counter(tuple(cell(r[i]) for i in theirs) for r in found.fetchall())


ON_EXECUTORS = """
from pyspark.sql import SparkSession
from outlens.queries import all_queries
spark = SparkSession.builder.config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").master("local-cluster[2,1,1024]").getOrCreate()
for _ in range(2):
    print(sorted(tuple(r) for r in all_queries()["source_jdbc"](spark, {!r}).repartition(4).collect()))
spark.stop()
"""


def test_jdbc_on_executors_of_their_own(sf, tmp_path, duck):
    run = subprocess.run([sys.executable, "-c", ON_EXECUTORS.format(sf)], env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    want = duck.execute("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0 ORDER BY 1").fetchall()
    assert run.returncode == 0, run.stderr[-2000:]
    assert [x for x in run.stdout.splitlines() if x.startswith("[(")] == [str(want)] * 2


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
