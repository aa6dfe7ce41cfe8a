import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlens.operators import lattice
from outlens.operators.diff import diff, diff_join, split, star_attributes, tagged

from .brute import explain

A = ["a", "b", "c", "d"]
SCHEMA = "a string, b string, c string, d string, o double, n double"


def table(seed, n=300, values=3, weights=False):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        v = [f"{x}{r.randrange(values)}" for x in A]
        hot = v[0] == "a0" and v[1] == "b1" or v[2] == "c2" and r.random() < 0.3
        w = r.randint(1, 5) if weights else 1
        rows.append((*v, float(w if hot or r.random() < 0.05 else 0), float(w)))
    return rows


def reported(df):
    return {frozenset((a, r[a]) for a in A if r[a] is not None): (r["outlier_count"], r["total_count"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("packed", [lattice.PACKED_VALUES, 0])
@pytest.mark.parametrize("metric,support,ratio", [("global_ratio", 0.05, 1.3), ("risk_ratio", 0.02, 2.0), ("prevalence_ratio", 0.1, 1.5)])
def test_against_brute_force(spark, monkeypatch, seed, packed, metric, support, ratio):
    monkeypatch.setattr(lattice, "PACKED_VALUES", packed or -1)
    monkeypatch.setattr(lattice, "LOCAL_ROWS", packed)
    rows = table(seed, weights=seed % 2 == 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = reported(diff(df, A, "o", support, ratio, metric, 3, "n"))
    want = explain([(dict(zip(A, r[:4], strict=True)), r[4], r[5]) for r in rows], A, support, ratio, metric)
    assert got == want


def test_orders_and_dependencies(spark):
    rows = table(9)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [(dict(zip(A, r[:4], strict=True)), r[4], r[5]) for r in rows]
    for order in (1, 2):
        assert reported(diff(df, A, "o", 0.02, 1.2, max_combo=order)) == explain(plain, A, 0.02, 1.2, order=order)
    assert reported(diff(df, A, "o", 0.02, 1.2, dependencies=[{"a", "b"}])) == explain(plain, A, 0.02, 1.2, apart=[{"a", "b"}])
    with pytest.raises(ValueError):
        diff(df, A, "o", max_combo=4)
    with pytest.raises(ValueError):
        diff(df, ["nothing"], "o")


def test_edges(spark):
    none = spark.createDataFrame([("x", "y", "z", "w", 0.0, 1.0)], SCHEMA)
    assert diff(none, A, "o").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert diff(empty, A, "o").count() == 0
    # A null value is a value.
    rows = [(None, "y", "z", "w", 1.0, 1.0)] * 3 + [("x", "y", "z", "w", 0.0, 1.0)] * 9
    got = diff(spark.createDataFrame(rows, SCHEMA), ["a"], "o").collect()
    assert [(r["a"], r["outlier_count"], r["total_count"]) for r in got] == [(None, 3.0, 3.0)]


def test_infinite_risk_ratio(spark):
    rows = [("x", "y", "z", "w", 1.0, 1.0)] * 3 + [("v", "y", "z", "w", 0.0, 1.0)] * 9
    got = diff(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "o", ratio="risk_ratio").collect()
    assert [(r["a"], r["risk_ratio"]) for r in got] == [("x", math.inf)]


def test_two_inputs_and_star(spark):
    df = spark.createDataFrame(table(3), SCHEMA).drop("n")
    both = tagged(df.where("o > 0").drop("o"), df.where("o = 0").drop("o"))
    assert reported(diff(both, A, min_support=0.05)) == reported(diff(df, A, "o", 0.05))
    assert star_attributes(df) == A
    same = split(df.drop("o"), F.col("a") == "a0")
    assert same.agg(F.sum("outlier_col")).first()[0] == df.where("a = 'a0'").count()


@pytest.mark.parametrize("seed", range(3))
def test_diff_join_is_join_then_diff(spark, seed):
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(40)]
    dim = spark.createDataFrame([(k, f"p{r.randrange(4)}", f"q{r.randrange(5)}") for k in keys], "key string, p string, q string")
    side = lambda n, top: spark.createDataFrame([(keys[min(39, int(r.random() ** 2 * top))],) for _ in range(n)], "key string")
    out, inl = side(200, 20), side(400, 40)
    plain = diff(tagged(out, inl).join(dim, "key"), ["p", "q"], min_support=0.02, min_ratio=1.2)
    fast = diff_join(out, inl, dim, "key", ["p", "q"], min_ratio=1.2, min_support=0.02)
    pick = lambda df: {(x["p"], x["q"], x["outlier_count"], x["total_count"]) for x in df.collect()}
    assert pick(plain) == pick(fast)


def test_plan_prunes_columns(spark, sf):
    df = split(spark.read.parquet(f"{sf}/lineitem.parquet"), F.expr("l_extendedprice > 80000"))
    plan = df.select("l_returnflag", "outlier_col")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan
    assert isinstance(df.schema["outlier_col"].dataType, T.DoubleType)
