import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from outlens.operators.diff import split
from outlens.queries import all_oracles, all_queries
from outlens.streaming import damped, windows
from outlens.streaming.incremental import IncrementalExplainer


def planted(n=3000, start=1000, end=2000, attributes=4, values=5, seed=0):
    """Rows in which (a0=1, a1=1) are outliers between ``start`` and ``end``."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.randrange(values) for _ in range(attributes)]
        hit = v[0] == 1 and v[1] == 1 and start <= i < end
        rows.append((i, *[f"a{j}:{x}" for j, x in enumerate(v)], 1.0 if hit or r.random() < 0.01 else 0.0))
    return rows


A = [f"a{j}" for j in range(4)]
KIND = "i long, a0 string, a1 string, a2 string, a3 string, outlier double"


def test_incremental_finds_the_planted_combination(spark):
    df = spark.createDataFrame(planted(), KIND)
    e = IncrementalExplainer(A, "outlier", panes=2, min_support=0.5, min_ratio=3.0)
    for pane in range(6):
        e.process(df.where((F.col("i") >= pane * 500) & (F.col("i") < (pane + 1) * 500)))
        top = [x["items"] for x in e.results()]
        want = {"a0": "a0:1", "a1": "a1:1"}
        if pane in (3,):
            assert top[0] == want
        if pane in (0, 1):
            assert want not in top
    assert len(e.tracked) < 200


def test_windowed_explain_is_a_filter_and_explain(spark):
    rows = [(x[0], *x[1:]) for x in planted()]
    df = spark.createDataFrame(rows, KIND).withColumn("t", F.timestamp_seconds("i"))
    got = windows.windowed_explain(df, "t", "1000 seconds", "500 seconds", ["a0", "a1"], "outlier", 0.5, 3.0).where("order = 2").collect()
    starts = {int(r.window_start.timestamp()) for r in got if (r.a0, r.a1) == ("a0:1", "a1:1")}
    assert 1000 in starts and 2500 not in starts
    one = df.where("i >= 1000 AND i < 2000").agg(F.sum("outlier")).first()[0]
    r = next(r for r in got if int(r.window_start.timestamp()) == 1000 and r.a0 == "a0:1")
    assert r.outliers / one == r.support


def test_sliding_aggregates(spark):
    df = spark.createDataFrame([(0, 1.0), (5, 2.0), (12, -4.0)], "s long, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {int(r.window_start.timestamp()): r.v for r in windows.sliding(df, "t", "10 seconds", "5 seconds", ["v"], "MAX").collect()}
    assert got == {-5: 1.0, 0: 2.0, 5: 2.0, 10: -4.0}


def test_structured_stream(spark, tmp_path):
    df = spark.createDataFrame(planted(), KIND).withColumn("t", F.timestamp_seconds("i"))
    for k in range(3):  # one file after another, in the order of time
        df.where(F.floor(F.col("i") / 1000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    q = windows.explain_stream(stream, "t", "500 seconds", "500 seconds", "1 second", ["a0", "a1"], "outlier", lambda d, i: found.extend(d.collect()), str(tmp_path / "ck"), 0.5, 3.0, 2, available_now=True)
    assert q.awaitTermination(120)
    assert any((r.a0, r.a1) == ("a0:1", "a1:1") for r in found)


def test_damped(spark):
    r = random.Random(3)
    rows = [(float(r.gauss(100, 1)) if i % 50 == 0 else float(r.gauss(0, 1)), "hot" if i % 50 == 0 else f"c{r.randrange(5)}", i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, k string, b int")
    found = damped.one_shot([df.where(F.col("b") == b) for b in (0, 1, 2, 3)], ["x"], ["k"], 0.98, min_support=0.05)
    assert found and found[0]["items"] == {"k": "hot"}


def test_samples_and_counters(spark):
    df = spark.createDataFrame([(i, 100.0 if i < 10 else 0.001) for i in range(1000)], "i int, w double")
    got = damped.weighted_sample(df, 10, F.col("w"))
    assert got.count() == 10 and got.where("i < 10").count() >= 9
    res = damped.DampedReservoir(50, 0.5)
    for period in range(10):
        for j in range(100):
            res.insert((period, j))
        res.advance()
    assert sum(p >= 8 for p, _ in res.entries()) > 30
    ss = damped.SpaceSaving(3)
    ss.add_all({"a": 10, "b": 5, "c": 1, "d": 1})
    assert ss.counts["a"] == 10 and len(ss.counts) == 3
    r, true, many = random.Random(2), {}, damped.SpaceSaving(20)
    for i in range(3000):
        item = min(int(r.expovariate(0.2)), 60)
        true[item] = true.get(item, 0) + 1
        many.add(item)
        if i == 1500:
            many.decay(1.0)
    assert len(many.counts) == 20 and sum(many.counts.values()) == 3000
    assert all(true[k] <= n <= true[k] + 3000 / 20 for k, n in many.counts.items())
    mc = damped.MaintainedCounter(2)
    mc.add_all({"a": 10, "b": 5, "c": 1})
    mc.end_epoch()
    mc.add_all({"c": 1})
    assert mc.counts["c"] >= 2 and mc.counts["a"] == 10
    calls = []
    tick = damped.every(3, lambda: calls.append(1))
    for _ in range(7):
        tick()
    assert len(calls) == 2


def differing(spark, folder, name, n=1_200_000):
    """Rows in which a query differs from its SQL, over ``n`` events."""
    rows = spark.range(n, numPartitions=4).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 97 AS user_id", "'view' AS event_type", "pow(id % 100003, 1.5) * (1 + id DIV 400000) AS value")
    rows.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    all_queries()[name](spark, str(folder)).write.mode("overwrite").parquet(f"{folder}/got")
    duck = duckdb.connect()
    duck.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'; CREATE TABLE want AS {all_oracles()[name]}; CREATE TABLE got AS SELECT * FROM '{folder}/got/*.parquet'")
    return [duck.execute(f"SELECT count(*) FROM (FROM {a} EXCEPT ALL FROM {b})").fetchone()[0] for a, b in (("got", "want"), ("want", "got"))]


def test_damped_scores_of_a_million_rows(spark, tmp_path):
    assert differing(spark, tmp_path, "stream_damped_scores") == [0, 0]


def test_damped_threshold_of_a_million_rows(spark, tmp_path):
    assert differing(spark, tmp_path, "stream_damped_threshold") == [0, 0]


def test_threshold_of_all_scores(spark):
    threshold = damped.DampedThreshold(0.9, capacity=None)
    flags = lambda rows: [r[0] for r in threshold.classify(spark.createDataFrame([(x,) for x in rows], "`a.b` double"), "a.b", "hit").select("hit").collect()]
    assert flags([None, float("nan")]) == [0.0, 1.0] and threshold.threshold == float("inf")
    assert flags([0.0, 1.0, 2.0, None]) == [0.0, 0.0, 1.0, 0.0] and abs(threshold.threshold - 1.8) < 1e-9
    seen = [0.0, 1.0, 2.0]
    for k in range(2):
        rows = [float(i * (k + 1)) for i in range(40)]
        seen += rows
        got = flags(rows)
        assert abs(threshold.threshold - np.quantile(seen, 0.9)) < 1e-9 and got == [float(x >= threshold.threshold) for x in rows]
    assert flags([]) == []


def test_damped_queries_draw_no_sample(spark, sf, monkeypatch):
    def drawn(*_, **__):
        raise AssertionError("a sample")

    monkeypatch.setattr(damped, "weighted_sample", drawn)
    for name in ("stream_damped_scores", "stream_damped_threshold"):
        assert all_queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("columns", [["x"], ["x", "y.z"]])
def test_scorer_fits_all_rows(spark, monkeypatch, columns):
    monkeypatch.setattr(damped.AllRows, "PARTS", 2)  # so that relations are made one on the way
    r = random.Random(5)
    scorer, seen = damped.DampedScorer(columns, capacity=None), []
    for k in range(4):
        rows = [(r.gauss(k, 1 + k), r.choice([r.gauss(0, 1), None])) for _ in range(150)] if k != 1 else []
        batch = spark.createDataFrame(rows, "x double, `y.z` double")
        got = [s[0] for s in scorer.score(batch, "s").select("s").collect()]
        seen += [v for row in rows if None not in (v := row[: len(columns)])]
        centre, spread = damped.DampedScorer._fit(np.array(seen))
        assert np.allclose(scorer.fit[0], centre) and np.allclose(scorer.fit[1], spread)
        if len(columns) == 1:
            assert np.allclose(got, [abs(x - centre[0]) / (spread[0, 0] * 1.4826) for x, _ in rows])
        assert len(scorer.reservoir.parts) <= 2


def brute_counts(batches, attributes, order, decay=0.0):
    """(outliers, inliers) of every attribute set, with earlier batches decayed; nulls are values."""
    out = {}
    for k, batch in enumerate(batches):
        weight = (1 - decay) ** (len(batches) - 1 - k)
        for row in batch:
            for size in range(1, order + 1):
                for names in combinations(attributes, size):
                    pair = out.setdefault(tuple((a, row[a]) for a in names), [0.0, 0.0])
                    pair[0 if row["outlier"] > 0 else 1] += weight
    return out


def streamed_rows(seed, n):
    r = random.Random(seed)
    rows = [(r.choice(["x", "y", None]), r.choice(["p", "q", "r", None]), float(r.random() < 0.3)) for _ in range(n)]
    return [dict(zip(("a", "b", "outlier"), row, strict=True)) for row in rows]


def frame(spark, rows):
    return spark.createDataFrame([(x["a"], x["b"], x["outlier"]) for x in rows], "a string, b string, outlier double")


def test_damped_itemsets_are_a_recount(spark):
    batches = [streamed_rows(i, 200) for i in range(3)]
    summary = damped.DampedItemsets(["a", "b"], "outlier", decay=0.1, min_support=0.001, min_ratio=-10.0)
    for rows in batches:
        summary.consume(frame(spark, rows))
    want = brute_counts(batches, ["a", "b"], 2, 0.1)
    got = {tuple(x["items"].items()): x["records"] for x in summary.results()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k][0]) < 1e-9 for k in got)
    by_key = {tuple(windows.items_of(k, ["a", "b"], 3).items()): v for k, v in summary.counts.items()}
    assert all(abs(by_key[k][1] - want[k][1]) < 1e-9 for k in want)


def test_tracked_sets_count_without_outliers(spark):
    summary = damped.DampedItemsets(["a", "b"], "outlier", decay=0.0)
    one = [{"a": "x", "b": "p", "outlier": 1.0}] * 10 + [{"a": "x", "b": "p", "outlier": 0.0}] * 5
    two = [{"a": "x", "b": "p", "outlier": 0.0}] * 1000
    for rows in (one, two):
        summary.consume(frame(spark, rows))
    assert sorted(summary.counts.values()) == [[10.0, 1005.0]] * 3


def test_incremental_sets_are_a_recount_with_nulls(spark):
    batches = [streamed_rows(10 + i, 300) for i in range(4)]
    e = IncrementalExplainer(["a", "b"], "outlier", panes=3, min_support=0.0, min_ratio=0.0, max_order=2)
    for rows in batches:
        e.process(frame(spark, rows))
    want = {k: v for k, v in brute_counts(batches[1:], ["a", "b"], 2).items() if v[0]}
    got = {tuple(x["items"].items()): x["records"] for x in e.results()}
    assert got.keys() == want.keys() and all(got[k] == want[k][0] for k in got)


def test_windowed_null_values_are_not_merged(spark):
    rows = [("x", None, 1.0)] * 3 + [(None, "p", 1.0)] * 2
    df = spark.createDataFrame(rows, "a string, b string, o double").withColumn("t", F.timestamp_seconds(F.lit(0)))
    counts = windows.windowed_counts(df, "t", "1 day", "1 day", ["a", "b"], "o").where("order = 1").collect()
    assert sorted((r.a or "", r.b or "", r["count"]) for r in counts) == [("", "", 2.0), ("", "", 3.0), ("", "p", 2.0), ("x", "", 3.0)]


def test_split_marks(spark):
    assert split(spark.range(4), F.col("id") > 1).agg(F.sum("outlier_col")).first()[0] == 2.0
