import itertools
import json
import math
import random
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlens.functions import stats
from outlens.operators import classify as c
from outlens.operators import contextual, density, fpgrowth, lattice, render, scoring
from outlens.operators import summarize as s
from outlens.operators.diff import diff
from outlens.operators.fpgrowth import emerging_itemsets, pruned, without_repeats
from outlens.plans.cli import server
from outlens.plans.pipelines import Config, pipeline, simple_yaml
from outlens.sources.loaders import load_uri


def r6(values, p):
    v = sorted(values)
    n = len(v)
    pos = p * (n + 1) / 100
    if pos < 1:
        return v[0]
    if pos >= n:
        return v[-1]
    k = math.floor(pos)
    return v[k - 1] + (pos - k) * (v[k] - v[k - 1])


@pytest.mark.parametrize("bracket", [100_000, 50])
def test_percentiles(spark, monkeypatch, bracket):
    monkeypatch.setattr(stats, "BRACKET", bracket)
    r = random.Random(1)
    for values in ([r.gauss(0, 1) for _ in range(1500)], [float(r.randrange(4)) for _ in range(700)], [3.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        points = [0.5, 10, 50, 99, 99.9]
        assert stats.percentiles(df, "x", points) == pytest.approx([r6(values, p) for p in points])


def test_weighted_percentile_and_rank_table(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(10)], "v double, w double")
    assert stats.weighted_percentile(df, "v", "w", 10) == 0.0
    assert stats.weighted_percentile(df, "v", "w", 90) == 9.0
    upto = {r.v: r.upto for r in stats.cumulated(df, "v", "w").collect()}
    assert upto == {float(i): 2.0 * (i + 1) for i in range(10)}


def test_normal_cdf(spark):
    df = spark.createDataFrame([(-9.0,), (-1.0,), (0.0,), (0.05,), (1.96,), (9.0,)], "z double")
    got = [r[0] for r in df.select(stats.normal_cdf(F.col("z"))).collect()]
    want = [0.5 * (1 + math.erf(z / math.sqrt(2))) for z in (-3.5, -1, 0, 0.05, 1.96, 3.5)]
    assert got == pytest.approx(want, abs=5e-4)


def test_classifiers(spark):
    df = spark.createDataFrame([(float(i), f"s{i % 3}", 2.0) for i in range(100)] + [(float("nan"), None, 1.0)], "x double, k string, n double")
    total = lambda d: d.agg(F.sum("_OUTLIER")).first()[0]
    assert total(c.percentile_classify(df, "x", 5.0)) == 10.0
    assert total(c.percentile_classify(df, "x", 5.0, include_low=False)) == 5.0
    for op, want in {"==": 1, "!=": 100, "<": 10, "<=": 11, ">": 89, ">=": 90}.items():
        assert total(c.predicate_classify(df, "x", op, 10.0)) == want
    assert total(c.predicate_classify(df, "k", "==", "s0")) == 34
    assert total(c.predicate_cube_classify(df, "n", "k", "!=", "s0")) == 66 * 2 + 1
    with pytest.raises(ValueError):
        c.predicate_classify(df, "x", "~", 1.0)
    shift = c.count_mean_shift_classify(df, "k", "n", "==", "s0", count="n").agg(F.sum("_OUTLIERCOUNT"), F.sum("_INLIERMEANSUM")).first()
    assert tuple(shift) == (68.0, 66 * 4.0 + 1)
    named = c.bucket_metric(df.where("NOT isnan(x)"), ["x"], [50.0]).groupBy("x_a").count().collect()
    assert sorted(r["count"] for r in named) == [50, 50]


def test_arithmetic_cube_without_spread(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0, 0.0), ("b", 80.0, 5.0, 0.0), ("c", 10.0, 9.0, float("nan"))], "k string, n double, m double, s double")
    low, high = c.arithmetic_cutoffs(df, "n", "m", 10)
    assert (low, high) == (1.0, 9.0)
    out = {r.k: r._OUTLIER for r in c.arithmetic_classify(df, "n", "m", "s", 15.0).collect()}
    assert out == {"a": 10.0, "b": 0.0, "c": 10.0}
    compat = {r.k: r._OUTLIER for r in c.arithmetic_classify(df, "n", "m", "s", 15.0, include_high=False, compat=True).collect()}
    assert compat["b"] == 0.0


def test_mean_explanations(spark):
    df = spark.createDataFrame([("x", 100.0, 200.0, 15.0), ("y", 300.0, 20.0, 14.0), ("z", 900.0, 28.0, 12.0)], "k string, n double, m double, s double")
    got = s.explain_mean(df, ["k"], "n", "m", "s", 0.05, 2.0).collect()
    assert [r.k for r in got] == ["x"]
    assert s.mean_outlier_count(df, "n", "m", "s", 2.0) == 100.0


def brute_itemsets(rows, attributes, support, ratio):
    from itertools import combinations

    out = [r for r in rows if r[-1]]
    n_out, n_in = len(out), len(rows) - len(out)
    has = lambda r, items: all(r[a] == v for a, v in items)
    count = lambda rs, items: sum(has(r, items) for r in rs)
    inl = [r for r in rows if not r[-1]]

    def rr(items):
        o, i = count(out, items), count(inl, items)
        e, other = o + i, n_out + n_in - o - i
        if not e or not other:
            return 0.0
        return math.inf if n_out == o else (o / e) / ((n_out - o) / other)

    singles = {frozenset([(a, r[a])]) for r in out for a in attributes}
    kept = {x for x in singles if count(out, x) >= max(1, int(n_out * support)) and rr(x) > ratio}
    found = dict.fromkeys(kept)
    values = [next(iter(x)) for x in kept]
    for k in range(2, len(attributes) + 1):
        for combo in combinations(values, k):
            if len({a for a, _ in combo}) == k and count(out, combo) >= max(1, int(n_out * support)) and rr(combo) >= ratio:
                found[frozenset(combo)] = None
    return {x: count(out, x) for x in found}


@pytest.mark.parametrize("cube", [10, 0])
def test_emerging_itemsets(spark, monkeypatch, cube):
    from outlens.operators import fpgrowth

    monkeypatch.setattr(fpgrowth, "CUBE_ATTRIBUTES", cube)
    r = random.Random(2)
    rows = []
    for _ in range(400):
        v = tuple(f"{x}{r.randrange(3)}" for x in "abc")
        rows.append((*v, 1.0 if v[:2] == ("a0", "b1") and r.random() < 0.8 or r.random() < 0.03 else 0.0))
    df = spark.createDataFrame(rows, "a string, b string, c string, o double")
    got = {frozenset(x["items"].items()): x["records"] for x in emerging_itemsets(df, ["a", "b", "c"], "o", 0.1, 1.1).collect()}
    want = brute_itemsets([dict(zip("abc", x, strict=False)) | {-1: x[3]} for x in rows], "abc", 0.1, 1.1)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    for k in set(want) - set(got):  # only repeats of a larger set with the same count go
        assert any(k < x and want[k] == got[x] for x in got)


def test_redundant_itemsets():
    f = frozenset
    assert without_repeats([(f("ab"), 5.0), (f("a"), 5.0), (f("b"), 6.0)]) == [(f("b"), 6.0), (f("ab"), 5.0)]
    sets = [{"items": {"a": 1}, "ratio": 5.0}, {"items": {"a": 1, "b": 2}, "ratio": 4.0}, {"items": {"b": 2}, "ratio": 3.0}]
    assert [x["items"] for x in pruned(sets)] == [{"a": 1}, {"b": 2}]


def test_scores(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 2 * v) for v in values], "x double, y double")
    mad = scoring.Mad.fit(df, "x")
    assert (mad.median, mad.mad) == (3.0, 1.0)
    assert [r[0] for r in df.select(mad.score()).collect()] == [2.0, 1.0, 0.0, 1.0, 97.0]
    flat = spark.createDataFrame([(1.0,)] * 9 + [(11.0,)], "x double")
    assert scoring.Mad.fit(flat, "x").mad == 0.0 or scoring.Mad.fit(flat, "x").mad > 0
    z = [r[0] for r in scoring.score(df, "ZSCORE", ["x"], "z").select("z").collect()]
    assert z == pytest.approx(list(abs(np.array(values) - 22) / np.std(values)))
    with pytest.raises(ValueError):
        scoring.score(df, "NONE", ["x"])
    scaled = [r.x for r in scoring.min_max(df, ["x"]).collect()]
    assert scaled == pytest.approx([0.01, 0.02, 0.03, 0.04, 1.0])
    assert [r.x for r in scoring.low_metric(spark.createDataFrame([(0.0,), (2.0,)], "x double"), ["x"]).collect()] == [10.0, 0.5]
    assert scoring.batch_percentile(spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (math.nan,)], "s double"), "s", 0.99).agg(F.sum("_OUTLIER")).first()[0] == 3.0


def test_min_cov_det_finds_the_far_rows(spark):
    r = np.random.default_rng(1)
    inner = r.normal(size=(400, 2))
    rows = [tuple(map(float, x)) for x in np.vstack([inner, np.full((40, 2), 12.0)])]
    df = scoring.score(spark.createDataFrame(rows, "x double, y double"), "MCD", ["x", "y"])
    far, near = df.where("x > 9").agg(F.min(scoring.SCORE)).first()[0], df.where("x <= 9").agg(F.max(scoring.SCORE)).first()[0]
    assert far > near


def test_spectra(spark):
    a = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(a,)], "v array<double>")
    got = scoring.fft(df, "v").first().v
    want = np.fft.fft([1, 2, 3, 0])
    assert got == pytest.approx(np.column_stack([want.real, want.imag]).ravel())
    wave = [math.sin(2 * math.pi * i / 8) for i in range(200)]
    corr = scoring.autocorrelation(wave, 20)
    assert corr[0] == 0.0 and 8 in scoring.peaks(corr)
    p = scoring.random_projection(df, "v", 5).first().v
    assert len(p) == 5 and p == scoring.random_projection(df, "v", 5).first().v


def test_density_and_mixture(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x),) for x in np.concatenate([r.normal(0, 1, 500), r.normal(20, 1, 100)])], "x double")
    d = density.kernel_density(df, ["x"], share=1.0)
    assert d.where("abs(x) < 0.5").agg(F.avg("_DENSITY")).first()[0] > d.where("x > 19 AND x < 21").agg(F.avg("_DENSITY")).first()[0] > 0
    m = density.mixture(df, ["x"], 2)
    sides = m.groupBy((F.col("x") > 10).alias("high")).agg(F.count_distinct("component").alias("k")).collect()
    assert all(row.k == 1 for row in sides)
    score = density.bayesian_normal_score(df, "x")
    assert score.orderBy(F.desc("_SCORE")).first().x > 18


def test_kalman_and_moving_average(spark):
    rows = [("s", float(t), 10.0 + 2 * t) for t in range(50)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    last = density.kalman(df, ["k"], "t", ["v"]).orderBy(F.desc("t")).first()
    assert last.v_estimate == pytest.approx(108.0, abs=1.0)
    scored = density.moving_average_score(spark.createDataFrame([("s", float(t), 5.0 if t < 20 else 50.0) for t in range(21)], "k string, t double, v double"), "t", ["v"], ["k"], 10)
    assert scored.orderBy(F.desc("t")).first()._SCORE == pytest.approx(9.0)


def test_contexts(spark):
    rows = [("a", float(i % 7), i) for i in range(300)] + [("b", 100.0 + i % 7, i) for i in range(300)] + [("a", 104.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, i int")
    found = contextual.contextual_outliers(df, "x", ["k"], density=0.3).collect()
    assert [(r.k, r.x, r.context) for r in found] == [("a", 104.0, "k=a")]
    dense = dict((contextual.text_of(c), n) for c, n in contextual.dense_contexts(df, ["k"], ["i"], 0.4, bins=2))
    assert dense["k=a"] == 301 and dense["k=b"] == 300
    assert ("k=a", 301) in contextual.contexts_of(df, (F.col("x") == 104.0) & (F.col("k") == "a"), ["k"], density=0.3)


def test_config():
    text = 'pipeline: "BasicBatchPipeline"\n# note\ncutoff: 1.0\nincludeHi: true\nattributes:\n  - "a"\n  - b\nquantileColumns:\n  p10: 0.1\n'
    assert simple_yaml(text) == {"pipeline": "BasicBatchPipeline", "cutoff": 1.0, "includeHi": True, "attributes": ["a", "b"], "quantileColumns": {"p10": 0.1}}
    with pytest.raises(ValueError):
        pipeline(Config({"pipeline": "None"}))


def test_pipelines_and_service(spark, tmp_path):
    r = random.Random(4)
    lines = ["x,place,kind"] + [f"{1000 if i % 20 == 0 else r.random()},{'P' if i % 20 == 0 else 'Q'},k{i % 3}" for i in range(400)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    config = {"pipeline": "BasicBatchPipeline", "inputURI": f"csv://{tmp_path}/t.csv", "classifier": "predicate", "metric": "x", "predicate": ">", "cutoff": 500.0, "attributes": ["place", "kind"], "minSupport": 0.2, "minRatioMetric": 3.0, "ratioMetric": "risk_ratio"}
    e = pipeline(Config(config)).run(spark)
    assert (e.total, e.outliers) == (400.0, 20.0)
    assert e.results()[0]["matcher"] == {"place": "P"} and e.results()[0]["metric"]["risk_ratio"] == "Infinity"
    assert "place=P" in e.text()
    fp = pipeline(Config(config | {"summarizer": "fpgrowth"})).run(spark)
    assert fp.results()[0]["matcher"] == {"place": "P"}
    http = server(spark, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}/query"
    body = json.loads(urllib.request.urlopen(urllib.request.Request(url, json.dumps(config).encode()), timeout=60).read())
    assert body["outliers"] == 20.0 and body["results"][0]["matcher"] == {"place": "P"}
    ask = lambda path, **x: json.loads(urllib.request.urlopen(urllib.request.Request(url.replace("/query", path), json.dumps({"inputURI": f"csv://{tmp_path}/t.csv"} | x).encode()), timeout=60).read())
    assert [c["name"] for c in ask("/schema")] == ["x", "place", "kind"]
    assert len(ask("/rows", columnValues={"place": "P"}, limit=5)) == 5
    assert [len(x) for x in ask("/rows/multiple", columnValues=[{"place": "P"}, {"place": "none"}])] == [20, 0]
    assert ask("/rows/fmt", columnValues={"place": "P"}, limit=1, returnType="csv")["result"].startswith("x,place,kind")
    bad = urllib.request.Request(url, b"{}")
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(bad, timeout=60)
    http.shutdown()
    with pytest.raises(ValueError):
        load_uri(spark, "ftp://x")


def test_json():
    text = render.as_json([{"matcher": {"a": "x"}, "metric": {}, "aggregate": {}}], 2.0, 1.0)
    assert json.loads(text) == {"results": [{"matcher": {"a": "x"}, "metric": {}, "aggregate": {}}], "numTotal": 2.0, "outliers": 1.0}


def test_order_statistics_share_brackets(spark, monkeypatch):
    r = random.Random(3)
    values = [float(r.randrange(50)) if r.random() < 0.5 else r.uniform(-10, 60) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [1, 2, 40, 1999, 2000, 2001, 3999, 4000]
    for bracket in (100_000, 500, 7):
        monkeypatch.setattr(stats, "BRACKET", bracket)
        assert stats.order_statistics(df, ranks, len(values)) == {k: sorted(values)[k - 1] for k in ranks}


def test_null_metrics(spark):
    df = spark.createDataFrame([(float(i),) if i % 4 else (None,) for i in range(41)] + [(float("nan"),)], "x double")
    out = scoring.winsorize(df, ["x"], 10.0).collect()
    assert sum(r.x is None for r in out) == 11 and sum(r.x is not None and math.isnan(r.x) for r in out) == 1
    low = scoring.low_metric(df, ["x"]).collect()
    assert sum(r.x is None for r in low) == 11
    mean, cov = scoring.covariance(df.withColumn("y", F.lit(1.0)), ["x", "y"])
    held = [i for i in range(41) if i % 4]
    assert mean[0] == pytest.approx(sum(held) / len(held)) and not math.isnan(cov[0, 0])
    assert density.bayesian_normal_score(df.limit(0), "x").count() == 0
    rows = [("a", float(t), None if t < 2 or t == 5 else float(t)) for t in range(9)]
    got = [r.v_estimate for r in density.kalman(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", ["v"]).orderBy("t").collect()]
    assert got[:2] == [None, None] and all(abs(g - t) < 1.5 for t, g in enumerate(got) if t > 1)


@pytest.mark.parametrize("one_pass,packed", [(10, 200_000), (0, 200_000), (0, 0)])
def test_wide_diff_by_brute_force(spark, monkeypatch, one_pass, packed):
    """Five attributes: triples are formed only where all pairs may grow, and nothing is lost by it."""
    monkeypatch.setattr(lattice, "ONE_PASS", one_pass)
    monkeypatch.setattr(lattice, "PACKED_VALUES", packed)
    r = random.Random(12)
    rows = []
    for _ in range(1500):
        v = [r.randrange(3), r.randrange(3), r.randrange(4), r.randrange(30), r.choice([0, 1, None])]
        rows.append((*[None if x is None else str(x) for x in v], float(r.random() < (0.6 if v[:3] == [1, 1, 2] else 0.1))))
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", outlier_col double")
    found = diff(df, names, min_support=0.03, min_ratio=1.6, with_present=True).collect()
    got = {tuple((n, x[n]) for n in x.present): (x.outlier_count, x.total_count) for x in found}
    total, outliers = len(rows), sum(x[-1] for x in rows)

    def counts(items):
        here = [x for x in rows if all(x[names.index(n)] == v for n, v in items)]
        return sum(x[-1] for x in here), float(len(here))

    grown, want = [{()}], {}
    for order in (1, 2, 3):
        grow = set()
        for at in itertools.combinations(names, order):
            for items in {tuple((n, x[names.index(n)]) for n in at) for x in rows}:
                if all(tuple(i for i in items if i != gone) in grown[-1] for gone in items):
                    o, n = counts(items)
                    if o / outliers >= 0.03:
                        if o / n / (outliers / total) >= 1.6:
                            want[items] = (o, n)
                        else:
                            grow.add(items)
        grown.append(grow)
    assert got == want and any(len(k) == 3 for k in want)


@pytest.mark.parametrize("cube", [10, 1])
def test_itemsets_meet_inliers(spark, monkeypatch, cube):
    """The mined sets beyond the cube have the cube's counts."""
    monkeypatch.setattr(fpgrowth, "CUBE_ATTRIBUTES", cube)
    r = random.Random(4)
    rows = [(r.choice("xy"), r.choice("pq"), r.choice("mn")) for _ in range(300)]
    df = spark.createDataFrame([(*x, float(x[0] == "x" and r.random() < 0.7 or r.random() < 0.1)) for x in rows], "a string, b string, c string, _OUTLIER double")
    marked = [(dict(zip("abc", x[:3], strict=True)), x[3]) for x in df.collect()]
    for x in fpgrowth.emerging_itemsets(df, ["a", "b", "c"], min_support=0.1, min_ratio=1.0).collect():
        held = [o for items, o in marked if all(items[k] == v for k, v in x["items"].items())]
        assert x.records == sum(held)
        rest_out, rest = sum(o for _, o in marked) - sum(held), len(marked) - len(held)
        assert x.ratio == pytest.approx((sum(held) / len(held)) / (rest_out / rest))


def test_mixture_pipeline(spark, tmp_path):
    r = random.Random(6)
    rows = [("hot", r.gauss(50, 1)) if i % 10 == 0 else (f"c{i % 3}", r.gauss(0, 1)) for i in range(600)]
    spark.createDataFrame(rows, "k string, x double").write.parquet(str(tmp_path / "in"))
    values = {"pipeline": "MixturePipeline", "inputURI": f"parquet://{tmp_path}/in", "attributes": ["k"], "metrics": ["x"], "components": 2, "minRatioMetric": 2.0}
    found = [[x["matcher"] for x in pipeline(Config(values | {"targetGroup": g})).run(spark).results()] for g in (0, 1)]
    assert [{"k": "hot"}] in found
