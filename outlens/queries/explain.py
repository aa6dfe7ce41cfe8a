"""Queries of the explanation engine: DIFF, classifiers, cubes, summarizers and itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as c
from ..operators import summarize as s
from ..operators.diff import diff, diff_join, split, tagged
from ..operators.fpgrowth import emerging_itemsets
from ..plans.session import Session
from . import oracle as o

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def session(spark: SparkSession, d: str, *names: str) -> Session:
    out = Session(spark)
    for n in names:
        out.register(n, table(spark, d, n))
    return out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order."""
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


THREE = ["l_returnflag", "l_linestatus", "o_orderpriority"]
FOUR = [*THREE, "p_brand"]
LINES = "SELECT l_returnflag, l_linestatus, o_orderpriority, CASE WHEN l_extendedprice > 80000 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
PARTS = "SELECT l_returnflag, l_linestatus, o_orderpriority, p_brand, CASE WHEN l_extendedprice > 80000 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
HIGH = "l_extendedprice > 80000.0"


def _lines(spark, d, **options):
    return rounded(diff(split(order_lines(spark, d), F.expr(HIGH)), THREE, **options))


@query(o.lattice(LINES, THREE, 0.02, 1.05))
def diff_global_ratio(spark, d):
    return _lines(spark, d, min_support=0.02, min_ratio=1.05)


@query(o.lattice(LINES, THREE, 0.02, 1.05, "risk_ratio"))
def diff_risk_ratio(spark, d):
    return _lines(spark, d, min_support=0.02, min_ratio=1.05, ratio="risk_ratio")


@query(o.lattice(LINES, THREE, 0.02, 1.05, "prevalence_ratio"))
def diff_prevalence_ratio(spark, d):
    return _lines(spark, d, min_support=0.02, min_ratio=1.05, ratio="prevalence_ratio")


@query(o.lattice(LINES, THREE, 0.02, 1.0001, order=1))
def diff_max_combo_1(spark, d):
    return _lines(spark, d, min_support=0.02, min_ratio=1.0001, max_combo=1)


@query(o.lattice(LINES, THREE, 0.02, 1.02, order=2))
def diff_max_combo_2(spark, d):
    return _lines(spark, d, min_support=0.02, min_ratio=1.02, max_combo=2)


@query(o.lattice(PARTS, FOUR, 0.01, 1.1))
def diff_four_attributes(spark, d):
    rows = order_lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(diff(split(rows, F.expr(HIGH)), FOUR, min_support=0.01, min_ratio=1.1))


@query(o.lattice("SELECT l_returnflag, l_linestatus, CASE WHEN l_extendedprice > 80000 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem WHERE l_extendedprice > 80000 OR l_extendedprice < 60000", ["l_returnflag", "l_linestatus"], 0.02, 1.0001))
def diff_two_arg(spark, d):
    text = """SELECT * FROM DIFF (SELECT * FROM lineitem WHERE l_extendedprice > 80000.0) outliers, (SELECT * FROM lineitem WHERE l_extendedprice < 60000.0) inliers
              ON l_returnflag, l_linestatus WITH MIN RATIO 1.0001 MIN SUPPORT 0.02"""
    return rounded(session(spark, d, "lineitem").sql(text))


@query(o.lattice("SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem", ["l_returnflag", "l_linestatus"], 0.02, 1.0001))
def diff_on_star(spark, d):
    text = "SELECT * FROM DIFF (SPLIT lineitem WHERE l_quantity > 45) ON * WITH MIN SUPPORT 0.02 MIN RATIO 1.0001"
    return rounded(session(spark, d, "lineitem").sql(text))


@query("SELECT * FROM (" + o.lattice(LINES, THREE, 0.02, 1.02) + ") q WHERE support > 0.03 AND NOT (outlier_count < 100)")
def diff_where(spark, d):
    rows = session(spark, d)
    rows.register("lines", order_lines(spark, d))
    text = "SELECT * FROM DIFF (SPLIT lines WHERE l_extendedprice > 80000) ON l_returnflag, l_linestatus, o_orderpriority WITH MIN RATIO 1.02 MIN SUPPORT 0.02 WHERE support > 0.03 AND NOT outlier_count < 100"
    return rounded(rows.sql(text))


@query("SELECT * FROM (" + o.lattice(LINES, THREE, 0.02, 1.02) + ") q ORDER BY outlier_count DESC, total_count LIMIT 3")
def diff_order_limit(spark, d):
    rows = session(spark, d)
    rows.register("lines", order_lines(spark, d))
    text = """SELECT * FROM DIFF (SPLIT (SELECT * FROM lines) WHERE l_extendedprice > 80000) ON l_returnflag, l_linestatus, o_orderpriority
              WITH MIN RATIO 1.02 MIN SUPPORT 0.02 COMPARE BY global_ratio(COUNT(*)) MAX COMBO 3 ORDER BY outlier_count DESC, total_count LIMIT 3"""
    return rounded(rows.sql(text))


@query(o.lattice("SELECT CAST(c_nationkey AS VARCHAR) AS nation, n_name, r_name, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS o, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", ["nation", "n_name", "r_name"], 0.01, 1.05, apart=[{"nation", "n_name", "r_name"}]))
def diff_fd_pruned(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("nation", F.col("c_nationkey").cast("string"))
    return rounded(diff(split(rows, F.expr("c_acctbal > 7000")), ["nation", "n_name", "r_name"], min_support=0.01, min_ratio=1.05, dependencies=[{"nation", "n_name", "r_name"}]))


JOINED = "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS o, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 7000 OR c_acctbal < 3000"


def _nation_sides(spark, d):
    customers = table(spark, d, "customer").withColumn("key", F.col("c_nationkey").cast("string"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), "n_name", F.col("n_regionkey").cast("string").alias("region"))
    return customers.where("c_acctbal > 7000").select("key"), customers.where("c_acctbal < 3000").select("key"), nations


@query(o.lattice(JOINED, ["n_name", "region"], 0.01, 1.05))
def diff_natural_join(spark, d):
    high, low, nations = _nation_sides(spark, d)
    s_ = Session(spark)
    for name, df in (("high", high), ("low", low), ("nations", nations)):
        s_.register(name, df)
    return rounded(s_.sql("SELECT * FROM DIFF (SELECT * FROM high NATURAL JOIN nations), (SELECT * FROM low NATURAL JOIN nations) ON n_name, region WITH MIN SUPPORT 0.01 MIN RATIO 1.05"))


@query(o.lattice(JOINED, ["n_name", "region"], 0.01, 1.05))
def diff_join_prefiltered(spark, d):
    high, low, nations = _nation_sides(spark, d)
    return rounded(diff_join(high, low, nations, "key", ["n_name", "region"], min_support=0.01, min_ratio=1.05))


@query(o.lattice("SELECT CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS o, 1 AS n FROM customer", ["nation", "c_mktsegment"], 0.005, 1.2))
def diff_tagged(spark, d):
    rows = table(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    return rounded(diff(tagged(rows.where("c_acctbal > 7000"), rows.where("NOT c_acctbal > 7000")), ["nation", "c_mktsegment"], min_support=0.005, min_ratio=1.2))


# Classifiers.
@query(f"WITH cut AS ({o.r6('lineitem', 'l_extendedprice', [1, 99])}) SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > p1 OR l_extendedprice < p0 THEN 1.0 ELSE 0.0 END AS outlier FROM lineitem, cut")
def classify_percentile(spark, d):
    out = c.percentile_classify(table(spark, d, "lineitem"), "l_extendedprice", 1.0, output="outlier")
    return out.select("l_orderkey", "l_linenumber", "outlier")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 1.0 ELSE 0.0 END AS outlier FROM lineitem")
def classify_predicate_double(spark, d):
    return c.predicate_classify(table(spark, d, "lineitem"), "l_quantity", ">=", 40.0, output="outlier").select("l_orderkey", "l_linenumber", "outlier")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN 1.0 ELSE 0.0 END AS outlier FROM orders")
def classify_predicate_string(spark, d):
    return c.predicate_classify(table(spark, d, "orders"), "o_orderpriority", "!=", "1-URGENT", output="outlier").select("o_orderkey", "outlier")


CUBE = """SELECT l_returnflag, l_linestatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS cnt, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std,
          min(l_extendedprice) AS lo, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, max(l_extendedprice) AS hi
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""


def cube(spark, d):
    x = "l_extendedprice"
    return order_lines(spark, d).groupBy(*THREE).agg(
        F.count("*").cast("double").alias("cnt"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"), F.min(x).alias("lo"),
        *[F.round(F.percentile(x, p), 6).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))], F.max(x).alias("hi"),
    )


_LOW, _HIGH = o.weighted("q", "mean", "cnt", 10), o.weighted("q", "mean", "cnt", 90)


@query(
    f"""WITH q AS ({CUBE}), z AS (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM q)
        SELECT l_returnflag, l_linestatus, o_orderpriority, round(CASE WHEN std = 0 THEN CASE WHEN mean > high OR mean < low THEN cnt ELSE 0 END
        ELSE cnt * (1 - {o.normal_cdf("((high - mean) / std)")}) + cnt * {o.normal_cdf("((low - mean) / std)")} END, 4) AS outliers FROM z"""
)
def cube_arithmetic(spark, d):
    return rounded(c.arithmetic_classify(cube(spark, d), "cnt", "mean", "std", 10.0, output="outliers").select(*THREE, "outliers"), 4)


_QS = [("lo", 0.0), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("hi", 1.0)]
_CELLS = " UNION ALL ".join(f"SELECT ({a} + {b}) / 2 AS v, cnt * {qb - qa} AS w FROM q" for (a, qa), (b, qb) in zip(_QS[:-1], _QS[1:], strict=True))


def _below(x: str) -> str:
    lines = " ".join(f"WHEN {x} >= {a} AND {x} <= {b} THEN {qa} + ({x} - {a}) * ({qb} - {qa}) / ({b} - {a})" for (a, qa), (b, qb) in zip(_QS[:-1], _QS[1:], strict=True))
    return f"CASE WHEN {x} <= lo THEN 0.0 WHEN {x} >= hi THEN 1.0 {lines} END"


@query(
    f"""WITH q AS ({CUBE}), cells AS ({_CELLS}), z AS (SELECT *, {o.weighted("cells", "v", "w", 10)} AS low_cut, {o.weighted("cells", "v", "w", 90)} AS high_cut FROM q)
        SELECT l_returnflag, l_linestatus, o_orderpriority, round(cnt * (1 - ({_below("high_cut")})) + cnt * ({_below("low_cut")}), 4) AS outliers FROM z"""
)
def cube_quantile(spark, d):
    return rounded(c.quantile_classify(cube(spark, d), "cnt", dict(_QS), 10.0, output="outliers").select(*THREE, "outliers"), 4)


@query(f"SELECT l_returnflag, l_linestatus, o_orderpriority, CASE WHEN mean >= 50000 THEN cnt ELSE 0 END AS outliers FROM ({CUBE}) q")
def cube_predicate(spark, d):
    return c.predicate_cube_classify(cube(spark, d), "cnt", "mean", ">=", 50000.0, output="outliers").select(*THREE, "outliers")


RAW = "SELECT l_returnflag, l_linestatus, o_orderpriority, CAST(count(*) FILTER (l_extendedprice > 80000) AS DOUBLE) AS o, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


@query(o.lattice(RAW, THREE, 0.02, 1.05))
def cube_raw(spark, d):
    rows = order_lines(spark, d).groupBy(*THREE).agg(F.count_if(F.expr(HIGH)).cast("double").alias("o"), F.count("*").cast("double").alias("n"))
    return rounded(diff(c.raw_classify(rows, "n", "o"), THREE, outlier_column="o", count_column="n", min_support=0.02, min_ratio=1.05))


MEANS = "SELECT l_returnflag, l_linestatus, o_orderpriority, cnt, mean, std FROM (" + CUBE + ") q"
_M = "abs(m1 / t - tot.m1_all / tot.t_all) / sqrt(tot.m2_all / tot.t_all - (tot.m1_all / tot.t_all) * (tot.m1_all / tot.t_all))"


def _mean_lattice(support: float, least: float) -> str:
    """As ``oracle.lattice``, with counts and moments instead of outliers."""
    text = o.lattice("SELECT l_returnflag, l_linestatus, o_orderpriority, cnt AS o, cnt AS n, mean * cnt AS m1, (std * std + mean * mean) * cnt AS m2 FROM (" + CUBE + ") q", THREE, support, least)
    text = text.replace(o.RATIOS["global_ratio"], _M).replace("sum(n) AS t FROM", "sum(n) AS t, sum(m1) AS m1, sum(m2) AS m2 FROM")
    text = text.replace("sum(n) AS t_all", "sum(n) AS t_all, sum(m1) AS m1_all, sum(m2) AS m2_all").replace(", o, n FROM b)", ", o, n, m1, m2 FROM b)")
    return text.replace("AS global_ratio, CAST(o AS DOUBLE) AS outlier_count, CAST(t AS DOUBLE) AS total_count", "AS mean_deviation, CAST(t AS DOUBLE) AS \"count\"")


@query(_mean_lattice(0.01, 0.02))
def explain_mean(spark, d):
    out = s.explain_mean(cube(spark, d), THREE, "cnt", "mean", "std", 0.01, 0.02)
    return rounded(out.select(*THREE, "support", "mean_deviation", "count"))


_SHIFT_BASE = "SELECT l_returnflag, l_linestatus, o_orderpriority, CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0 END AS oc, CASE WHEN l_quantity >= 25 THEN 0 ELSE 1.0 END AS ic, CASE WHEN l_quantity >= 25 THEN l_extendedprice ELSE 0 END AS os, CASE WHEN l_quantity >= 25 THEN 0 ELSE l_extendedprice END AS isum FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _shift_sql(base: str, support: float, least: float) -> str:
    sums = "sum(oc) AS oc, sum(ic) AS ic, sum(os) AS os, sum(isum) AS isum"
    names = ", ".join(THREE)
    filled = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in THREE)
    judged = lambda g, k: f"SELECT {g}.*, {g}.oc / tot.oc_all AS s1, {g}.ic / tot.ic_all AS s2, ({g}.os / nullif({g}.oc, 0)) / ({g}.isum / nullif({g}.ic, 0)) AS r FROM {g}, tot WHERE {filled} = {k} AND {g}.oc / tot.oc_all >= {support} AND {g}.ic / tot.ic_all >= {support}"
    grow = ", ".join(f"CASE WHEN {x} IN (SELECT {x} FROM e1 WHERE r < {least} AND {x} IS NOT NULL) THEN {x} END AS {x}" for x in THREE)
    two, three = "(l_returnflag, l_linestatus), (l_returnflag, o_orderpriority), (l_linestatus, o_orderpriority)", f"({names})"
    inside = " AND ".join(f"(p.{x} IS NULL OR p.{x} = e3.{x})" for x in THREE)
    return f"""WITH b AS ({base}), tot AS (SELECT sum(oc) AS oc_all, sum(ic) AS ic_all FROM b),
      c1 AS (SELECT {names}, {sums} FROM b GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (o_orderpriority))), e1 AS ({judged("c1", 1)}),
      b2 AS (SELECT {grow}, oc, ic, os, isum FROM b), c2 AS (SELECT {names}, {sums} FROM b2 GROUP BY GROUPING SETS ({two})), e2 AS ({judged("c2", 2)}),
      c3 AS (SELECT {names}, {sums} FROM b2 GROUP BY GROUPING SETS ({three})), e3 AS ({judged("c3", 3)}),
      found AS (SELECT * FROM e1 WHERE r >= {least} UNION ALL SELECT * FROM e2 WHERE r >= {least}
        UNION ALL SELECT * FROM e3 WHERE r >= {least} AND (SELECT count(*) FROM e2 p WHERE p.r < {least} AND {inside}) = 3)
      SELECT {names}, round(s1, 6) AS outlier_support, round(s2, 6) AS inlier_support, round(r, 6) AS mean_shift, CAST(oc AS DOUBLE) AS outlier_count, CAST(ic AS DOUBLE) AS inlier_count FROM found"""


_SHIFT_COLUMNS = [*THREE, "outlier_support", "inlier_support", "mean_shift", "outlier_count", "inlier_count"]


@query(_shift_sql(_SHIFT_BASE, 0.01, 1.01))
def explain_countmeanshift(spark, d):
    rows = c.count_mean_shift_classify(order_lines(spark, d), "l_quantity", "l_extendedprice", ">=", 25.0)
    return rounded(s.explain_mean_shift(rows, THREE, 0.01, 1.01).select(*_SHIFT_COLUMNS))


_SHIFT_CUBE = f"SELECT l_returnflag, l_linestatus, o_orderpriority, CASE WHEN q >= 25 THEN cnt ELSE 0 END AS oc, CASE WHEN q >= 25 THEN 0 ELSE cnt END AS ic, CASE WHEN q >= 25 THEN mean * cnt ELSE 0 END AS os, CASE WHEN q >= 25 THEN 0 ELSE mean * cnt END AS isum FROM (SELECT {', '.join(THREE)}, l_quantity AS q, CAST(count(*) AS DOUBLE) AS cnt, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) q"


@query(_shift_sql(_SHIFT_CUBE, 0.01, 1.01))
def explain_countmeanshift_cubed(spark, d):
    rows = order_lines(spark, d).groupBy(*THREE, "l_quantity").agg(F.count("*").cast("double").alias("cnt"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    rows = c.count_mean_shift_classify(rows, "l_quantity", "mean", ">=", 25.0, count="cnt")
    return rounded(s.explain_mean_shift(rows, THREE, 0.01, 1.01).select(*_SHIFT_COLUMNS))


@query(f"WITH cut AS ({o.r6('part', 'p_retailprice', [10, 50, 90])}) SELECT p_partkey, 'p_retailprice:' || CASE WHEN p_retailprice <= p0 THEN 0 WHEN p_retailprice <= p1 THEN 1 WHEN p_retailprice <= p2 THEN 2 ELSE 3 END AS p_retailprice_a FROM part, cut")
def metric_bucket(spark, d):
    return c.bucket_metric(table(spark, d, "part"), ["p_retailprice"], [10.0, 50.0, 90.0], simple=True).select("p_partkey", "p_retailprice_a")


# Itemsets.
_ITEMS = ["l_returnflag", "o_orderpriority", "p_brand"]


def _item_rows(spark, d):
    rows = order_lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return split(rows, F.expr(HIGH), "_OUTLIER").select(*_ITEMS, "_OUTLIER")


def _shown(df: DataFrame) -> DataFrame:
    names = [F.try_element_at("items", F.lit(a)).alias(a) for a in _ITEMS]
    return df.select(*names, F.round("records", 6).alias("records"), F.round("support", 6).alias("support"), F.round("ratio", 6).alias("ratio"))


_ITEM_BASE = "SELECT l_returnflag, o_orderpriority, p_brand, CASE WHEN l_extendedprice > 80000 THEN 1 ELSE 0 END AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_RR = "CASE WHEN t = 0 THEN 0 WHEN t_all - t = 0 THEN 0 WHEN o_all - o = 0 THEN 'Infinity'::DOUBLE ELSE (o * 1.0 / t) / ((o_all - o) * 1.0 / (t_all - t)) END"
_ONES = f"""b AS ({_ITEM_BASE}), tot AS (SELECT sum(o) AS o_all, count(*) AS t_all FROM b),
  c1 AS (SELECT {", ".join(_ITEMS)}, sum(o) AS o, count(*) AS t FROM b GROUP BY GROUPING SETS ((l_returnflag), (o_orderpriority), (p_brand))),
  e1 AS (SELECT c1.*, {_RR} AS r FROM c1, tot WHERE o >= trunc(o_all * 0.01) AND {_RR} > 1.02)"""


@query(f"WITH {_ONES} SELECT {', '.join(_ITEMS)}, CAST(o AS DOUBLE) AS records, round(o * 1.0 / o_all, 6) AS support, round(r, 6) AS ratio FROM e1, tot")
def fpgrowth_singletons(spark, d):
    return _shown(emerging_itemsets(_item_rows(spark, d), _ITEMS, "_OUTLIER", 0.01, 1.02, combinations=False))


_KEPT = ", ".join(f"CASE WHEN {x} IN (SELECT {x} FROM e1 WHERE {x} IS NOT NULL) THEN {x} END AS {x}" for x in _ITEMS)
_FULL = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in _ITEMS)


@query(
    f"""WITH {_ONES}, b2 AS (SELECT {_KEPT}, o FROM b), c2 AS (SELECT {", ".join(_ITEMS)}, sum(o) AS o, count(*) AS t, 3 - (grouping(l_returnflag) + grouping(o_orderpriority) + grouping(p_brand)) AS k FROM b2 GROUP BY CUBE ({", ".join(_ITEMS)})),
        found AS (SELECT *, {_RR} AS r FROM c2, tot WHERE k > 0 AND {_FULL} = k AND o >= greatest(1, trunc(o_all * 0.01)))
        SELECT {", ".join(_ITEMS)}, CAST(o AS DOUBLE) AS records, round(o * 1.0 / o_all, 6) AS support, round(r, 6) AS ratio FROM found WHERE k = 1 OR r >= 1.02"""
)
def fpgrowth_explain(spark, d):
    return _shown(emerging_itemsets(_item_rows(spark, d), _ITEMS, "_OUTLIER", 0.01, 1.02))
