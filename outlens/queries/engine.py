"""Queries of sources, sinks, configured pipelines and the remaining rules of the dialect and of DIFF."""

from __future__ import annotations

import functools
import http.server
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.metrics import Metric, corrected_risk_ratio, support
from ..operators import classify as c
from ..operators import summarize
from ..operators.diff import diff, diff_join, split
from ..operators.lattice import explain
from ..plans.pipelines import Config, pipeline
from ..plans.session import Session
from ..sources.files import dump_flags, preview, read_csv_metrics, write_csv, write_json
from ..sources.loaders import loader, read_jdbc, read_rest
from . import oracle as o
from .explain import CUBE, HIGH, LINES, RAW, THREE, cube, order_lines, query, rounded, session, table
from .sql import shared_folder


# Sources and sinks.
@query("SELECT r_name, CAST(r_regionkey AS DOUBLE) AS r_regionkey FROM region WHERE r_regionkey > 1")
def sql_import(spark, d):
    path = f"{shared_folder(spark)}/region"
    write_csv(table(spark, d, "region"), path)
    s = Session(spark)
    s.sql(f"IMPORT FROM CSV FILE '{path}' INTO regions(r_name string, r_regionkey double)")
    return s.sql("SELECT r_name, r_regionkey FROM regions WHERE r_regionkey > 1")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sql_into_outfile(spark, d):
    path = f"{shared_folder(spark)}/nations"
    session(spark, d, "nation").run(f"SELECT n_nationkey, n_name INTO OUTFILE '{path}' FIELDS TERMINATED BY ';' FROM nation WHERE n_regionkey = 2")
    return spark.read.option("header", True).option("sep", ";").csv(path)


@query("SELECT p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_partkey % 10 <> 0")
def csv_skips_bad_metrics(spark, d):
    path = f"{shared_folder(spark)}/parts"
    write_csv(table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("p_size")), path)
    return read_csv_metrics(spark, path, ["p_brand"], ["p_size"])


@query("SELECT s_name, s_acctbal FROM supplier")
def loader_by_name(spark, d):
    path = f"{shared_folder(spark)}/suppliers"
    write_csv(table(spark, d, "supplier"), path)
    return loader("CSV")(spark, path, ["s_name"], ["s_acctbal"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 10 OFFSET 5")
def source_offset(spark, d):
    return preview(table(spark, d, "part").select("p_partkey", "p_brand").orderBy("p_partkey"), {"p_brand": "Brand#11"}, 10, 5)


@query("SELECT c_acctbal > 9000 AS flag, c_custkey FROM customer")
def dump_classified(spark, d):
    path = f"{shared_folder(spark)}/flags"
    rows = c.predicate_classify(table(spark, d, "customer"), "c_acctbal", ">", 9000.0).select("c_custkey", c.OUTLIER)
    dump_flags(rows, path)
    return spark.read.schema("flag boolean, c_custkey long").json(path)


@query("SELECT r_regionkey, r_name FROM region")
def json_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/regions"
    write_json(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return spark.read.schema(table(spark, d, "region").select("r_regionkey", "r_name").schema).json(path)


@query("SELECT n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def source_rest(spark, d):
    """CSV from an HTTP service, here one of this process."""
    text = "n_name,n_regionkey,more\n" + "".join(f"{r.n_name},{r.n_regionkey},x\n" for r in table(spark, d, "nation").collect())

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            """Quiet."""

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        out = read_rest(spark, f"http://127.0.0.1:{server.server_address[1]}/nations", {"n_regionkey": "double"}, ["n_name", "n_regionkey"], params={"all": 1})
        server.shutdown()
    return out


@query("SELECT R_REGIONKEY, R_NAME FROM (SELECT CAST(r_regionkey AS INTEGER) AS R_REGIONKEY, r_name AS R_NAME FROM region) q WHERE R_REGIONKEY > 0")
def source_jdbc(spark, d):
    """A database that every executor has a copy of, as this process cannot serve one."""
    rows = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("R_REGIONKEY"), F.col("r_name").alias("R_NAME"))
    # The dialect's CLOB cannot be compared, so text has a length.
    url = _shipped_derby(spark, rows, "REGION", "R_REGIONKEY INTEGER, R_NAME VARCHAR(40)")
    return read_jdbc(spark, url, "SELECT * FROM REGION WHERE R_REGIONKEY > 0;", ["R_REGIONKEY", "R_NAME"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def _shipped_derby(spark, rows, name: str, columns: str) -> str:
    """The URL of a read-only database with one table, in a jar that Spark sends to its executors."""
    database = f"outlens_{uuid.uuid4().hex}"
    folder = Path(tempfile.mkdtemp(prefix="derby-"))
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    connection = manager.getConnection(f"jdbc:derby:{folder / database};create=true")
    connection.createStatement().execute(f"CREATE TABLE {name} ({columns})")
    insert = connection.prepareStatement(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows.columns))})")
    for row in rows.toLocalIterator():
        for i, x in enumerate(row, 1):
            insert.setObject(i, x)
        insert.executeUpdate()
    connection.close()
    try:
        manager.getConnection(f"jdbc:derby:{folder / database};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what an orderly end of one database raises
            raise
    jar = folder / f"{database}.jar"
    with zipfile.ZipFile(jar, "w") as z:
        for f in sorted((folder / database).rglob("*")):
            z.write(f, f.relative_to(folder))
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{database}"


# Column functions.
@query("SELECT c_custkey, 2 * c_acctbal AS twice FROM customer WHERE 2 * c_acctbal > 10000")
def udf_registered(spark, d):
    udfs.register("doubled", lambda df, column, to: df.withColumn(to, 2 * F.col(column)))
    return session(spark, d, "customer").sql("SELECT c_custkey, Doubled(c_acctbal) AS twice FROM customer WHERE twice > 10000")


@query(f"WITH a AS ({o.r6('lineitem', 'l_extendedprice', [2, 98])}) SELECT round(p0, 6) AS low, round(p1, 6) AS high FROM a")
def percentile_cutoffs(spark, d):
    return rounded(spark.createDataFrame([c.percentile_cutoffs(table(spark, d, "lineitem"), "l_extendedprice", 2.0)], "low double, high double"))


@query(
    f"""WITH cut AS ({o.r6("part", "p_retailprice", [10, 90])}) SELECT p_partkey,
        CASE WHEN p_retailprice <= p0 THEN 'p_retailprice:[-inf,' || printf('%.6g', p0) || ']' WHEN p_retailprice <= p1 THEN 'p_retailprice:[' || printf('%.6g', p0) || ',' || printf('%.6g', p1) || ']'
        ELSE 'p_retailprice:[' || printf('%.6g', p1) || ',inf]' END AS p_retailprice_a FROM part, cut"""
)
def metric_bucket_names(spark, d):
    return c.bucket_metric(table(spark, d, "part"), ["p_retailprice"]).select("p_partkey", "p_retailprice_a")


# DIFF.
_NULLS = "SELECT CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS flag, CASE WHEN l_quantity <> 7 THEN l_linestatus END AS status, CASE WHEN l_extendedprice > 60000 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem"


@query(
    "SELECT * FROM (" + o.lattice(f"SELECT coalesce(flag, 'null') AS flag, coalesce(status, 'null') AS status, o, n FROM ({_NULLS}) q", ["flag", "status"], 0.001, 1.02, "risk_ratio", 2) + ") r"
)
def diff_null_values(spark, d):
    """Null values are values, and told from absent attributes."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") != 7, F.col("l_linestatus")).alias("status"), "l_extendedprice")
    out = diff(split(rows, F.expr("l_extendedprice > 60000")), ["flag", "status"], min_support=0.001, min_ratio=1.02, ratio="risk_ratio", max_combo=2, with_present=True)
    shown = [F.when(F.array_contains("present", a), F.coalesce(a, F.lit("null"))).alias(a) for a in ("flag", "status")]
    return rounded(out.select(*shown, *[x for x in out.columns if x not in ("flag", "status", "present")]))


@query("SELECT l_returnflag, 1.0::DOUBLE AS support, 1.0::DOUBLE AS global_ratio, 1.0::DOUBLE AS outlier_count, 1.0::DOUBLE AS total_count FROM lineitem WHERE l_extendedprice > 1e9")
def diff_without_outliers(spark, d):
    return diff(split(table(spark, d, "lineitem"), F.expr("l_extendedprice > 1e9")), ["l_returnflag"])


@query("SELECT n_name, 1.0::DOUBLE AS support, 1.0::DOUBLE AS global_ratio, 1.0::DOUBLE AS outlier_count, 1.0::DOUBLE AS total_count FROM nation WHERE n_nationkey < 0")
def diff_join_without_candidates(spark, d):
    customers = table(spark, d, "customer").select("c_acctbal", F.col("c_nationkey").alias("key"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return diff_join(customers.where("c_acctbal > 7000"), customers.where("c_acctbal < 3000"), nations, "key", ["n_name"], min_support=0.01, min_ratio=100.0)


@query(o.lattice("SELECT n_name, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS o, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 7000 OR c_acctbal < 3000", ["n_name"], 0.01, 1.05))
def diff_join_number_key(spark, d):
    customers = table(spark, d, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("key"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("key"), "n_name")
    return rounded(diff_join(customers.where("c_acctbal > 7000").select("key"), customers.where("c_acctbal < 3000").select("key"), nations, "key", ["n_name"], min_support=0.01, min_ratio=1.05))


@query(
    f"""WITH b AS ({LINES}), t AS (SELECT sum(o) AS oa, count(*) AS na FROM b), g AS (SELECT l_returnflag, o_orderpriority, sum(o) * 1.0 AS o, count(*) * 1.0 AS n FROM b GROUP BY GROUPING SETS ((l_returnflag), (o_orderpriority))),
        r AS (SELECT g.*, (o / n) / ((oa - o) / (na - n)) - 2 * sqrt((n - o) / o / n + 1 / (na - n)) AS ratio FROM g, t WHERE o / oa >= 0.01)
        SELECT l_returnflag, o_orderpriority, round(ratio, 6) AS corrected FROM r WHERE ratio >= 0.9"""
)
def metric_corrected_ratio(spark, d):
    metrics = [Metric("support", support(), 0.01, monotone=True), Metric("corrected", corrected_risk_ratio, 0.9)]
    rows = split(order_lines(spark, d), F.expr(HIGH))
    out = explain(rows, ["l_returnflag", "o_orderpriority"], {"outliers": F.col("outlier_col"), "count": F.lit(1.0)}, metrics, max_order=1)
    return rounded(out.select("l_returnflag", "o_orderpriority", "corrected"))


@query(
    f"""WITH q AS ({CUBE}), w AS (SELECT sum(cnt) AS n, sum(mean * cnt) / sum(cnt) AS m, sum((std * std + mean * mean) * cnt) / sum(cnt) AS m2 FROM q)
        SELECT coalesce(sum(cnt), 0.0)::DOUBLE AS n FROM q, w WHERE abs(mean - m) > 0.02 * sqrt(m2 - m * m)"""
)
def explain_mean_outliers(spark, d):
    return spark.createDataFrame([(float(summarize.mean_outlier_count(cube(spark, d), "cnt", "mean", "std", 0.02)),)], "n double")


# Pipelines by configuration.
_LINE_FLAGS = "SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS o, 1 AS n FROM lineitem"
_RENAMED = {"support": "support", "global_ratio": "global_ratio", "outliers": "outlier_count", "count": "total_count"}


def _lines_config(d, **more) -> Config:
    values = {"inputURI": f"parquet://{d}/lineitem.parquet", "attributes": ["l_returnflag", "l_linestatus"], "metric": "l_quantity", "classifier": "predicate", "predicate": ">", "cutoff": 45.0, "minSupport": 0.02, "minRatioMetric": 1.0001}
    return Config(values | more)


def _named(rows, attributes):
    return rounded(rows.select(*attributes, *[F.col(a).alias(b) for a, b in _RENAMED.items()]))


@query(o.lattice(_LINE_FLAGS, ["l_returnflag", "l_linestatus"], 0.02, 1.0001))
def pipeline_batch(spark, d):
    return _named(pipeline(_lines_config(d)).run(spark).rows, ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag, l_linestatus, printf('%.3f', support) AS support, printf('%.3f', risk_ratio) AS risk_ratio, printf('%.3f', outlier_count) AS outliers FROM (" + o.lattice(_LINE_FLAGS, ["l_returnflag", "l_linestatus"], 0.02, 1.0001, "risk_ratio").replace("round(s, 6)", "s").replace("round(r, 6)", "r") + ") q")
def pipeline_results(spark, d):
    """What the explanation's JSON holds."""
    found = pipeline(_lines_config(d, ratioMetric="risk_ratio")).run(spark).results()
    rows = [(*(x["matcher"].get(a) for a in ("l_returnflag", "l_linestatus")), x["metric"]["support"], x["metric"]["risk_ratio"], x["aggregate"]["outliers"]) for x in found]
    return spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, support string, risk_ratio string, outliers string")


@query(o.lattice(RAW, THREE, 0.02, 1.05))
def pipeline_cube(spark, d):
    path = f"{shared_folder(spark)}/cube"
    order_lines(spark, d).groupBy(*THREE).agg(F.count_if(F.expr(HIGH)).cast("double").alias("o"), F.count("*").cast("double").alias("n")).write.parquet(path)
    values = {"pipeline": "CubePipeline", "inputURI": f"parquet://{path}", "attributes": THREE, "classifier": "raw", "countColumn": "n", "outlierColumn": "o", "minSupport": 0.02, "minRatioMetric": 1.05}
    return _named(pipeline(Config(values)).run(spark).rows, THREE)


_SINGLES = """SELECT l_returnflag, l_linestatus, sum(o) * 1.0 AS o, count(*) * 1.0 AS n, 2 - grouping(l_returnflag) - grouping(l_linestatus) AS k FROM b GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))"""


@query(
    f"""WITH b AS ({_LINE_FLAGS}), t AS (SELECT sum(o) AS oa, count(*) AS na FROM b), g AS ({_SINGLES}), r AS (SELECT g.*, oa, (o / n) / ((oa - o) / (na - n)) AS ratio FROM g, t WHERE o >= trunc(oa * 0.02))
        SELECT l_returnflag, l_linestatus, round(o / oa, 6) AS support, round(ratio, 6) AS ratio FROM r WHERE ratio > 1.0001"""
)
def pipeline_fpgrowth(spark, d):
    """Single values: the two attributes decide each other, so no pair is left beside them."""
    rows = pipeline(_lines_config(d, summarizer="fpgrowth", minRiskRatio=1.0001)).run(spark).rows
    names = [F.try_element_at("items", F.lit(a)).alias(a) for a in ("l_returnflag", "l_linestatus")]
    return rounded(rows.where(F.size("items") == 1).select(*names, "support", "ratio"))


@query("SELECT CAST(10000 + i * 1000 AS DOUBLE) AS l_extendedprice, round(abs(10000 + i * 1000 - c) / s, 6) AS score FROM (SELECT unnest(range(21)) AS i) g, (SELECT avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS s FROM lineitem) z")
def pipeline_grid(spark, d):
    path = f"{shared_folder(spark)}/grid"
    values = {"pipeline": "GridPipeline", "inputURI": f"parquet://{d}/lineitem.parquet", "metrics": ["l_extendedprice"], "scorer": "ZSCORE", "ranges": {"l_extendedprice": [10000, 30000]}, "dumpPath": path}
    pipeline(Config(values)).run(spark)
    return rounded(spark.read.json(path).withColumnRenamed("_SCORE", "score"))


# The dialect.
_MORE = {
    # name: (text for the front end, tables, other text for the second engine)
    "sql_table": ("TABLE region", ("region",), "SELECT * FROM region"),
    "sql_parentheses": ("(SELECT r_name FROM region WHERE (r_regionkey > 2))", ("region",), "SELECT r_name FROM region WHERE r_regionkey > 2"),
    "sql_two_literals": ("SELECT r_name FROM region WHERE 2 > 1 AND 'a' <> 'b'", ("region",), None),
    "sql_aggregates": ("SELECT count(*) AS n, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders", ("orders",), None),
    "sql_in_query_or": ("SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1.0)", ("customer", "nation"), None),
    "sql_not_in_query_or": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 9000 OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3.0))", ("customer", "nation"), None),
    "sql_scalar_subquery": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT max(c_acctbal) - 500 AS top FROM customer)", ("supplier", "customer"), None),
    "sql_all": ("SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier)", ("supplier", "customer"), None),
    "sql_any": ("SELECT c_custkey FROM customer WHERE c_acctbal <= ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0) OR c_nationkey = SOME (SELECT n_nationkey FROM nation WHERE n_regionkey = 0.0)", ("supplier", "customer", "nation"), "SELECT c_custkey FROM customer WHERE c_acctbal <= ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0) OR c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 0.0)"),
    "sql_exists": ("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey = 1.0) AND NOT EXISTS (SELECT n_name FROM nation WHERE n_regionkey > 100)", ("region", "nation"), None),
    "join_nested": ("SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey", ("customer", "nation", "region"), None),
    "join_cross": ("SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 3", ("region", "nation"), None),
}


def _run(spark, d, text, tables):
    return session(spark, d, *tables).sql(text)


for _name, (_text, _tables, _other) in _MORE.items():
    _fn = functools.partial(_run, text=_text, tables=_tables)
    _fn.__name__ = _name
    query(_other or _text)(_fn)


@query("SELECT CAST(c_nationkey AS DOUBLE) AS key, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_double_key(spark, d):
    s = Session(spark)
    s.register("a", table(spark, d, "customer").select(F.col("c_nationkey").cast("double").alias("key"), "c_custkey"))
    s.register("b", table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("key"), "n_name"))
    return s.sql("SELECT * FROM a JOIN b USING (key)")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_text_of_trees(spark, d):
    """A parsed statement's own text means the same."""
    from ..plans.parser import parse

    return session(spark, d, "nation").sql(parse("SELECT n_nationkey, n_name FROM nation WHERE NOT (n_regionkey <> 1) AND n_nationkey IN (0, 1, 2, 3, 17, 24) OR n_regionkey = 1").sql())
