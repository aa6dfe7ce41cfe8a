"""Queries of the relational part: SELECT, joins, column functions and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.relational import by_group, filter_rows, item_counts, project, union_all
from ..sources.files import preview, read_csv, write_csv
from ..sources.loaders import cached, load_uri
from .explain import query, rounded, session, table


SQL: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    # name: (text for the front end, tables, other text for the second engine)
    "sql_filter_project": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F'", ("orders",), None),
    "sql_not_and_or": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice <= 50000) AND (o_orderpriority >= '3' OR o_orderpriority = '1-URGENT')", ("orders",), None),
    "sql_is_distinct": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O' AND o_orderpriority IS NOT DISTINCT FROM '5-LOW'", ("orders",), None),
    "sql_literal_left": ("SELECT o_orderkey FROM orders WHERE 100000.0 < o_totalprice", ("orders",), None),
    "sql_null_tests": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> NULL AND o_totalprice IS NOT NULL", ("orders",), "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM NULL AND o_totalprice IS NOT NULL"),
    "sql_between_in_like": ("SELECT p_partkey, p_brand FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type LIKE '%S%'", ("part",), None),
    "sql_arithmetic": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS twice, -l_quantity AS less FROM lineitem WHERE l_quantity % 7 = 3 AND l_extendedprice / l_quantity > 1000", ("lineitem",), None),
    "sql_orderby_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ("orders",), None),
    "sql_subquery": ("SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) big WHERE o_orderpriority = '2-HIGH'", ("orders",), None),
    "sql_in_query": ("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000.0) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1.0)", ("customer", "orders", "nation"), None),
    "sql_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ("orders",), None),
    "sql_unknown_columns": ("SELECT o_orderkey, nothing FROM orders WHERE o_totalprice < 2000", ("orders",), "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000"),
    "sql_alias_table": ("SELECT x.c_custkey, c_acctbal AS balance FROM customer AS x WHERE x.c_acctbal < 0", ("customer",), None),
    "join_using": ("SELECT * FROM l JOIN r USING (k)", (), "SELECT c_nationkey AS k, c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_on": ("SELECT * FROM l JOIN r ON k", (), "SELECT c_nationkey AS k, c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_natural": ("SELECT * FROM l NATURAL JOIN r", (), "SELECT c_nationkey AS k, c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_left": ("SELECT * FROM r LEFT JOIN few USING (k)", (), "SELECT n_nationkey AS k, n_name, c_custkey FROM nation LEFT JOIN (SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 9900) f ON n_nationkey = c_nationkey"),
    "join_condition": ("SELECT n_name, r_name FROM nations JOIN regions ON n_regionkey = r_regionkey AND r_name <> 'ASIA'", (), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "udf_percentile": ("SELECT o_orderkey, percentile(o_totalprice) AS p FROM orders", ("orders",), "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice)) * 1.0 / count(*) OVER (), 6) AS p FROM orders"),
    "udf_normalize": ("SELECT c_custkey, normalize(c_acctbal) AS n FROM customer", ("customer",), "SELECT c_custkey, round((c_acctbal + off) / (hi + off), 6) AS n FROM customer, (SELECT CASE WHEN min(c_acctbal) > 0 THEN 0 ELSE -min(c_acctbal) END AS off, max(c_acctbal) AS hi FROM customer) m"),
    "udf_in_where": ("SELECT o_orderkey FROM orders WHERE percentile(o_totalprice) > 0.95", ("orders",), "SELECT o_orderkey FROM (SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice)) * 1.0 / count(*) OVER () AS p FROM orders) q WHERE p > 0.95"),
    "udf_alias_in_where": ("SELECT o_orderkey, percentile(o_totalprice) AS p FROM orders WHERE p < 0.02 AND o_orderstatus = 'F'", ("orders",), "SELECT o_orderkey, round(p, 6) AS p FROM (SELECT *, (rank() OVER (ORDER BY o_totalprice)) * 1.0 / count(*) OVER () AS p FROM orders) q WHERE p < 0.02 AND o_orderstatus = 'F'"),
}


def _registered(name: str, text: str, tables: tuple[str, ...], other: str | None) -> None:
    def run(spark, d):
        s = session(spark, d, *tables)
        if not tables:
            s.register("l", table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal"))
            s.register("r", table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))
            s.register("few", table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), "c_custkey"))
            s.register("nations", table(spark, d, "nation"))
            s.register("regions", table(spark, d, "region"))
        out = s.sql(text)
        return rounded(out) if name.startswith("udf") else out

    run.__name__ = name
    query(other or text)(run)


for _name, _spec in SQL.items():
    _registered(_name, *_spec)


@query("SELECT o_orderkey AS id, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def frame_union_all(spark, d):
    a = filter_rows(table(spark, d, "orders"), "o_orderstatus", "F").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return union_all([a, table(spark, d, "customer").select("c_custkey", "c_acctbal")])


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def frame_filter_project(spark, d):
    return project(filter_rows(table(spark, d, "part"), "p_size", lambda x: x > 40), ["p_partkey", "p_size", "nothing"])


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 7")
def source_preview(spark, d):
    return preview(table(spark, d, "part").orderBy("p_partkey"), {"p_brand": "Brand#11"}, 7).select("p_partkey", "p_size")


@query("SELECT 'o_orderstatus' AS attribute, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def item_count(spark, d):
    return item_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 6) AS spread FROM orders GROUP BY 1")
def group_transform(spark, d):
    def spread(rows):
        return rows.groupby("o_orderstatus", as_index=False).agg(spread=("o_totalprice", lambda x: round(x.max() - x.min(), 6)))

    return by_group(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], spread, "o_orderstatus string, spread double")


def shared_folder(spark) -> str:
    """A new folder that the executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/files-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="files-")


@query("SELECT CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name FROM region")
def csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/region"
    write_csv(table(spark, d, "region"), path)
    return read_csv(spark, path, {"r_regionkey": "double", "r_name": "string"})


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def source_cached(spark, d):
    folder = shared_folder(spark)
    load = lambda: table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    cached(spark, folder, {"table": "supplier", "of": d}, load)
    return cached(spark, folder, {"table": "supplier", "of": d}, load)


@query("SELECT n_nationkey, n_name FROM nation")
def source_parquet_uri(spark, d):
    return load_uri(spark, f"parquet://{d}/nation.parquet", required=["n_nationkey", "n_name"])
