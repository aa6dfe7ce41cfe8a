"""Loaders by URI or by name: CSV, parquet, HTTP, JDBC and cached relations."""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import quoted
from .files import _typed, read_csv, read_csv_metrics

Loader = Callable[..., DataFrame]


def fetch(url: str, headers: dict[str, str] | None = None, params: dict | None = None, body: dict | None = None, post: bool = False, timeout: float = 60) -> str:
    """The text at a URL; certificates are checked."""
    data = None
    if post:
        data = json.dumps(body or params or {}).encode()
        headers = {"Content-Type": "application/json"} | (headers or {})
    elif params:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
    with urllib.request.urlopen(urllib.request.Request(url, data, headers or {}), timeout=timeout) as r:
        return r.read().decode("utf-8")


def read_rest(spark: SparkSession, url: str, types: dict[str, str] | None = None, required: Sequence[str] | None = None, nulls_as_text: bool = True, **request) -> DataFrame:
    """CSV text from an HTTP service; such answers are small enough for one request."""
    lines = fetch(url, **request).splitlines()
    df = spark.read.option("header", True).csv(spark.sparkContext.parallelize(lines))
    if required:
        df = df.select(*[F.col(quoted(c)) for c in df.columns if c in required])
    return _typed(df, types or {}, nulls_as_text)


def read_jdbc(
    spark: SparkSession, url: str, base_query: str, columns: Sequence[str], order_by: str | None = None, driver: str | None = None,
    partition: tuple[str, int, int, int] | None = None, properties: dict[str, str] | None = None,
) -> DataFrame:
    """Columns of a query in a database; ``partition`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({base_query.strip().rstrip(';')}) base_query")
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if driver:
        reader = reader.option("driver", driver)
    if partition:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, v)
    df = reader.load().select(*[F.col(quoted(c)) for c in columns])
    return df.orderBy(quoted(order_by)) if order_by else df


def cached(spark: SparkSession, folder: str, key: dict, load: Callable[[], DataFrame]) -> DataFrame:
    """A relation kept as parquet under a hash of what defines it."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{name}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_uri(spark: SparkSession, uri: str, types: dict[str, str] | None = None, required: Sequence[str] | None = None, **request) -> DataFrame:
    """csv://, parquet:// or http(s)://."""
    if uri.startswith("csv://"):
        return read_csv(spark, uri[len("csv://") :], types, required)
    if uri.startswith("parquet://"):
        df = spark.read.parquet(uri[len("parquet://") :])
        return df.select(*[F.col(quoted(c)) for c in required]) if required else df
    if uri.startswith(("http://", "https://")):
        return read_rest(spark, uri, types, required, **request)
    raise ValueError(f"unsupported URI: {uri}")


def _jdbc(prefix: str, driver: str) -> Loader:
    def load(spark: SparkSession, host: str, database: str, base_query: str, columns: Sequence[str], **more) -> DataFrame:
        return read_jdbc(spark, f"jdbc:{prefix}://{host}/{database}", base_query, columns, driver=driver, **more)

    return load


def _cached(inner: Loader) -> Loader:
    def load(spark: SparkSession, cache: str, base_query: str, columns: Sequence[str], order_by: str | None = None, **more) -> DataFrame:
        key = {"query": base_query, "columns": list(columns), "order_by": order_by}
        return cached(spark, cache, key, lambda: inner(spark, base_query=base_query, columns=columns, order_by=order_by, **more))

    return load


LOADERS: dict[str, Loader] = {
    "CSV": read_csv_metrics,
    "POSTGRES": _jdbc("postgresql", "org.postgresql.Driver"),
    "MYSQL": _jdbc("mysql", "com.mysql.cj.jdbc.Driver"),
    "JDBC": read_jdbc,
}
LOADERS |= {f"CACHING_{k}": _cached(LOADERS[k]) for k in ("POSTGRES", "MYSQL")}


def loader(name: str) -> Loader:
    """By name, or any callable named as ``module:function``."""
    if name in LOADERS:
        return LOADERS[name]
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"unknown loader: {name}")
    import importlib

    return getattr(importlib.import_module(module), function)
