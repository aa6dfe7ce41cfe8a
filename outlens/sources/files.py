"""Files: CSV with the dialect's typing, parquet, and sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import quoted

MAX_CELL = 16384


def _typed(df: DataFrame, types: dict[str, str], nulls_as_text: bool) -> DataFrame:
    cols = []
    for c in df.columns:
        x = F.col(quoted(c))
        if types.get(c, "string") == "double":
            x = F.coalesce(x.try_cast("double"), F.lit(float("nan")))
        elif nulls_as_text:
            x = F.coalesce(x, F.lit("NULL"))
        cols.append(x.alias(c))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, required: Sequence[str] | None = None, nulls_as_text: bool = True) -> DataFrame:
    """A CSV with a header; only declared or required columns, in the order of the file.

    ``double`` columns hold NaN where a cell is no number; any other type is a string, with
    the text NULL for a missing value unless told otherwise.
    """
    types = types or {}
    path = os.path.expanduser(path) if path.startswith("~") else path
    df = spark.read.option("header", True).option("maxCharsPerColumn", MAX_CELL).option("escape", '"').csv(path)
    wanted = list(required) if required is not None else list(types)
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns not in {path}: {missing}")
    if wanted:
        df = df.select(*[F.col(quoted(c)) for c in df.columns if c in wanted])
    return _typed(df, types, nulls_as_text)


def read_csv_metrics(spark: SparkSession, path: str, attributes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """As ``read_csv`` (plain or gzip), but rows with a metric that is no number are skipped."""
    df = spark.read.option("header", True).csv(path).select(*[F.col(quoted(c)) for c in [*attributes, *metrics]])
    numbers = {c: F.col(quoted(c)).try_cast("double") for c in metrics}
    return df.withColumns(numbers).dropna(subset=list(metrics))


def preview(df: DataFrame, equal: dict[str, str], limit: int, offset: int = 0) -> DataFrame:
    """Rows with the given values; predicates are columns, never text."""
    for c, v in equal.items():
        df = df.where(F.col(quoted(c)).cast("string") == F.lit(v))
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def write_csv(df: DataFrame, path: str, field_by: str = ",", line_by: str = "\n", one_file: bool = False) -> None:
    """CSV with a header; never over an existing path. ``one_file`` is for small results."""
    if len(field_by) != 1:
        raise ValueError("the field delimiter must be one character")
    out = df.coalesce(1) if one_file else df
    out.write.mode("errorifexists").option("header", True).option("sep", field_by).option("lineSep", line_by).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def dump_flags(df: DataFrame, path: str, outlier: str = "_OUTLIER") -> DataFrame:
    """Writes each row's flag as JSON and passes the relation on."""
    write_json(df.select((F.col(quoted(outlier)) > 0).alias("flag"), *[F.col(quoted(c)) for c in df.columns if c != outlier]), path)
    return df
