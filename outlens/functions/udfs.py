"""Whole-column functions of the SQL front end, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import quoted
from .stats import cumulated

ColumnFunction = Callable[[DataFrame, str, str], DataFrame]


def normalize(df: DataFrame, column: str, to: str) -> DataFrame:
    """(x + offset) / (max + offset), where the offset lifts a minimum of zero or less to zero."""
    x = F.col(quoted(column)).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    offset = 0.0 if low is None or low > 0 else -low
    return df.withColumn(to, F.try_divide(x + offset, F.lit((high or 0.0) + offset)))


def percentile(df: DataFrame, column: str, to: str) -> DataFrame:
    """The share of rows that are less, plus one row: the least rank over the number of rows."""
    x = F.col(quoted(column)).cast("double")
    table = cumulated(df.select(x.alias("_v")).withColumn("_w", F.lit(1)), "_v", "_w")
    n = df.count()
    ranked = table.select("_v", ((F.col("upto") - F.col("_w") + 1) / F.lit(float(n))).alias("_p"))
    return df.join(ranked, x.eqNullSafe(F.col("_v")), "left").withColumn(to, F.col("_p")).drop("_v", "_p")


REGISTRY: dict[str, ColumnFunction] = {"normalize": normalize, "percentile": percentile}


def register(name: str, function: ColumnFunction) -> None:
    """``function(df, column, to)`` adds the column ``to``."""
    REGISTRY[name.lower()] = function


def lookup(name: str) -> ColumnFunction:
    """Case-insensitive; of a qualified name the last part counts."""
    key = name.rpartition(".")[2].lower()
    if key not in REGISTRY:
        raise ValueError(f"unknown function: {name}")
    return REGISTRY[key]
