"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed, quoted, ship_code

__all__ = ["SPACES", "checkpointed", "columns_of", "drop_held", "fresh", "held", "mix64", "prepare", "ship_code", "table", "text_or_empty", "unit_open", "words_of"]

#: Text rows per Arrow batch: a worker holds one batch, so this bounds its memory.
TEXT_BATCH_ROWS = 500
TEXT_BATCH_BYTES = 16 << 20

#: The ASCII whitespace that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """For Python workers: this code, and small Arrow batches, as a batch of very long texts would not fit."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


#: What a Python worker keeps between tasks: the tables of one operator at a time.
_HELD: dict = {}


def held(key, make: Callable):
    """The worker's object of this key, made once; objects of other operators go, as an executor's memory is shared."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def drop_held() -> None:
    """For operators that keep nothing between tasks."""
    _HELD.clear()


def fresh(df: DataFrame, name: str) -> str:
    """A working name that starts like ``name`` and begins no column of ``df``, whatever its case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``; names may hold dots."""
    return [F.col(quoted(c)) for c in df.columns]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; whole text, no caps."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit_open(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as doubles in the open interval (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
