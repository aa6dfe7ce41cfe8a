"""Sharding by a Feistel permutation of global row numbers.

Every row gets a dense global number (order: doc_id, size, checksum; nulls
first). A keyed Feistel network permutes [0, N); values that leave [0, N) are
walked along their cycle until they return. Position p goes to shard
``p mod shards`` and slot ``p div shards``, so shard counts differ by at most one
(law ``rows``), slots are gapless, and any row's place follows from its number
alone.

Defined results: a null text has no bytes (size 16, checksum 0); a null doc_id
sorts first; rows that agree in all three keys are interchangeable and get
neighbouring numbers; texts may be of any length, as only their size and checksum
travel; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import checkpointed, mix64, ship_code, text_or_empty

ROUNDS = 6
ROW_OVERHEAD = 16


def round_keys(seed: int, rounds: int = ROUNDS) -> np.ndarray:
    return mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(rows: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The permuted position in [0, n) of each row number in [0, n).

    The network works on pairs (left, right) in a x b with a*b >= n and
    a, b near sqrt(n), so at most about sqrt(n) values lie outside and walk on.
    """
    if n <= 1:
        return np.zeros_like(rows, dtype=np.int64)
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    keys = round_keys(seed, rounds)
    out = np.asarray(rows, dtype=np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + (mix64(left.astype(np.uint64) + key) % np.uint64(b)).astype(np.int64)) % b
            else:
                left = (left + (mix64(right.astype(np.uint64) + key) % np.uint64(a)).astype(np.int64)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def numbered(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``df`` with a dense global ``row_no`` in the order of ``keys``; its row count.

    One range exchange, written once so that its bounds cannot move between the
    two reads. Only one count per partition meets in a single task.
    """
    part = F.spark_partition_id().alias("_part")
    kept = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", part, F.monotonically_increasing_id().alias("_mono")))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select("_part", "_first", "_start")
    n = kept.count()
    # One row per partition: bounded by the number of partitions.
    out = kept.join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_start") + F.col("_mono") - F.col("_first"))
    return out.drop("_part", "_mono", "_first", "_start"), n


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no for every row."""
    ship_code(docs.sparkSession)
    text = text_or_empty()
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])

    @pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed))

    return rows.withColumn("_p", place("row_no")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
