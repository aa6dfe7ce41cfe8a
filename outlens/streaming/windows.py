"""Event-time windows: aggregates and explanations, on batch or streaming relations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import ratio
from ..runtime import quoted

AGGREGATES: dict[str, Callable[[Column], Column]] = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min}


def sliding(df: DataFrame, time: str, length: str, slide: str, values: Sequence[str], aggregate: str = "COUNT", keys: Sequence[str] = (), lateness: str | None = None, start: str | None = None) -> DataFrame:
    """window_start, window_end, the keys and one aggregate per value.

    Tumbling if the lengths agree. Spark keeps partial aggregates per slide and merges them, so a
    row is counted once map-side. A stream needs ``lateness``; later rows are dropped.
    """
    if aggregate.upper() not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {aggregate}")
    fn = AGGREGATES[aggregate.upper()]
    if lateness:
        df = df.withWatermark(time, lateness)
    w = F.window(quoted(time), length, slide, start) if start else F.window(quoted(time), length, slide)
    out = df.groupBy(w.alias("_w"), *[F.col(quoted(k)) for k in keys]).agg(*[fn(F.col(quoted(v))).alias(v) for v in values])
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[quoted(k) for k in keys], *[quoted(v) for v in values])


def attribute_sets(attributes: Sequence[str], max_order: int, smallest: int = 0) -> list[tuple[str, ...]]:
    """All sets of up to ``max_order`` attributes; ``set`` columns hold places in this list."""
    return [s for k in range(smallest, max_order + 1) for s in combinations(attributes, k)]


def exploded_sets(attributes: Sequence[str], sets: Sequence[tuple[str, ...]]) -> Column:
    """One struct per set: its place, its order and the attributes as text, null where absent. A null value stays apart by the place."""
    blank = F.lit(None).cast("string")
    values = lambda s: [(F.col(quoted(a)).cast("string") if a in s else blank).alias(a) for a in attributes]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.lit(len(s)).alias("order"), *values(s)) for i, s in enumerate(sets)]))


def windowed_counts(df: DataFrame, time: str, length: str, slide: str, attributes: Sequence[str], outlier: str, max_order: int = 2, lateness: str | None = None) -> DataFrame:
    """Outliers and rows of each window and attribute combination up to ``max_order``; () are the window's totals.

    Combinations are exploded before one aggregation, which is combined map-side. It streams in any output mode.
    """
    if lateness:
        df = df.withWatermark(time, lateness)
    rows = df.select(F.col(quoted(time)).alias("_t"), F.col(quoted(outlier)).cast("double").alias("_o"), exploded_sets(attributes, attribute_sets(attributes, max_order)).alias("_s"))
    w = F.window("_t", length, slide)
    out = rows.groupBy(w.alias("_w"), "_s").agg(F.sum("_o").alias("outliers"), F.count("*").cast("double").alias("count"))
    return out.select(F.col("_w.start").alias("window_start"), "_s.*", "outliers", "count")


def tracked_counts(df: DataFrame, attributes: Sequence[str], outlier: str, max_order: int, tracked: Sequence[tuple[int, tuple]], least: Callable[[float], float]) -> tuple[float, float, dict[tuple[int, tuple], tuple[float, float]]]:
    """Outliers and inliers of a micro-batch, and those of its sets that are ``tracked`` or have at least ``least(outliers)`` outliers.

    A set is its place in ``attribute_sets`` (from order 1) and its values. What reaches the driver is bounded by the
    sets that are tracked and those that reach the bound.
    """
    hit = F.col(quoted(outlier)) > 0
    out, every = df.agg(F.count_if(hit), F.count("*")).first()
    sets = attribute_sets(attributes, max_order, 1)
    rows = df.select(F.coalesce(hit, F.lit(False)).alias("_o"), exploded_sets(attributes, sets).alias("_s"))
    counts = rows.groupBy("_s").agg(F.count_if("_o").alias("_outliers"), F.count("*").alias("_rows")).select("_s.*", "_outliers", "_rows")
    if tracked:
        kind = "_set int, " + ", ".join(f"_v{i} string" for i in range(len(attributes)))
        known = df.sparkSession.createDataFrame([(k, *values) for k, values in tracked], kind).withColumn("_known", F.lit(True))
        same = (counts["set"] == known["_set"]) & reduce(and_, [counts[quoted(a)].eqNullSafe(known[f"_v{i}"]) for i, a in enumerate(attributes)])
        # As many rows as tracked sets.
        counts = counts.join(F.broadcast(known), same, "left").where((F.col("_outliers") >= least(out)) | F.col("_known"))
    else:
        counts = counts.where(F.col("_outliers") >= least(out))
    found = counts.select("set", F.struct(*[F.col(quoted(a)) for a in attributes]).alias("_v"), "_outliers", "_rows").collect()
    return float(out), float(every - out), {(r["set"], tuple(r["_v"])): (float(r["_outliers"]), float(r["_rows"] - r["_outliers"])) for r in found}


def items_of(key: tuple[int, tuple], attributes: Sequence[str], max_order: int) -> dict[str, str | None]:
    """Attributes and values of a set of ``tracked_counts``."""
    names = attribute_sets(attributes, max_order, 1)[key[0]]
    return {a: v for a, v in zip(attributes, key[1], strict=True) if a in names}


def finished(counts: DataFrame, attributes: Sequence[str], min_support: float, min_ratio: float) -> DataFrame:
    """Combinations of each window with enough support and risk ratio, from ``windowed_counts``."""
    totals = counts.where(F.col("order") == 0).select("window_start", F.col("outliers").alias("_O"), F.col("count").alias("_T"))
    rows = counts.where(F.col("order") > 0).join(totals, "window_start")
    exposed, total = F.col("outliers"), F.col("count")
    rest_out, rest = F.col("_O") - exposed, F.col("_T") - total
    value = F.when(rest == 0, 0.0).when(rest_out == 0, float("inf")).otherwise(ratio(ratio(exposed, total), ratio(rest_out, rest)))
    out = rows.withColumns({"support": ratio(exposed, F.col("_O")), "risk_ratio": value})
    keep = (F.col("support") >= min_support) & (F.col("risk_ratio") >= min_ratio)
    return out.where(F.coalesce(keep, F.lit(False))).select("window_start", *[quoted(a) for a in attributes], "order", "outliers", "count", "support", "risk_ratio")


def windowed_explain(df: DataFrame, time: str, length: str, slide: str, attributes: Sequence[str], outlier: str, min_support: float = 0.1, min_ratio: float = 3.0, max_order: int = 2) -> DataFrame:
    """The exact explanation of every window of a batch relation."""
    return finished(windowed_counts(df, time, length, slide, attributes, outlier, max_order), attributes, min_support, min_ratio)


def explain_stream(
    stream: DataFrame, time: str, length: str, slide: str, lateness: str, attributes: Sequence[str], outlier: str, sink: Callable[[DataFrame, int], None],
    checkpoint: str, min_support: float = 0.1, min_ratio: float = 3.0, max_order: int = 2, available_now: bool = False,
) -> StreamingQuery:
    """Explains each window once the watermark closes it; ``sink`` gets the explanations of a micro-batch.

    Only counts per window and combination are state.
    """
    counts = windowed_counts(stream, time, length, slide, attributes, outlier, max_order, lateness)
    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(finished(df, attributes, min_support, min_ratio), i))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


