"""Contextual outliers: rows that stand out within a context, a conjunction of dimension values or intervals.

Level by level, contexts of at least a share ``density`` of all rows are joined with those of
one more dimension. Counts of all contexts of a level come from one aggregation, and so do the
scores: a context's rows are exploded to it and judged by its own median and deviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, quoted

BINS = 10
DENSITY = 0.5
MAX_LEVEL = 3


@dataclass(frozen=True)
class Interval:
    """A dimension's value, or its values in [low, high)."""

    dimension: str
    value: str | None = None
    low: float | None = None
    high: float | None = None

    def test(self) -> Column:
        c = F.col(quoted(self.dimension))
        if self.low is None:
            return F.coalesce(c.cast("string") == F.lit(self.value), F.lit(False))
        return F.coalesce((c.cast("double") >= self.low) & (c.cast("double") < self.high), F.lit(False))

    def text(self) -> str:
        return f"{self.dimension}={self.value}" if self.low is None else f"{self.dimension}=[{self.low:g},{self.high:g})"


Context = tuple[Interval, ...]


def base_intervals(df: DataFrame, discrete: Sequence[str], numeric: Sequence[str], bins: int = BINS, least: float = 1.0) -> list[Interval]:
    """Values whose count reaches ``least`` (at most rows / least of them), and equal-width intervals."""
    if least <= 0:
        raise ValueError("the least count of a value must be positive")
    out = []
    for d in discrete:
        rows = df.groupBy(F.col(quoted(d)).cast("string").alias("v")).count().where((F.col("count") >= least) & F.col("v").isNotNull()).orderBy("v").collect()
        out += [Interval(d, r.v) for r in rows]
    for d in numeric:
        low, high = df.agg(F.min(F.col(quoted(d)).cast("double")), F.max(F.col(quoted(d)).cast("double"))).first()
        if low is None:
            continue
        step = (high - low) / bins or 1.0
        out += [Interval(d, None, low + i * step, low + (i + 1) * step if i + 1 < bins else high + abs(high) * 1e-9 + 1e-9) for i in range(bins)]
    return out


def dense_contexts(df: DataFrame, discrete: Sequence[str], numeric: Sequence[str], density: float = DENSITY, bins: int = BINS, max_level: int = MAX_LEVEL) -> list[tuple[Context, int]]:
    """Contexts with at least a share ``density`` of the rows, and their counts; each level is one aggregation."""
    if density <= 0:
        raise ValueError("the density must be positive")
    n = df.count()
    if not n:
        return []
    least = density * n
    level: list[Context] = [(i,) for i in base_intervals(df, discrete, numeric, bins, least)]
    out: list[tuple[Context, int]] = []
    for _ in range(max_level):
        if not level:
            break
        counts = _counts(df, level)
        dense = [(c, counts[i]) for i, c in enumerate(level) if counts.get(i, 0) >= least]
        out += dense
        kept = {frozenset(c) for c, _ in dense}
        nxt: dict[frozenset, Context] = {}
        for (a, _), (b, _) in combinations(dense, 2):
            if a[:-1] == b[:-1] and a[-1].dimension != b[-1].dimension:
                c = (*a, b[-1])
                # Every part of a dense context is dense.
                if all(frozenset(p) in kept for p in combinations(c, len(c) - 1)):
                    nxt[frozenset(c)] = c
        level = list(nxt.values())
    return out


def _inside(contexts: Sequence[Context]) -> Column:
    """The places of the contexts that hold a row."""
    return F.filter(F.array(*[F.when(_all(c), F.lit(i)) for i, c in enumerate(contexts)]), lambda i: i.isNotNull())


def _counts(df: DataFrame, contexts: Sequence[Context]) -> dict[int, int]:
    """Rows of each context; one row per context reaches the driver."""
    return {r["c"]: r["count"] for r in df.select(F.explode(_inside(contexts)).alias("c")).groupBy("c").count().collect()}


def _all(context: Context) -> Column:
    out = F.lit(True)
    for i in context:
        out = out & i.test()
    return out


def text_of(context: Context) -> str:
    return " and ".join(i.text() for i in context)


def contextual_outliers(
    df: DataFrame, metric: str, discrete: Sequence[str] = (), numeric: Sequence[str] = (), density: float = DENSITY, threshold: float = 3.0, bins: int = BINS, max_level: int = MAX_LEVEL
) -> DataFrame:
    """``df`` rows with ``context`` and ``score``, once for each context that they stand out in.

    The score is |x - median| over the context's median absolute deviation (no spread: none stands out). Rows
    without a metric have no say.
    """
    contexts = [c for c, _ in dense_contexts(df, discrete, numeric, density, bins, max_level)]
    if not contexts:
        return df.withColumns({"context": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).where(F.lit(False))
    x = F.col(quoted(metric)).cast("double")
    rows = df.select(x.alias("_x"), F.explode(_inside(contexts)).alias("_c")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    # Both broadcasts have one row per context.
    medians = checkpointed(_medians(rows, "_x"))
    offs = rows.join(F.broadcast(medians), "_c").select("_c", F.abs(F.col("_x") - F.col("median")).alias("_d"))
    fit = checkpointed(medians.join(_medians(offs, "_d").withColumnRenamed("median", "mad"), "_c"))
    names = F.element_at(F.create_map(*[v for i, c in enumerate(contexts) for v in (F.lit(i), F.lit(text_of(c)))]), F.col("_c"))
    scored = df.withColumn("_c", F.explode(_inside(contexts))).join(F.broadcast(fit), "_c").withColumn("score", F.try_divide(F.abs(x - F.col("median")), F.col("mad")))
    return scored.where(F.col("score") > threshold).withColumn("context", names).drop("_c", "median", "mad")


def _medians(rows: DataFrame, column: str) -> DataFrame:
    """(_c, median), exact: distinct values of each context are ranked range by range; no context meets in one task."""
    sums = rows.groupBy("_c", F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = checkpointed(sums.repartitionByRange("_c", "_v").withColumn("_range", F.spark_partition_id()))
    # One row per range and context in it.
    totals = ranged.groupBy("_range", "_c").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy("_c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", "_c", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"), F.sum("_total").over(Window.partitionBy("_c")).alias("_all"))
    within = Window.partitionBy("_range", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(starts, ["_range", "_c"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(within))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (F.col("_upto") >= rank), F.col("_v")))
    return upto.groupBy("_c").agg(((at(low) + at(high)) / 2).alias("median"))


def contexts_of(df: DataFrame, outliers: Column, discrete: Sequence[str], numeric: Sequence[str] = (), density: float = DENSITY, bins: int = BINS) -> list[tuple[str, int]]:
    """Dense contexts that hold all of the given outliers, with the number of their rows."""
    picked = df.where(outliers)
    n = picked.count()
    found = dense_contexts(df, discrete, numeric, density, bins)
    if not found or not n:
        return []
    counts = _counts(picked, [c for c, _ in found])
    return [(text_of(c), rows) for i, (c, rows) in enumerate(found) if counts.get(i) == n]
