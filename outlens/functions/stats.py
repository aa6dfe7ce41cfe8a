"""Order statistics and tables shared by functions and classifiers."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, quoted

#: Values that a search for an order statistic may bring to the driver.
BRACKET = 100_000


def numbers(df: DataFrame, column: str, alias: str = "v") -> DataFrame:
    """One double column without nulls and NaNs."""
    v = F.col(quoted(column)).cast("double")
    return df.select(v.alias(alias)).where(F.col(alias).isNotNull() & ~F.isnan(alias))


def order_statistics(values: DataFrame, ranks: Sequence[int], n: int) -> dict[int, float]:
    """The values of some 1-based ranks of column ``v``.

    Sketches bracket the ranks ever closer until at most ``BRACKET`` values are left for each; so no pass
    sorts or shuffles the column. All ranks share each pass: one for sketches, one for counts, one for the rest.
    """
    v, width = F.col("v"), 0.002
    #: rank -> (lowest, highest, values below, values inside)
    at = {r: (-math.inf, math.inf, 0, n) for r in sorted(set(ranks))}
    tied: set[int] = set()
    within = lambda r: (v >= at[r][0]) & (v <= at[r][1])
    while wide := [r for r, b in at.items() if b[3] > BRACKET and r not in tied]:
        by_bracket: dict[tuple, list[int]] = {}
        for r in wide:
            by_bracket.setdefault(at[r], []).append(r)
        share = {r: (r - at[r][2]) / at[r][3] for r in wide}
        points = lambda rs: [p for r in rs for p in (max(0.0, share[r] - width), min(1.0, share[r] + width))]  # noqa: B023, E731
        sketches = values.agg(*[F.percentile_approx(v if b[3] == n else F.when(within(rs[0]), v), points(rs), 10_000) for b, rs in by_bracket.items()]).first()
        ends = {}
        for (b, rs), found in zip(by_bracket.items(), sketches, strict=True):
            for r, lo, hi in zip(rs, found[::2], found[1::2], strict=True):
                ends[r] = (b[0] if share[r] - width <= 0 else lo, b[1] if share[r] + width >= 1 else hi)
        counts = values.agg(*[F.count_if(c) for lo, hi in ends.values() for c in (v < lo, (v >= lo) & (v <= hi))]).first()
        for (r, (lo, hi)), less, inside in zip(ends.items(), counts[::2], counts[1::2], strict=True):
            if lo == hi or inside == at[r][3] or not less < r <= less + inside:
                tied.add(r)  # ties or an unlucky sketch: settled by counts of the distinct values left
            else:
                at[r] = (lo, hi, less, inside)
    few = [r for r, b in at.items() if b[3] <= BRACKET]
    held = sorted(x[0] for x in values.where(reduce(or_, map(within, few))).collect()) if few else []
    # ``held`` may have values of several brackets; each is a run of it.
    out = {r: held[bisect_left(held, at[r][0]) + r - at[r][2] - 1] for r in few}
    for r in at.keys() - out.keys():
        out[r] = cumulated(values.where(within(r)).withColumn("w", F.lit(1)), "v", "w").where(F.col("upto") >= r - at[r][2]).agg(F.min("v")).first()[0]
    return out


def percentiles(df: DataFrame, column: str, points: Sequence[float]) -> list[float]:
    """Percentiles in 0..100 at position p (n + 1) / 100 between order statistics (the "R-6" rule)."""
    values = numbers(df, column)
    n = values.count()
    if not n:
        return [math.nan for _ in points]
    places = [p * (n + 1) / 100 for p in points]
    ends = [(min(max(math.floor(x), 1), n), min(max(math.floor(x) + 1, 1), n)) for x in places]
    found = order_statistics(values, [r for e in ends for r in e], n)
    out = []
    for x, (a, b) in zip(places, ends, strict=True):
        if x < 1:
            out.append(found[1] if 1 in found else order_statistics(values, [1], n)[1])
        elif x >= n:
            out.append(found[n])
        else:
            out.append(found[a] + (x - math.floor(x)) * (found[b] - found[a]))
    return out


def linear_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Quantiles of shares in 0..1 at position 1 + p (n - 1), between order statistics (the "R-7" rule, numpy's)."""
    values = numbers(df, column)
    n = values.count()
    if not n:
        return [math.nan for _ in shares]
    places = [p * (n - 1) + 1 for p in shares]
    ends = [(math.floor(x), min(math.floor(x) + 1, n)) for x in places]
    found = order_statistics(values, [r for e in ends for r in e], n)
    return [found[a] if found[a] == found[b] else found[a] + (x - a) * (found[b] - found[a]) for x, (a, b) in zip(places, ends, strict=True)]


def cumulated(df: DataFrame, value: str, weight: str) -> DataFrame:
    """value, weight (summed per distinct value) and ``upto``: the weight at or below the value.

    One range exchange of distinct values; each task cumulates its own range, and one total per
    range is added. Nothing is gathered in one task.
    """
    sums = df.groupBy(quoted(value)).agg(F.sum(quoted(weight)).alias(weight))
    ranged = checkpointed(sums.repartitionByRange(quoted(value)).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(quoted(weight)).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(quoted(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(starts), "_range")  # one row per partition
    return out.withColumn("upto", F.col("_start") + F.sum(quoted(weight)).over(inside)).drop("_range", "_start")


def weighted_percentiles(df: DataFrame, value: str, weight: str, percents: Sequence[float]) -> list[float]:
    """Data values: walking from the nearer end, the first at which the weights reach the whole part of their share.

    Sums of fractional weights are only known to rounding, hence the slack. One cumulated table serves all of them.
    """
    table = cumulated(df.select(F.col(quoted(value)).cast("double").alias("v"), F.col(quoted(weight)).cast("double").alias("w")), "v", "w")
    total = table.agg(F.sum("w")).first()[0]
    if total is None:
        return [math.nan for _ in percents]

    def reached(percent: float) -> Column:
        if percent <= 50:
            return F.min(F.when(F.col("upto") >= int(round(percent / 100 * total, 6)) - 1e-6, F.col("v")))
        return F.max(F.when(F.lit(total) - F.col("upto") + F.col("w") >= int(round((100 - percent) / 100 * total, 6)) - 1e-6, F.col("v")))

    return list(table.agg(*[reached(p) for p in percents]).first())


def weighted_percentile(df: DataFrame, value: str, weight: str, percent: float) -> float:
    return weighted_percentiles(df, value, weight, [percent])[0]


def normal_table() -> list[float]:
    """The normal distribution function at -3.5, -3.4, .. 3.5, to six places, as in printed tables."""
    return [round(0.5 * (1 + math.erf(i / 10 / math.sqrt(2))), 6) for i in range(-35, 36)]


def normal_cdf(z: Column) -> Column:
    """Linear interpolation in the table; beyond its ends the end values."""
    table = F.array(*[F.lit(v) for v in normal_table()])
    at = (F.greatest(F.lit(-3.5), F.least(F.lit(3.5), z)) + 3.5) * 10
    low = F.least(F.floor(at), F.lit(69))
    a, b = F.get(table, low.cast("int")), F.get(table, (low + 1).cast("int"))
    return a + (at - low) * (b - a)


def interpolated(x: Column, xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    """Piecewise linear through (xs, ys), ascending; NaN outside."""
    if len(xs) < 2:
        raise ValueError("interpolation needs two points")
    out = F.lit(float("nan"))
    for x0, x1, y0, y1 in reversed(list(zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True))):
        line = F.when(x1 == x0, y0).otherwise(y0 + F.try_divide((x - x0) * (y1 - y0), x1 - x0))
        out = F.when((x >= x0) & (x <= x1), line).otherwise(out)
    return out
