"""Classifiers: each adds an outlier weight (0 for inliers) to a relation, as a plan without Python code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import interpolated, normal_cdf, percentiles, weighted_percentiles
from ..runtime import quoted

OUTLIER = "_OUTLIER"


def compare(column: Column, op: str, value, is_string: bool) -> Column:
    """``column op value``, never null; a NaN satisfies only ``!=``."""
    if op in ("=", "==", "!=", "<>"):
        out = column.eqNullSafe(F.lit(value))
        if not is_string:
            out = out & ~F.isnan(column)
        return F.coalesce(~out if op in ("!=", "<>") else out, F.lit(False))
    tests = {"<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value}
    if op not in tests:
        raise ValueError(f"unknown comparison: {op}")
    return F.coalesce(tests[op] if is_string else tests[op] & ~F.isnan(column), F.lit(False))


def _test(df: DataFrame, metric: str, op: str, value) -> Column:
    is_string = isinstance(value, str)
    return compare(F.col(quoted(metric)).cast("string" if is_string else "double"), op, value, is_string)


def percentile_cutoffs(df: DataFrame, metric: str, percentile: float) -> tuple[float, float]:
    low, high = percentiles(df, metric, [percentile, 100 - percentile])
    return low, high


def percentile_classify(df: DataFrame, metric: str, percentile: float = 0.5, include_high: bool = True, include_low: bool = True, output: str = OUTLIER) -> DataFrame:
    """1.0 strictly beyond the ``percentile`` and 100 - ``percentile`` cutoffs."""
    low, high = percentile_cutoffs(df, metric, percentile)
    x = F.col(quoted(metric)).cast("double")
    hit = F.lit(False)
    if include_high:
        hit = hit | compare(x, ">", high, False)
    if include_low:
        hit = hit | compare(x, "<", low, False)
    return df.withColumn(output, hit.cast("double"))


def predicate_classify(df: DataFrame, metric: str, op: str, value, output: str = OUTLIER) -> DataFrame:
    """1.0 where ``metric op value``; ``value`` is a number or a string."""
    return df.withColumn(output, _test(df, metric, op, value).cast("double"))


def predicate_cube_classify(df: DataFrame, count: str, metric: str, op: str, value, output: str = OUTLIER) -> DataFrame:
    """The row's count where ``metric op value``, else 0."""
    return df.withColumn(output, F.when(_test(df, metric, op, value), F.col(quoted(count)).cast("double")).otherwise(0.0))


def arithmetic_cutoffs(df: DataFrame, count: str, mean: str, percentile: float) -> tuple[float, float]:
    low, high = weighted_percentiles(df, mean, count, [percentile, 100 - percentile])
    return low, high


def arithmetic_classify(
    df: DataFrame, count: str, mean: str, std: str, percentile: float = 1.0, include_high: bool = True, include_low: bool = True, output: str = OUTLIER, compat: bool = False
) -> DataFrame:
    """For cubes: the expected number of a cell's values beyond the cutoffs, if they are normal.

    A cell without a spread counts wholly or not at all. ``compat``: its low test takes the high cutoff.
    """
    low, high = arithmetic_cutoffs(df, count, mean, percentile)
    n, m, s = (F.col(quoted(c)).cast("double") for c in (count, mean, std))
    flat = s.isNull() | F.isnan(s) | (s == 0)
    high_z, low_z = F.try_divide(F.lit(high) - m, s), F.try_divide(F.lit(low) - m, s)
    spread, whole = F.lit(0.0), F.lit(False)
    if include_high:
        spread = spread + n * (1.0 - normal_cdf(high_z))
        whole = whole | (m > high)
    if include_low:
        spread = spread + n * normal_cdf(low_z)
        whole = whole | (m < (high if compat else low))
    return df.withColumn(output, F.when(flat, F.when(whole, n).otherwise(0.0)).otherwise(spread))


def quantile_classify(
    df: DataFrame, count: str, quantiles: dict[str, float], percentile: float = 1.0, include_high: bool = True, include_low: bool = True, output: str = OUTLIER
) -> DataFrame:
    """For cubes with quantile columns: the share of a cell beyond the cutoffs, by interpolation.

    ``quantiles``: column -> share in 0..1. The cutoffs come from cells at the middle of
    neighbouring quantiles, weighted by the share between them.
    """
    ordered = sorted(quantiles.items(), key=lambda kv: kv[1])
    cols = [F.col(quoted(c)).cast("double") for c, _ in ordered]
    shares = [q for _, q in ordered]
    n = F.col(quoted(count)).cast("double")
    middles = [F.struct(((a + b) / 2).alias("v"), (n * (qb - qa)).alias("w")) for a, b, qa, qb in zip(cols[:-1], cols[1:], shares[:-1], shares[1:], strict=True)]
    cells = df.select(F.explode(F.array(*middles)).alias("c")).select("c.v", "c.w")
    low, high = weighted_percentiles(cells, "v", "w", [percentile, 100 - percentile])
    ys = [F.lit(q) for q in shares]

    def below(x: float) -> Column:
        return F.when(F.lit(x) <= cols[0], 0.0).when(F.lit(x) >= cols[-1], 1.0).otherwise(interpolated(F.lit(x), cols, ys))

    out = F.lit(0.0)
    if include_high:
        out = out + n * (1.0 - below(high))
    if include_low:
        out = out + n * below(low)
    return df.withColumn(output, out)


def raw_classify(df: DataFrame, count: str, outlier_count: str) -> DataFrame:
    """The relation itself, whose columns hold counts already; both must exist."""
    if missing := {count, outlier_count} - set(df.columns):
        raise ValueError(f"columns not present: {sorted(missing)}")
    return df


def count_mean_shift_classify(df: DataFrame, metric: str, mean: str, op: str, value, count: str | None = None) -> DataFrame:
    """Adds _OUTLIERCOUNT, _INLIERCOUNT, _OUTLIERMEANSUM and _INLIERMEANSUM; weighted by ``count`` if given."""
    hit = _test(df, metric, op, value)
    n = F.col(quoted(count)).cast("double") if count else F.lit(1.0)
    total = F.col(quoted(mean)).cast("double") * n
    return df.withColumns(
        {
            "_OUTLIERCOUNT": F.when(hit, n).otherwise(0.0),
            "_INLIERCOUNT": F.when(hit, 0.0).otherwise(n),
            "_OUTLIERMEANSUM": F.when(hit, total).otherwise(0.0),
            "_INLIERMEANSUM": F.when(hit, 0.0).otherwise(total),
        }
    )


def bucket_metric(df: DataFrame, columns: Sequence[str], points: Sequence[float] = (10.0, 90.0), simple: bool = False, suffix: str = "_a") -> DataFrame:
    """A string column per metric naming its bucket between percentiles; a boundary belongs below.

    Names are ``column:[low,high]``, or ``column:index`` if ``simple``.
    """
    for c in columns:
        cuts = percentiles(df, c, list(points))
        x = F.col(quoted(c)).cast("double")
        ends = [-math.inf, *cuts, math.inf]
        name = lambda i, c=c, ends=ends: f"{c}:{i}" if simple else f"{c}:[{ends[i]:.6g},{ends[i + 1]:.6g}]"
        out = F.lit(name(len(cuts)))
        for i in reversed(range(len(cuts))):
            out = F.when(x <= cuts[i], F.lit(name(i))).otherwise(out)
        df = df.withColumn(f"{c}{suffix}", out)
    return df
