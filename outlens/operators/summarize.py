"""Summarizers: explanations of classified relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, mean_deviation, mean_shift, ratio_metric, support
from ..runtime import quoted
from .classify import OUTLIER
from .lattice import explain


def explain_outliers(
    df: DataFrame, attributes: Sequence[str], outlier: str = OUTLIER, count: str | None = None, min_support: float = 0.1, min_ratio: float = 3.0, ratio: str = "global_ratio",
    max_order: int = 3, dependencies: Sequence[set[str]] = (),
) -> DataFrame:
    """Attributes, outliers, count, support and the ratio; cubes name their count column."""
    n = F.col(quoted(count)) if count else F.lit(1.0)
    metrics = [Metric("support", support(), min_support, monotone=True), ratio_metric(ratio, min_ratio)]
    return explain(df, attributes, {"outliers": F.col(quoted(outlier)), "count": n}, metrics, max_order, dependencies)


def explain_mean(df: DataFrame, attributes: Sequence[str], count: str, mean: str, std: str, min_support: float = 0.1, min_deviations: float = 3.0, max_order: int = 3) -> DataFrame:
    """Combinations whose mean deviates from the whole's by at least ``min_deviations`` of its spread."""
    n, m, s = (F.col(quoted(c)).cast("double") for c in (count, mean, std))
    sums = {"count": n, "m1": m * n, "m2": (s * s + m * m) * n}
    metrics = [Metric("support", support("count"), min_support, monotone=True), Metric("mean_deviation", mean_deviation, min_deviations)]
    return explain(df, attributes, sums, metrics, max_order)


def mean_outlier_count(df: DataFrame, count: str, mean: str, std: str, min_deviations: float = 3.0) -> float:
    """The number of values in cells whose own mean deviates by more than ``min_deviations``."""
    n, m, s = (F.col(quoted(c)).cast("double") for c in (count, mean, std))
    total, m1, m2 = df.agg(F.sum(n), F.sum(m * n), F.sum((s * s + m * m) * n)).first()
    if not total:
        return 0.0
    centre = m1 / total
    spread = max(0.0, m2 / total - centre * centre) ** 0.5
    return df.where(F.abs(m - centre) > min_deviations * spread).agg(F.coalesce(F.sum(n), F.lit(0.0))).first()[0]


def explain_mean_shift(df: DataFrame, attributes: Sequence[str], min_support: float = 0.1, min_shift: float = 1.0, max_order: int = 3) -> DataFrame:
    """Combinations whose outliers have a mean at least ``min_shift`` times their inliers'; after ``count_mean_shift_classify``."""
    sums = {"outlier_count": F.col("_OUTLIERCOUNT"), "inlier_count": F.col("_INLIERCOUNT"), "outlier_sum": F.col("_OUTLIERMEANSUM"), "inlier_sum": F.col("_INLIERMEANSUM")}
    metrics = [
        Metric("outlier_support", support("outlier_count"), min_support, monotone=True),
        Metric("inlier_support", support("inlier_count"), min_support, monotone=True),
        Metric("mean_shift", mean_shift, min_shift),
    ]
    return explain(df, attributes, sums, metrics, max_order)
