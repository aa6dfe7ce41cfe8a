"""Quality metrics of attribute combinations, as column expressions.

A metric sees the aggregates of a group and of the whole relation. ``monotone``
metrics can only fall as a combination grows, so failing one ends the search there;
failing another still lets the combination grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Values = dict[str, Column]
INFINITY = float("inf")


@dataclass(frozen=True)
class Metric:
    name: str
    value: Callable[[Values, dict[str, float]], Column]
    threshold: float
    monotone: bool = False

    def column(self, group: Values, whole: dict[str, float]) -> Column:
        return self.value(group, whole).cast("double").alias(self.name)


def ratio(a: Column, b: Column | float) -> Column:
    """Division that gives null instead of an error for a zero divisor."""
    return F.try_divide(a.cast("double"), F.lit(b).cast("double") if not isinstance(b, Column) else b.cast("double"))


def support(part: str = "outliers") -> Callable[[Values, dict[str, float]], Column]:
    return lambda g, w: ratio(g[part], w[part])


def global_ratio(g: Values, w: dict[str, float]) -> Column:
    return ratio(ratio(g["outliers"], g["count"]), ratio(F.lit(w["outliers"]), w["count"]))


def risk_ratio(g: Values, w: dict[str, float]) -> Column:
    exposed, total = g["outliers"], g["count"]
    other_out, other = F.lit(w["outliers"]) - exposed, F.lit(w["count"]) - total
    plain = ratio(ratio(exposed, total), ratio(other_out, other))
    return F.when(total == 0, 0.0).when(other == 0, 0.0).when(other_out == 0, INFINITY).otherwise(plain)


def prevalence_ratio(g: Values, w: dict[str, float]) -> Column:
    o, t = g["outliers"], g["count"]
    inliers = F.when(t == o, F.lit(1.0)).otherwise(t - o)
    whole = ratio(F.lit(w["outliers"] or 1.0), w["count"] - w["outliers"])
    return ratio(ratio(o, inliers), whole)


def mean_deviation(g: Values, w: dict[str, float]) -> Column:
    mean = w["m1"] / w["count"] if w["count"] else float("nan")
    spread = max(0.0, w["m2"] / w["count"] - mean * mean) ** 0.5 if w["count"] else 0.0
    return ratio(F.abs(ratio(g["m1"], g["count"]) - mean), spread)


def mean_shift(g: Values, w: dict[str, float]) -> Column:
    return ratio(ratio(g["outlier_sum"], g["outlier_count"]), ratio(g["inlier_sum"], g["inlier_count"]))


def corrected_risk_ratio(g: Values, w: dict[str, float]) -> Column:
    """The risk ratio less twice its standard error on the log scale."""
    exposed, total = g["outliers"], g["count"]
    other_out, other = F.lit(w["outliers"]) - exposed, F.lit(w["count"]) - total
    error = F.sqrt(ratio(ratio(total - exposed, exposed), total) + ratio(F.lit(1.0), other))
    return F.when(exposed == 0, 0.0).otherwise(risk_ratio(g, w) - 2 * error)


RATIOS: dict[str, Callable[[Values, dict[str, float]], Column]] = {
    "global_ratio": global_ratio,
    "globalratio": global_ratio,
    "risk_ratio": risk_ratio,
    "riskratio": risk_ratio,
    "prevalence_ratio": prevalence_ratio,
    "prevalenceratio": prevalence_ratio,
}

#: What a ratio's column is called, whichever way it was asked for.
COLUMN_NAMES = {"globalratio": "global_ratio", "riskratio": "risk_ratio", "prevalenceratio": "prevalence_ratio"}


def ratio_metric(name: str, threshold: float) -> Metric:
    """By name; any unknown name means the global ratio."""
    key = name.lower()
    fn = RATIOS.get(key, global_ratio)
    return Metric(COLUMN_NAMES.get(key, key if key in RATIOS else "global_ratio"), fn, threshold)
