"""Scores of metric vectors: robust and plain distances, normalisers and spectra.

A fit makes a few scalars or a small matrix; scoring is a column expression, or an Arrow
UDF where a row's vector needs linear algebra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import numbers, order_statistics, percentiles
from ..runtime import quoted, ship_code

SCORE = "_SCORE"
#: A median absolute deviation is this share of a normal's standard deviation.
MAD_TO_SIGMA = 1.4826


def _x(name: str) -> Column:
    return F.col(quoted(name)).cast("double")


def exact_median(df: DataFrame, column: str) -> float:
    values = numbers(df, column)
    n = values.count()
    if not n:
        return math.nan
    found = order_statistics(values, [(n + 1) // 2, n // 2 + 1], n)
    return sum(found[r] for r in ((n + 1) // 2, n // 2 + 1)) / 2


@dataclass(frozen=True)
class Mad:
    """|x - median| over the median absolute deviation; without spread, over the trimmed mean (5 % to 95 %) of the deviations."""

    column: str
    median: float
    mad: float

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Mad:
        median = exact_median(df, column)
        off = numbers(df, column).select(F.abs(F.col("v") - median).alias("d"))
        mad = exact_median(off, "d")
        if mad == 0:
            n = off.count()
            low, high = int(n * 0.05), int(n * 0.95)
            ends = order_statistics(off.withColumnRenamed("d", "v"), [max(1, low + 1), max(1, high)], n)
            kept = off.where((F.col("d") >= ends[max(1, low + 1)]) & (F.col("d") <= ends[max(1, high)]))
            mad = kept.agg(F.avg("d")).first()[0] or 0.0
        return cls(column, median, mad)

    def score(self) -> Column:
        return F.try_divide(F.abs(_x(self.column) - self.median), F.lit(self.mad))

    def z_equivalent(self, z: float) -> float:
        return z / MAD_TO_SIGMA


@dataclass(frozen=True)
class ZScore:
    """|x - mean| over the population's standard deviation."""

    column: str
    mean: float
    std: float

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> ZScore:
        return cls(column, *numbers(df, column).agg(F.avg("v"), F.stddev_pop("v")).first())

    def score(self) -> Column:
        return F.try_divide(F.abs(_x(self.column) - self.mean), F.lit(self.std))


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the sample covariance matrix of the rows without a null or NaN, in one aggregation."""
    k = len(columns)
    df = df.select(*[_x(c).alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.avg(_x(c)) for c in columns], *[F.covar_samp(_x(columns[i]), _x(columns[j])) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:], strict=True):
        out[i, j] = out[j, i] = v if v is not None else 0.0
    return np.array(row[:k], dtype=float), out


@dataclass(frozen=True)
class Mahalanobis:
    """The distance from a centre under a covariance; squared if asked."""

    columns: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray
    squared: bool = False

    def score(self) -> Column:
        inverse = np.linalg.pinv(self.cov)
        off = [_x(c) - float(m) for c, m in zip(self.columns, self.mean, strict=True)]
        total = F.lit(0.0)
        for i, a in enumerate(off):
            for j, b in enumerate(off):
                if inverse[i, j]:
                    total = total + a * b * float(inverse[i, j])
        return total if self.squared else F.sqrt(F.greatest(total, F.lit(0.0)))


def winsorize(df: DataFrame, columns: Sequence[str], trim: float = 5.0) -> DataFrame:
    """Each metric clamped at its ``trim`` and 100 - ``trim`` percentiles; nulls and NaNs stay what they are."""
    out = {}
    for c in columns:
        low, high = percentiles(df, c, [trim, 100 - trim])
        clamped = F.least(F.greatest(_x(c), F.lit(low)), F.lit(high))
        out[c] = F.when(_x(c).isNull() | F.isnan(_x(c)), _x(c)).otherwise(clamped)
    return df.withColumns(out)


def robust_covariance(df: DataFrame, columns: Sequence[str], trim: float = 5.0) -> Mahalanobis:
    """Squared distances under the covariance of winsorized metrics."""
    return Mahalanobis(tuple(columns), *covariance(winsorize(df, columns, trim), columns), squared=True)


def min_cov_det(df: DataFrame, columns: Sequence[str], alpha: float = 0.5, delta: float = 1e-3, seed: int = 5, rounds: int = 30) -> Mahalanobis:
    """The least-determinant covariance of about half the rows, by concentration steps.

    A step keeps the ``h`` rows nearest under the last fit: a cutoff on the distance, found by
    order statistics, and one aggregation. No row leaves the executors.
    """
    p = len(columns)
    if p < 2:
        raise ValueError("one metric: use Mad")
    rows = df.select(*[_x(c).alias(c) for c in columns]).dropna()
    n = rows.count()
    h = int(alpha * (n + p + 1))
    start = rows.sample(fraction=min(1.0, max(10.0 * p, 100.0) / max(n, 1)), seed=seed)
    fit = Mahalanobis(tuple(columns), *covariance(start if n > 200 else rows, columns))
    last = math.inf
    for _ in range(rounds):
        scored = rows.withColumn("v", fit.score())
        cutoff = order_statistics(scored.select("v"), [min(max(h, p + 1), n)], n)[min(max(h, p + 1), n)]
        fit = Mahalanobis(tuple(columns), *covariance(scored.where(F.col("v") <= cutoff), columns))
        det = float(np.linalg.det(fit.cov))
        if det == 0 or last - det < delta * max(abs(last), 1e-300):
            break
        last = det
    return fit


def scorer(name: str | Callable, df: DataFrame, columns: Sequence[str], **options):
    """A fitted scorer: MAD_OR_MCD, MAD, MCD, RCOV, ZSCORE, or a callable that fits one to (df, columns)."""
    if callable(name):
        return name(df, columns, **options)
    fits: dict[str, Callable] = {
        "MAD_OR_MCD": lambda: Mad.fit(df, columns[0]) if len(columns) == 1 else min_cov_det(df, columns, **options),
        "MAD": lambda: Mad.fit(df, columns[0]),
        "MCD": lambda: min_cov_det(df, columns, **options),
        "RCOV": lambda: robust_covariance(df, columns, **options),
        "ZSCORE": lambda: ZScore.fit(df, columns[0]),
    }
    if name not in fits:
        raise ValueError(f"unknown scorer: {name}")
    return fits[name]()


def score(df: DataFrame, name: str | Callable, columns: Sequence[str], output: str = SCORE, **options) -> DataFrame:
    """``df`` with the scores of a scorer fitted to it."""
    return df.withColumn(output, scorer(name, df, columns, **options).score())


def static_threshold(df: DataFrame, column: str = SCORE, threshold: float = 3.0, output: str = "_OUTLIER") -> DataFrame:
    x = _x(column)
    return df.withColumn(output, F.coalesce(x > threshold, F.lit(False)).cast("double"))


def batch_percentile(df: DataFrame, column: str = SCORE, percentile: float = 0.99, output: str = "_OUTLIER") -> DataFrame:
    """1.0 at or above the percentile (0..1) of the scores; infinite and NaN scores always."""
    x = _x(column)
    finite = df.where(~F.isnan(x) & (F.abs(x) != math.inf))
    cutoff = percentiles(finite, column, [percentile * 100])[0]
    return df.withColumn(output, F.coalesce((x >= cutoff) | F.isnan(x) | (x == math.inf), F.lit(False)).cast("double"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metrics scaled by a range that always includes 0; a constant 0 stays 0."""
    row = df.agg(*[f(_x(c)) for c in columns for f in (F.min, F.max)]).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = min(0.0, row[2 * i] or 0.0), max(0.0, row[2 * i + 1] or 0.0)
        out[c] = (_x(c) - low) / (high - low) if high > low else F.lit(0.0)
    return df.withColumns(out)


def low_metric(df: DataFrame, columns: Sequence[str], floor: float = 0.1) -> DataFrame:
    """1 / max(x, floor): low values become high; nulls and NaNs stay what they are."""
    high = lambda x: F.when(x.isNull() | F.isnan(x), x).otherwise(F.lit(1.0) / F.greatest(x, F.lit(floor)))
    return df.withColumns({c: high(_x(c)) for c in columns})


# Vectors: an array column.
def truncate(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.withColumn(column, F.slice(F.col(quoted(column)), 1, k))


def projection_matrix(length: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).normal(scale=1 / math.sqrt(length), size=(k, length))


def random_projection(df: DataFrame, column: str, k: int = 10, seed: int = 11, output: str | None = None) -> DataFrame:
    """A seeded Gaussian projection on ``k`` directions, of variance 1 over the length."""
    ship_code(df.sparkSession)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        matrices: dict[int, np.ndarray] = {}

        def one(x):
            a = np.asarray(x, dtype=float)
            if len(a) not in matrices:
                matrices[len(a)] = projection_matrix(len(a), k, seed)
            return (matrices[len(a)] @ a).tolist()

        return v.map(lambda x: None if x is None or not len(x) else one(x))

    return df.withColumn(output or column, project(F.col(quoted(column)).cast("array<double>")))


def fft(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """The spectrum of each vector, padded with zeros to a power of two: real and imaginary parts in turn."""

    @F.pandas_udf("array<double>")
    def spectrum(v: pd.Series) -> pd.Series:
        def one(x):
            a = np.asarray(x, dtype=float)
            z = np.fft.fft(a, 1 << (max(len(a), 1) - 1).bit_length())
            return np.column_stack([z.real, z.imag]).ravel().tolist()

        return v.map(lambda x: None if x is None else one(x))

    return df.withColumn(output or column, spectrum(F.col(quoted(column)).cast("array<double>")))


def autocorrelation(values: Sequence[float], max_lag: int) -> list[float]:
    """Correlations at lags 1..max_lag over that at 0; entry 0 is 0."""
    a = np.asarray(values, dtype=float)
    a = a - a.mean()
    z = np.fft.fft(a, 1 << (2 * len(a)).bit_length())
    c = np.fft.ifft(z * z.conj()).real[: max_lag + 1]
    out = c / c[0] if len(c) and c[0] else np.zeros_like(c)
    out[:1] = 0.0
    return out.tolist()


def peaks(correlations: Sequence[float], threshold: float = 0.2) -> list[int]:
    """Lags whose correlation is above the threshold and above both neighbours'."""
    c = correlations
    return [i for i in range(1, len(c) - 1) if c[i] > threshold and c[i] > c[i - 1] and c[i] > c[i + 1]]


def autocorrelate(df: DataFrame, keys: Sequence[str], order: str, value: str, max_lag: int) -> DataFrame:
    """Per series: lag and correlation. A series is one group, as its spectrum needs all of it."""
    ship_code(df.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = autocorrelation(rows.sort_values(order)[value].to_numpy(float), max_lag)
        out = pd.DataFrame({"lag": range(len(c)), "correlation": c})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, lag int, correlation double")
