"""Densities, filters and mixtures over metric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import quoted, ship_code
from .scoring import _x, covariance

#: Rows that a kernel density keeps, whatever the size of the relation.
KERNELS = 10_000


def bandwidths(std: np.ndarray, n: int, rule: str = "NORMAL_SCALE", manual: Sequence[float] | None = None) -> np.ndarray:
    d = len(std)
    if rule == "MANUAL":
        return np.asarray(manual, dtype=float)
    if rule == "NORMAL_SCALE":
        return std * (4.0 / ((d + 2) * n)) ** (1.0 / (d + 4))
    if rule == "OVERSMOOTHED":
        return std * (243.0 * 0.6 / (35.0 * 0.2**2 * n)) ** 0.2
    raise ValueError(f"unknown bandwidth rule: {rule}")


def kernel_density(
    df: DataFrame, columns: Sequence[str], share: float = 0.01, rule: str = "NORMAL_SCALE", manual: Sequence[float] | None = None, seed: int = 3, output: str = "_DENSITY",
    bins: int | None = None,
) -> DataFrame:
    """Epanechnikov product kernels on a seeded sample of at most ``KERNELS`` rows.

    ``bins``: a row is scored at the middle of its grid cell instead (a binned density).
    """
    ship_code(df.sparkSession)
    rows = df.select(*[_x(c).alias(c) for c in columns]).dropna()
    n = rows.count()
    sample = rows.sample(fraction=min(1.0, max(share, min(1.0, 200 / max(n, 1))), KERNELS / max(n, 1)), seed=seed).limit(KERNELS)
    points = np.array([list(r) for r in sample.collect()], dtype=float).reshape(-1, len(columns))
    std = np.array(rows.agg(*[F.stddev_samp(c) for c in columns]).first(), dtype=float)
    width = np.maximum(bandwidths(std, max(len(points), 1), rule, manual), 1e-12)
    low = points.min(axis=0) if len(points) else np.zeros(len(columns))
    cell = np.maximum((points.max(axis=0) - low) / bins, 1e-12) if bins and len(points) else None
    shared = df.sparkSession.sparkContext.broadcast((points, width, low, cell))

    @F.pandas_udf("double")
    def density(*cols: pd.Series) -> pd.Series:
        points, width, low, cell = shared.value
        x = np.column_stack([c.to_numpy(float) for c in cols])
        if cell is not None:
            x = low + (np.floor((x - low) / cell) + 0.5) * cell
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            u = (x[at : at + 256, None, :] - points[None, :, :]) / width
            out[at : at + 256] = np.prod(np.where(np.abs(u) < 1, 0.75 * (1 - u * u), 0.0), axis=2).sum(axis=1)
        return pd.Series(out / (max(len(points), 1) * np.prod(width)))

    return df.withColumn(output, density(*[_x(c) for c in columns]))


def on_grid(score, spark, ranges: dict[str, tuple[float, float]], steps: int = 20) -> DataFrame:
    """A fitted score (a function of a relation) at the points of a regular grid, for plots."""
    grid = spark.range(1).select()
    for name, (low, high) in ranges.items():
        at = F.explode(F.sequence(F.lit(0), F.lit(steps)))
        grid = grid.select("*", at.alias(name)).withColumn(name, low + F.col(name) * ((high - low) / steps))
    return score(grid)


def bayesian_normal_score(df: DataFrame, column: str, output: str = "_SCORE") -> DataFrame:
    """One over the posterior predictive density (a t distribution) under a weak conjugate normal prior."""
    n, mean, var = df.agg(F.count(_x(column)), F.avg(_x(column)), F.var_pop(_x(column))).first()
    if not n:
        return df.withColumn(output, F.lit(None).cast("double"))
    k, nu = n + 1e-3, n + 1.0
    centre = n * mean / k
    beta = 0.5 * (n * var + 1e-3 * n * mean * mean / k) + 1e-9
    scale2 = beta * (k + 1) / (nu / 2 * k)
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * scale2)
    z = (_x(column) - centre) * (_x(column) - centre) / (nu * scale2)
    return df.withColumn(output, F.exp(-(log_c - (nu + 1) / 2 * F.log1p(z))))


def moving_average_score(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), window: int = 100, output: str = "_SCORE") -> DataFrame:
    """Sum over metrics of |latest - average| / average, the average weighted by time over the last ``window`` rows.

    Each value weighs as long as it lasted. Without keys the whole relation is one series.
    """
    w = Window.partitionBy(*keys).orderBy(quoted(order)) if keys else Window.partitionBy(F.lit(0)).orderBy(quoted(order))
    back = w.rowsBetween(-(window - 1), -1)
    t = _x(order)
    lasted = F.lead(t).over(w) - t
    rows = df.withColumn("_lasted", lasted)
    total = F.lit(0.0)
    for c in values:
        average = F.try_divide(F.sum(F.col("_lasted") * _x(c)).over(back), F.sum("_lasted").over(back))
        total = total + F.coalesce(F.try_divide(F.abs(_x(c) - average), average), F.lit(0.0))
    return rows.withColumn(output, total).drop("_lasted")


def pane_moving_average(batches: DataFrame, order: str, total: str, count: str, panes: int, output: str = "average") -> DataFrame:
    """The average over the last ``panes`` batches: sums over counts. One row per batch, so the ordering is small."""
    w = Window.partitionBy(F.lit(0)).orderBy(quoted(order)).rowsBetween(-(panes - 1), 0)
    return batches.withColumn(output, F.try_divide(F.sum(_x(total)).over(w), F.sum(_x(count)).over(w)))


def kalman(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], process_noise: float = 1.0, measure_noise: float = 1.0) -> DataFrame:
    """Per series, constant-velocity Kalman estimates of each value. A series is filtered in order, as one group.

    A value is a number or a vector (an array of one length; a matrix is its rows in turn), whose entries share a
    covariance. The first value is the start, with unit variance and no velocity. Over an interval t the process adds
    noise g g', g = (t * t / 2, t), and a measurement has ``measure_noise`` times t * t. A null is no measurement: its
    estimate is the prediction; before the first value there is none.
    """
    ship_code(df.sparkSession)

    def filtered(t: np.ndarray, z: list) -> list:
        state = cov = None
        out = []
        for i, value in enumerate(z):
            if state is None:
                if value is not None:
                    state, cov = np.stack([value, np.zeros_like(value)]), np.eye(2)
            else:
                dt = t[i] - t[i - 1]
                step, g = np.array([[1.0, dt], [0.0, 1.0]]), np.array([dt * dt / 2, dt])
                state, cov = step @ state, step @ cov @ step.T + process_noise * np.outer(g, g)
                spread = cov[0, 0] + measure_noise * dt * dt
                if value is not None and spread > 0:
                    gain = cov[:, 0] / spread
                    state, cov = state + np.outer(gain, value - state[0]), cov - np.outer(gain, cov[0])
            out.append(None if state is None else state[0].copy())
        return out

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        out = {k: [key[i]] * len(rows) for i, k in enumerate(keys)} | {order: rows[order]}
        for c in values:
            vector = c in vectors
            given = [None if v is None or not vector and np.isnan(v) else np.atleast_1d(np.asarray(v, dtype=float)) for v in rows[c]]
            found = filtered(rows[order].to_numpy(float), given)
            out[f"{c}_estimate"] = pd.Series([v if v is None else v.tolist() if vector else float(v[0]) for v in found], dtype=object)
        return pd.DataFrame(out)

    vectors = {c for c in values if df.schema[c].dataType.simpleString().startswith("array")}
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, order]] + [f"`{c}_estimate` {'array<double>' if c in vectors else 'double'}" for c in values]
    return df.select(*keys, order, *values).groupBy(*keys).applyInPandas(run, ", ".join(kinds))


def mixture(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 7, tolerance: float = 0.01, rounds: int = 100) -> DataFrame:
    """``df`` with the cluster probabilities of a Gaussian mixture (``probability``) and its log density."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(df.withColumns({c: _x(c) for c in columns}))
    model = GaussianMixture(k=k, seed=seed, tol=tolerance, maxIter=rounds, featuresCol="_v", predictionCol="component", probabilityCol="_p").fit(rows)
    return model.transform(rows).withColumn("probability", vector_to_array("_p")).drop("_v", "_p")


def mixture_group(df: DataFrame, target: int, probability: str = "probability", output: str = "_OUTLIER") -> DataFrame:
    """1.0 where the likeliest component is ``target``."""
    p = F.col(probability)
    return df.withColumn(output, (F.array_position(p, F.array_max(p)) - 1 == target).cast("double"))


def linear_gaussian_log_density(df: DataFrame, columns: Sequence[str], output: str = "_LOGP") -> DataFrame:
    """Log density of a normal fitted to the relation, as one expression."""
    from .scoring import Mahalanobis

    mean, cov = covariance(df, columns)
    distance: Column = Mahalanobis(tuple(columns), mean, cov, squared=True).score()
    constant = -0.5 * (len(columns) * math.log(2 * math.pi) + math.log(max(float(np.linalg.det(cov)), 1e-300)))
    return df.withColumn(output, F.lit(constant) - distance / 2)
