"""``DIFF``: attribute combinations that are disproportionately common among outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric, ratio_metric, support
from ..runtime import quoted
from .lattice import explain

OUTLIER_COLUMN = "outlier_col"
#: Rows beyond which ``ON *`` looks at a seeded sample.
STAR_ROWS = 1000


def split(df: DataFrame, predicate: Column, column: str = OUTLIER_COLUMN) -> DataFrame:
    """``df`` with 1.0 where ``predicate`` holds and 0.0 elsewhere."""
    return df.withColumn(column, F.coalesce(predicate, F.lit(False)).cast("double"))


def tagged(outliers: DataFrame, inliers: DataFrame, column: str = OUTLIER_COLUMN) -> DataFrame:
    """Both relations, by position, with the outlier mark."""
    return outliers.withColumn(column, F.lit(1.0)).union(inliers.withColumn(column, F.lit(0.0)))


def star_attributes(df: DataFrame, seed: int = 17) -> list[str]:
    """String columns with fewer distinct values than a quarter of the rows looked at."""
    names = [n for n, t in df.dtypes if t == "string"]
    if not names:
        return []
    rows = df.select(*[quoted(n) for n in names])
    if (n := rows.count()) > STAR_ROWS:
        # A seeded draw of about STAR_ROWS rows; only counts reach the driver.
        rows = rows.sample(fraction=min(1.0, 1.2 * STAR_ROWS / n), seed=seed).limit(STAR_ROWS)
    got = rows.agg(F.count("*").alias("_n"), *[F.count_distinct(F.coalesce(F.col(quoted(c)), F.lit("\0"))).alias(f"_{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if got[f"_{i}"] < got["_n"] // 4]


def diff(
    df: DataFrame,
    on: Sequence[str] | str,
    outlier_column: str = OUTLIER_COLUMN,
    min_support: float = 0.2,
    min_ratio: float = 1.5,
    ratio: str = "global_ratio",
    max_combo: int = 3,
    count_column: str | None = None,
    dependencies: Sequence[set[str]] = (),
    with_present: bool = False,
) -> DataFrame:
    """Attributes, support, the ratio, outlier_count and total_count.

    ``on`` is a list of columns, or "*". Rows are weighted by ``count_column`` if given. ``with_present`` adds the
    names of a combination's attributes: of those a null is a value, the others are absent.
    """
    if on == "*":
        on = star_attributes(df.drop(outlier_column))
        if not on:
            raise ValueError("ON * finds no column with few distinct values")
    metrics = [Metric("support", support(), min_support, monotone=True), ratio_metric(ratio, min_ratio)]
    count = F.col(quoted(count_column)) if count_column else F.lit(1.0)
    found = explain(df, on, {"outliers": F.col(outlier_column), "count": count}, metrics, max_combo, dependencies)
    return found.select(*[quoted(a) for a in dict.fromkeys(on)], "support", metrics[1].name, F.col("outliers").alias("outlier_count"), F.col("count").alias("total_count"), *["present"] * with_present)


def diff_join(outliers: DataFrame, inliers: DataFrame, dimension: DataFrame, key: str, on: Sequence[str], min_ratio: float = 1.5, **options) -> DataFrame:
    """DIFF of two relations that are both joined to one dimension table.

    For the global ratio a group's ratio is at most the largest of its keys', so
    the dimension rows that share an attribute value with a key above the threshold are all that can
    be reported; the others are dropped before the join (their rows still count in the totals).
    """
    both = tagged(outliers.select(key), inliers.select(key))
    joined = both.join(dimension, key)
    if options.get("ratio", "global_ratio") not in ("global_ratio", "globalratio"):
        return diff(joined, on, min_ratio=min_ratio, **options)
    by_key = both.join(dimension.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.sum(OUTLIER_COLUMN).alias("o"), F.count("*").alias("n"))
    total = by_key.agg(F.sum("o").alias("o"), F.sum("n").alias("n")).first()
    if not total or not total["o"]:
        return diff(joined, on, min_ratio=min_ratio, **options)
    high = by_key.where(F.col("o") / F.col("n") >= min_ratio * total["o"] / total["n"] * (1 - 1e-12)).select(key)
    rows = dimension.join(high, key, "left_semi")
    seen = [rows.select(F.col(a).alias(f"_v{i}")).distinct().withColumn(f"_in{i}", F.lit(True)) for i, a in enumerate(on)]

    def with_marks(frame: DataFrame) -> DataFrame:
        for i, a in enumerate(on):
            frame = frame.join(seen[i], F.col(a).eqNullSafe(F.col(f"_v{i}")), "left")
        return frame

    marks = [F.coalesce(F.col(f"_in{i}"), F.lit(False)) for i in range(len(on))]
    kept = with_marks(dimension).where(reduce(or_, marks)).select(dimension.columns)
    metrics = [Metric("support", support(), options.get("min_support", 0.2), monotone=True), ratio_metric("global_ratio", min_ratio)]
    whole = {"outliers": float(total["o"]), "count": float(total["n"])}
    found = explain(both.join(kept, key), on, {"outliers": F.col(OUTLIER_COLUMN), "count": F.lit(1.0)}, metrics, options.get("max_combo", 3), whole=whole)
    # A value without a high key was counted in part only; nothing with it can be reported.
    found = with_marks(found).where(reduce(and_, [F.col(a).isNull() | m for a, m in zip(on, marks, strict=True)]))
    return found.select(*on, "support", "global_ratio", F.col("outliers").alias("outlier_count"), F.col("count").alias("total_count"))
