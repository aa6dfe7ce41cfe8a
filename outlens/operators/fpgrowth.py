"""Emerging itemsets: frequent among outliers, with a high risk ratio; no limit on their size.

Plan: single values are kept by their outlier count and risk ratio; outliers are
reduced to kept values and aggregated by what is left. Up to ``CUBE_ATTRIBUTES`` attributes
the sets are a cube over that small table; beyond, the distributed FP-growth of the ML
library mines it. Only the sets found reach the driver, for the order-dependent rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import risk_ratio
from ..runtime import checkpointed, quoted

CUBE_ATTRIBUTES = 10
SCHEMA = "items map<string,string>, records double, support double, ratio double"


def string_attributes(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def _ratio(outliers: float, outlier_total: float, inliers: float, inlier_total: float) -> float:
    exposed, other = outliers + inliers, outlier_total + inlier_total - outliers - inliers
    if exposed == 0 or other == 0:
        return 0.0
    rest = outlier_total - outliers
    return float("inf") if rest == 0 else (outliers / exposed) / (rest / other)


def without_repeats(sets: list[tuple[frozenset, float]]) -> list[tuple[frozenset, float]]:
    """By count and size, descending; a set goes if the one before it (that stayed) has its count and contains it."""
    out: list[tuple[frozenset, float]] = []
    for s, n in sorted(sets, key=lambda x: (-x[1], -len(x[0]), sorted(x[0]))):
        if not (out and out[-1][1] == n and s <= out[-1][0]):
            out.append((s, n))
    return out


def emerging_itemsets(
    df: DataFrame, attributes: Sequence[str] | None = None, outlier: str = "_OUTLIER", min_support: float = 0.1, min_ratio: float = 3.0, combinations: bool = True
) -> DataFrame:
    """items (attribute -> value), records, support and ratio, by records and size descending.

    Outliers have a positive mark, inliers zero. Single values need a ratio above
    ``min_ratio``, larger sets at least that.
    """
    spark = df.sparkSession
    attributes = list(attributes or string_attributes(df))
    mark = F.col(quoted(outlier))
    names = [f"_a{i}" for i in range(len(attributes))]
    base = df.where((mark > 0) | (mark == 0)).select((mark > 0).alias("_out"), *[F.col(quoted(a)).cast("string").alias(n) for a, n in zip(attributes, names, strict=True)])
    outliers, inliers = base.agg(F.count_if("_out"), F.count_if(~F.col("_out"))).first()
    if not outliers:
        return spark.createDataFrame([], SCHEMA)

    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.col(n).alias("v")) for n in names]))
    single = base.select("_out", pairs.alias("p")).groupBy("p.a", "p.v").agg(F.count_if("_out").alias("outliers"), F.count("*").alias("count"))
    least = int(outliers * min_support)
    group = {k: F.col(k).cast("double") for k in ("outliers", "count")}
    ratio = risk_ratio(group, {"outliers": float(outliers), "count": float(outliers + inliers)})
    kept = checkpointed(single.where(F.col("v").isNotNull() & (F.col("outliers") >= max(1, least))).withColumn("ratio", ratio).where(F.col("ratio") > min_ratio))
    if not combinations or len(attributes) == 1:
        named = F.create_map(F.element_at(F.create_map(*[F.lit(x) for n, a in zip(names, attributes, strict=True) for x in (n, a)]), F.col("a")), F.col("v"))
        out = kept.select(named.alias("items"), F.col("outliers").cast("double").alias("records"), (F.col("outliers") / float(outliers)).alias("support"), "ratio")
        return out.orderBy(F.desc("records"))

    reduced = base
    for n in names:
        values = kept.where(F.col("a") == n).select(F.col("v").alias("_v"))
        reduced = reduced.join(values, F.col(n) == F.col("_v"), "left").withColumn(n, F.col("_v")).drop("_v")
    reduced = checkpointed(reduced.groupBy("_out", *names).agg(F.count("*").alias("_n")))
    threshold = max(1, int(outliers * min_support))
    if len(attributes) <= CUBE_ATTRIBUTES:
        full = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
        grouped = sum(((F.grouping(n) == 0).cast("int") for n in names), F.lit(0))
        cube = reduced.cube(*names).agg(F.sum(F.when(F.col("_out"), F.col("_n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("_out"), 0).otherwise(F.col("_n"))).alias("i"), grouped.alias("_size"))
        rows = cube.where((F.col("_size") > 0) & (full == F.col("_size")) & (F.col("o") >= threshold)).collect()
        found = {frozenset((a, r[n]) for a, n in zip(attributes, names, strict=True) if r[n] is not None): (float(r["o"]), float(r["i"])) for r in rows}
    else:
        found = _mined(reduced, attributes, names, threshold, outliers)
    sets = without_repeats([(s, o) for s, (o, _) in found.items()])
    out = []
    for s, n in sets:
        r = _ratio(n, outliers, found[s][1], inliers)
        if len(s) == 1 or r >= min_ratio:
            out.append((dict(sorted(s)), n, n / outliers, r))
    return spark.createDataFrame(out, SCHEMA)


def _mined(reduced: DataFrame, attributes: list[str], names: list[str], threshold: int, outliers: int) -> dict:
    """Frequent sets by the ML library, with their counts among inliers."""
    from pyspark.ml.fpm import FPGrowth

    items = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{i}="), n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    rows = reduced.select("_out", "_n", items.alias("items")).where(F.size("items") > 0)
    out = rows.where("_out").select("items", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    n = out.count()
    if not n:
        return {}
    # The library asks for at least ceil(share * n) transactions.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (threshold - 0.5) / n), minConfidence=1.0).fit(out.select("items"))
    sets = model.freqItemsets.where(F.col("freq") >= threshold).withColumnRenamed("items", "set")
    # A set meets the inliers that hold its last item.
    inl = rows.where(~F.col("_out")).select("_n", "items", F.explode("items").alias("_item"))
    met = (F.element_at("set", F.lit(-1)) == F.col("_item")) & (F.size(F.array_except("set", "items")) == 0)
    counted = sets.join(inl, met, "left").groupBy("set", "freq").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("i"))
    split = lambda x: (attributes[int(x.partition("=")[0])], x.partition("=")[2])
    return {frozenset(map(split, r["set"])): (float(r["freq"]), float(r["i"])) for r in counted.collect()}


def pruned(found: list[dict]) -> list[dict]:
    """By ratio descending; a set goes if it contains one with a higher ratio."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["ratio"], len(x["items"]), sorted(x["items"].items()))):
        if not any(y["items"].items() <= x["items"].items() for y in out):
            out.append(x)
    return out


def by_support(found: list[dict]) -> list[dict]:
    return sorted(found, key=lambda x: -x["support"])
