"""The explanation lattice: combinations of up to three attribute values that pass all metrics.

A combination that passes is reported and not extended; one that fails a monotone metric is
dropped with all its supersets; any other may grow. Triples are reported only if all
their pairs could grow.

Plan: one pass aggregates single values, and with them the totals. A value that may grow has a share
``min_support`` of the outliers, so an attribute has at most 1 / min_support of them; they are numbered and
broadcast. A second pass emits, per row, the pairs of such values, each packed into one long, and
aggregates them; a third does so with the triples all of whose pairs may grow (of few attributes, the
second pass counts all triples too). All passes are combined map-side, so what is shuffled is bounded by the number of distinct combinations, not of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..runtime import checkpointed, quoted

#: Grouping sets of one expand; more are split over several.
SETS_AT_ONCE = 60
#: Values that may grow, up to which they are numbered and broadcast. With a positive support there are at
#: most attributes / support of them; beyond the limit, grouping sets over joined values are used.
PACKED_VALUES = 200_000
#: Sets of three attributes, up to which pairs and triples are counted in one pass: another one would cost more than the triples.
ONE_PASS = 10
#: Bits of a value's number in a packed combination.
BITS = 21
#: Rows that may be settled on the driver. The support bounds them beforehand: at most 1 / support
#: values of an attribute, or of a set of attributes, reach it.
LOCAL_ROWS = 20_000


def _passes(metrics: Sequence[Metric], monotone_only: bool) -> Column:
    out = F.lit(True)
    for m in metrics:
        if m.monotone or not monotone_only:
            v = F.col(m.name)
            out = out & F.coalesce((v >= m.threshold) & ~F.isnan(v), F.lit(False))
    return out


def _settled(df: DataFrame, most: float) -> DataFrame:
    """``df`` computed once: held by the driver if it can have no more than a few rows, else written."""
    if most > LOCAL_ROWS:
        return checkpointed(df)
    return df.sparkSession.createDataFrame(df.collect(), df.schema, verifySchema=False)


def _numbered(base: DataFrame, values: DataFrame, names: list[str], most: float) -> tuple[DataFrame, DataFrame]:
    """``base`` with a number (or null) for each attribute, and the numbered ``values`` (_a: attribute number, _v: value).

    Numbers start at 1 and ascend with the attributes, so pairs and triples never collide.
    """
    numbered = values.withColumn("_id", F.row_number().over(Window.orderBy("_a", "_v")).cast("long"))
    numbered = F.broadcast(_settled(numbered, most))
    rows = base
    for k, n in enumerate(names):
        own = numbered.where(F.col("_a") == k).select(F.col("_v").alias("_w"), F.col("_id").alias(f"_i{k}"))
        rows = rows.join(own, F.col(n) == F.col("_w"), "left").drop("_w", n)
    return rows, numbered


def _packed(rows: DataFrame, numbered: DataFrame, names: list[str], sets: list[tuple[str, ...]], sums: list[Column], pairs: DataFrame | None = None) -> DataFrame:
    """Sums of pairs or triples of numbered values, one long (``_p``) per combination.

    ``pairs``: a few packed pairs; triples with any other are dropped before they are aggregated.
    """
    ids = {n: F.col(f"_i{k}") for k, n in enumerate(names)}

    def pack(s: tuple[str, ...]) -> Column:
        out = ids[s[0]]
        for n in s[1:]:
            out = F.shiftleft(out, BITS).bitwiseOR(ids[n])  # null if any is absent
        return out

    measures = [c for c in rows.columns if c not in {f"_i{k}" for k in range(len(names))}]
    packed = rows.select(*measures, F.explode(F.array(*[pack(s) for s in sets])).alias("_p")).where(F.col("_p").isNotNull())
    if pairs is not None:
        p, one, two = F.col("_p"), (1 << BITS) - 1, (1 << 2 * BITS) - 1
        for pair in (F.shiftrightunsigned(p, BITS), p.bitwiseAND(two), F.shiftleft(F.shiftrightunsigned(p, 2 * BITS), BITS).bitwiseOR(p.bitwiseAND(one))):
            packed = packed.join(F.broadcast(pairs), pair == F.col("_pair"), "left_semi")
    packed = packed.groupBy("_p").agg(*sums)
    part = lambda k: F.shiftrightunsigned("_p", BITS * k).bitwiseAND((1 << BITS) - 1)
    out = packed.withColumns({"_x0": part(0), "_x1": part(1), "_x2": part(2)})
    for k in range(3):
        out = out.join(numbered.select(F.col("_id").alias(f"_x{k}"), F.col("_a").alias(f"_a{k}x"), F.col("_v").alias(f"_v{k}x")), f"_x{k}", "left")
    at = [F.coalesce(*[F.when(F.col(f"_a{k}x") == i, F.col(f"_v{k}x")) for k in range(3)]).alias(n) for i, n in enumerate(names)]
    order = F.when(F.col("_x2") > 0, 3).otherwise(2).alias("_order")
    return out.select(*at, *measures, order, "_p")


def _by_sets(base: DataFrame, values: DataFrame, names: list[str], sets: list[tuple[str, ...]], sums: list[Column], grouped) -> DataFrame:
    """As ``_packed`` for any number of values: others are nulled out by joins, then grouping sets are formed."""
    left = base
    for k, n in enumerate(names):
        own = values.where(F.col("_a") == k).select("_v")
        left = left.join(own, F.col(n) == F.col("_v"), "left").withColumn(n, F.when(F.col("_v").isNotNull(), F.col(n))).drop("_v")
    return grouped(left.groupBy(*names).agg(*sums), sets)


def _with_growing_pairs(triples: DataFrame, growing: DataFrame, names: list[str]) -> DataFrame:
    """Triples that pass, all of whose pairs could grow."""
    pairs = growing.select(F.struct(*names).alias("_pair"))
    triples = triples.where("_keep").withColumn("_whole", F.struct(*names))
    blank = F.lit(None).cast(triples.schema[names[0]].dataType)
    without = [F.when(F.col(n).isNotNull(), F.struct(*[(blank if m == n else F.col(m)).alias(m) for m in names])) for n in names]
    parts = triples.select("_whole", F.explode(F.array(*without)).alias("_pair")).where(F.col("_pair").isNotNull())
    ok = parts.join(pairs, "_pair", "left_semi").groupBy("_whole").agg(F.count("*").alias("_n")).where(F.col("_n") == 3).select("_whole")
    return triples.join(ok, "_whole", "left_semi").drop("_whole")


def explain(
    df: DataFrame,
    attributes: Sequence[str],
    aggregates: dict[str, Column],
    metrics: Sequence[Metric],
    max_order: int = 3,
    dependencies: Sequence[set[str]] = (),
    whole: dict[str, float] | None = None,
) -> DataFrame:
    """Attribute columns (null where absent), the aggregates, the metrics, ``order`` and ``present`` (the names of the attributes that are not absent).

    ``aggregates``: name -> value to be summed. ``dependencies``: groups of functionally
    dependent attributes, of which a combination holds at most one. ``whole``: totals to use
    instead of the relation's own. A null attribute value is a value like any other.
    """
    if not 1 <= max_order <= 3:
        raise ValueError("combinations have one to three attributes")
    attributes = list(dict.fromkeys(attributes))
    if missing := [a for a in attributes if a not in df.columns]:
        raise ValueError(f"columns not present: {missing}")
    names = [f"_a{i}" for i in range(len(attributes))]
    # A struct tells a null value from an absent one.
    base = df.select(*[F.struct(F.col(quoted(a)).cast("string").alias("v")).alias(n) for a, n in zip(attributes, names, strict=True)], *[c.cast("double").alias(f"_m_{k}") for k, c in aggregates.items()])
    sums = [F.sum(f"_m_{k}").alias(f"_m_{k}") for k in aggregates]
    def judged(grouped: DataFrame) -> DataFrame:
        values = {k: F.col(f"_m_{k}") for k in aggregates}
        out = grouped.select("*", *[m.column(values, whole) for m in metrics]).where(_passes(metrics, monotone_only=True))
        return out.withColumn("_keep", _passes(metrics, monotone_only=False))

    def sets_of(order: int) -> list[tuple[str, ...]]:
        apart = [{names[attributes.index(a)] for a in g if a in attributes} for g in dependencies]
        return [s for s in combinations(names, order) if all(len(g & set(s)) < 2 for g in apart)]

    def grouped(frame: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
        parts = []
        for at in range(0, len(sets), SETS_AT_ONCE):
            some = sets[at : at + SETS_AT_ONCE]
            used = sorted({n for s in some for n in s}, key=names.index)
            g = frame.groupingSets([[F.col(n) for n in s] for s in some], *[F.col(n) for n in used]).agg(*sums, F.grouping_id().alias("_set"))
            # Whole groups only: as many values as the set has attributes.
            full = {sum(1 << (len(used) - 1 - used.index(n)) for n in used if n not in s): len(s) for s in some}
            here = sum((F.col(n).isNotNull().cast("int") for n in used), F.lit(0))
            order = F.element_at(F.create_map(*[x for k, v in full.items() for x in (F.lit(k).cast("long"), F.lit(v))]), F.col("_set").cast("long"))
            g = g.withColumn("_order", order).where(here == F.col("_order"))
            blank = base.schema[names[0]].dataType
            parts.append(g.select(*[F.col(n) if n in used else F.lit(None).cast(blank).alias(n) for n in names], *[f"_m_{k}" for k in aggregates], "_order"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    share = max([m.threshold for m in metrics if m.monotone], default=0.0)
    most = lambda sets: len(sets) / share if share > 0 else float("inf")
    singles = grouped(base, [(n,) for n in names])
    if whole is None:
        # Every row has one value of the first attribute, so its groups add up to the relation.
        singles = checkpointed(singles)
        row = singles.where(F.col(names[0]).isNotNull()).agg(*sums).first()
        whole = {k: float(row[f"_m_{k}"] or 0.0) for k in aggregates}
    singles = _settled(judged(singles), most(names))
    columns = singles.columns
    found = singles.where("_keep")
    pairs = sets_of(2) if max_order > 1 else []
    if pairs:
        values = singles.where(~F.col("_keep")).select(F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)]).alias("_a"), F.coalesce(*names).alias("_v"))
        few = most(names) <= PACKED_VALUES or values.count() <= PACKED_VALUES
        triples = sets_of(3) if max_order > 2 else []
        together = pairs + (triples if len(triples) <= ONE_PASS else [])
        if few:
            rows, numbered = _numbered(base, values, names, most(names))
            larger = _packed(rows, numbered, names, together, sums)
        else:
            larger = _by_sets(base, values, names, together, sums, grouped)
        larger = _settled(judged(larger), most(together))
        two, third = larger.where(F.col("_order") == 2), larger.where(F.col("_order") == 3)
        found = found.union(two.where("_keep").select(columns))
        growing = two.where(~F.col("_keep"))
        if len(triples) > ONE_PASS:
            # Triples of attributes of which every two have a pair that may grow: at most as many rows as pairs of attributes.
            within = {frozenset(r[0]) for r in growing.select(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))).distinct().collect()}
            triples = [s for s in triples if all(frozenset(p) in within for p in combinations(s, 2))]
            if triples and few:
                bounded = most(pairs) <= PACKED_VALUES or growing.count() <= PACKED_VALUES
                third = _packed(rows, numbered, names, triples, sums, growing.select(F.col("_p").alias("_pair")) if bounded else None)
            elif triples:
                third = _by_sets(base, values, names, triples, sums, grouped)
            third = _settled(judged(third), most(triples)) if triples else third
        if triples:
            found = found.union(_with_growing_pairs(third, growing, names).select(columns))
    return found.select(
        *[F.col(f"{n}.v").alias(a) for a, n in zip(attributes, names, strict=True)],
        *[F.col(f"_m_{k}").alias(k) for k in aggregates], *[m.name for m in metrics], F.col("_order").alias("order"),
        F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(a)) for a, n in zip(attributes, names, strict=True)])).alias("present"),
    )
