"""Relational operators with the dialect's naming and null rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import quoted, ship_code


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By position, with the names of the first frame."""
    if not frames:
        raise ValueError("no frames")
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def filter_rows(df: DataFrame, column: str, test: Callable[[Column], Column] | Column | float | str) -> DataFrame:
    """Rows whose column passes a test, or equals a value (nulls included)."""
    c = F.col(quoted(column))
    return df.where(F.coalesce(test(c) if callable(test) else c.eqNullSafe(test), F.lit(False)))


def project(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """The columns that exist; unknown names are dropped, or an error if ``strict``."""
    unknown = [c for c in columns if c not in df.columns]
    if strict and unknown:
        raise ValueError(f"columns not present: {unknown}")
    return df.select(*[F.col(quoted(c)) for c in columns if c in df.columns])


def sort_key(column: str | Column, descending: bool = False, nulls: str | None = None) -> Column:
    """Ascending puts nulls last and descending first, unless told otherwise."""
    c = F.col(quoted(column)) if isinstance(column, str) else column
    first = nulls == "FIRST" if nulls else descending
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def common_column(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str = "left", right_name: str = "right", how: str = "inner") -> DataFrame:
    """Keys once, then the left and the right columns; names on both sides get their relation's name before a dot."""
    for side, frame in ((left_name, left), (right_name, right)):
        if missing := [k for k in keys if k not in frame.columns]:
            raise ValueError(f"{side} has no column {missing}")
    clash = {c for c in common_column(left, right) if c not in keys}
    a = left.select(*[F.col(quoted(c)).alias(f"{left_name}.{c}" if c in clash else c) for c in left.columns])
    b = right.select(*[F.col(quoted(c)).alias(f"{right_name}.{c}" if c in clash else c) for c in right.columns])
    return a.join(b, list(keys), how)


def natural_join(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right", how: str = "inner") -> DataFrame:
    keys = common_column(left, right)
    if not keys:
        raise ValueError("no common column")
    return equi_join(left, right, keys, left_name, right_name, how)


def item_counts(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attribute, value and n: how many rows hold each value of each attribute. One aggregation for all attributes."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(quoted(a)).cast("string").alias("value")) for a in attributes]))
    return df.select(pairs.alias("p")).groupBy("p.attribute", "p.value").agg(F.count("*").alias("n"))


def by_group(df: DataFrame, keys: Sequence[str], transform: Callable, schema: str) -> DataFrame:
    """``transform`` (pandas frame to pandas frame) on each group, in one task per group; for groups that fit in memory."""
    ship_code(df.sparkSession)
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).applyInPandas(transform, schema)


def pretty(df: DataFrame, rows: int = 20) -> str:
    """A table, or one value a line for more than ten columns; of more than ``rows`` rows the first and the last half."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        found = found[: (rows + 1) // 2] + df.tail(rows // 2)
    show = lambda v: "-" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    if len(df.columns) > 10:
        return "\n\n".join("\n".join(f"{c}: {show(r[i])}" for i, c in enumerate(df.columns)) for r in found)
    cells = [df.columns, *[[show(v) for v in r] for r in found]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = "-" * (sum(wide) + 3 * len(wide) + 1)
    text = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |" for r in cells]
    return "\n".join([line, text[0], line, *text[1:], line])
