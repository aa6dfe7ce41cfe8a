"""SQL texts of the operators, for a second engine to run on the same tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

RATIOS = {
    "global_ratio": "(o * 1.0 / t) / (tot.o_all * 1.0 / tot.t_all)",
    "risk_ratio": "CASE WHEN t = 0 THEN 0 WHEN tot.t_all - t = 0 THEN 0 WHEN tot.o_all - o = 0 THEN 'Infinity'::DOUBLE ELSE (o * 1.0 / t) / ((tot.o_all - o) * 1.0 / (tot.t_all - t)) END",
    "prevalence_ratio": "(o * 1.0 / CASE WHEN t = o THEN 1 ELSE t - o END) / ((CASE WHEN tot.o_all = 0 THEN 1 ELSE tot.o_all END) * 1.0 / (tot.t_all - tot.o_all))",
}


def lattice(base: str, attributes: Sequence[str], support: float, ratio: float, metric: str = "global_ratio", order: int = 3, apart: Sequence[set[str]] = (), with_order: bool = False) -> str:
    """The explanation of ``base`` (the attributes, o and n): the reported combinations with their metrics.

    Values, pairs and triples are grouping sets; those that may not grow are nulled out first.
    """
    a = list(attributes)
    names = ", ".join(a)
    ok = lambda s: all(len(g & set(s)) < 2 for g in apart)
    sets = lambda k: ", ".join(f"({', '.join(s)})" for s in combinations(a, k) if ok(s))
    filled = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in a)
    judged = lambda c, k: f"SELECT {c}.*, o * 1.0 / tot.o_all AS s, {RATIOS[metric]} AS r FROM {c}, tot WHERE {filled} = {k} AND o * 1.0 / tot.o_all >= {support}"
    grow = ", ".join(f"CASE WHEN {x} IN (SELECT {x} FROM e1 WHERE r < {ratio} AND {x} IS NOT NULL) THEN {x} END AS {x}" for x in a)
    parts = [
        f"b AS ({base})",
        "tot AS (SELECT sum(o) AS o_all, sum(n) AS t_all FROM b)",
        f"c1 AS (SELECT {names}, sum(o) AS o, sum(n) AS t FROM b GROUP BY GROUPING SETS ({sets(1)}))",
        f"e1 AS ({judged('c1', 1)})",
        f"b2 AS (SELECT {grow}, o, n FROM b)",
    ]
    found = [f"SELECT *, 1 AS k FROM e1 WHERE r >= {ratio}"]
    for k in range(2, order + 1):
        if not sets(k):
            continue
        parts += [f"c{k} AS (SELECT {names}, sum(o) AS o, sum(n) AS t FROM b2 GROUP BY GROUPING SETS ({sets(k)}))", f"e{k} AS ({judged(f'c{k}', k)})"]
        if k == 2:
            found.append(f"SELECT *, 2 AS k FROM e2 WHERE r >= {ratio}")
        else:
            inside = " AND ".join(f"(p.{x} IS NULL OR p.{x} = e3.{x})" for x in a)
            found.append(f"SELECT *, 3 AS k FROM e3 WHERE r >= {ratio} AND (SELECT count(*) FROM e2 p WHERE p.r < {ratio} AND {inside}) = 3")
    columns = f"{names}, round(s, 6) AS support, round(r, 6) AS {metric}, CAST(o AS DOUBLE) AS outlier_count, CAST(t AS DOUBLE) AS total_count" + (", k AS \"order\"" if with_order else "")
    return f"WITH {', '.join(parts)}, found AS ({' UNION ALL '.join(found)}) SELECT {columns} FROM found"


def r6(source: str, column: str, points: Sequence[float]) -> str:
    """One row of percentiles p0, p1, .. at position p (n + 1) / 100 between order statistics."""
    cols = []
    for i, p in enumerate(points):
        pos = f"({p} * (n + 1) / 100.0)"
        low, high = f"greatest(1, least(n, floor({pos})))", f"greatest(1, least(n, floor({pos}) + 1))"
        a, b = f"max(CASE WHEN rn = {low} THEN x END)", f"max(CASE WHEN rn = {high} THEN x END)"
        cols.append(f"{a} + (max({pos}) - floor(max({pos}))) * ({b} - {a}) AS p{i}")
    return f"SELECT {', '.join(cols)} FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {source}) q"


def weighted(source: str, value: str, weight: str, percent: float) -> str:
    """The data value at which the weights from the nearer end reach the whole part of their share."""
    table = f"(SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS downto, sum(w) OVER () AS total FROM (SELECT {value} AS v, sum({weight}) AS w FROM {source} GROUP BY 1) g) h"
    if percent <= 50:
        return f"(SELECT min(v) FROM {table} WHERE upto >= trunc(round({percent / 100} * total, 6)) - 1e-6)"
    return f"(SELECT max(v) FROM {table} WHERE downto >= trunc(round({(100 - percent) / 100} * total, 6)) - 1e-6)"


def normal_cdf(z: str) -> str:
    """The six-place table with linear interpolation."""
    from ..functions.stats import normal_table

    values = ", ".join(f"{v:.6f}" for v in normal_table())
    at = f"((greatest(-3.5, least(3.5, {z})) + 3.5) * 10)"
    low = f"CAST(least(floor({at}), 69) AS INTEGER)"
    return f"([{values}][{low} + 1] + ({at} - {low}) * ([{values}][{low} + 2] - [{values}][{low} + 1]))"
