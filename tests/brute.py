"""The explanation rules in plain Python, for small tables."""

from __future__ import annotations

import math
from itertools import combinations


def ratio_of(metric, o, t, O, T):  # noqa: E741, N803
    if metric == "global_ratio":
        return (o / t) / (O / T)
    if metric == "risk_ratio":
        if t == 0 or T - t == 0:
            return 0.0
        return math.inf if O - o == 0 else (o / t) / ((O - o) / (T - t))
    rest = 1 if t == o else t - o
    return (o / rest) / ((O or 1) / (T - O)) if T != O else math.nan


def explain(rows, attributes, support, ratio, metric="global_ratio", order=3, apart=()):
    """rows: (values by attribute, outlier weight, count). {frozenset of (attribute, value): (o, t)} of what is reported."""
    O, T = sum(r[1] for r in rows), sum(r[2] for r in rows)  # noqa: E741, N806
    if not O:
        return {}

    def grouped(k):
        out = {}
        for values, o, n in rows:
            for s in combinations(attributes, k):
                if any(len(g & set(s)) > 1 for g in apart):
                    continue
                key = frozenset((a, values[a]) for a in s)
                x = out.setdefault(key, [0.0, 0.0])
                x[0] += o
                x[1] += n
        return out

    found, growing = {}, {0: {frozenset()}}
    for k in range(1, order + 1):
        growing[k] = set()
        for key, (o, t) in grouped(k).items():
            if k > 1 and not all(frozenset([i]) in growing[1] for i in key):
                continue
            if o / O < support:
                continue
            if ratio_of(metric, o, t, O, T) >= ratio:
                if k < 3 or all(frozenset(p) in growing[2] for p in combinations(key, 2)):
                    found[key] = (o, t)
            else:
                growing[k].add(key)
    return found
