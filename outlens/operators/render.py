"""Explanations as JSON and text."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame


def _number(v: float) -> str:
    return "Infinity" if v == math.inf else f"{v:.3f}"


def as_results(explanation: DataFrame, attributes: Sequence[str], metrics: Sequence[str], aggregates: Sequence[str]) -> list[dict]:
    """matcher, metric and aggregate of each combination; explanations are small by construction."""
    out = []
    for r in explanation.collect():
        out.append(
            {
                "matcher": {a: r[a] for a in attributes if r[a] is not None},
                "metric": {m: _number(r[m]) for m in metrics if r[m] is not None},
                "aggregate": {a: _number(r[a]) for a in aggregates},
            }
        )
    return out


def as_json(results: list[dict], total: float, outliers: float) -> str:
    return json.dumps({"results": results, "numTotal": total, "outliers": outliers}, ensure_ascii=False)


def as_text(results: list[dict], total: float, outliers: float) -> str:
    lines = [f"outliers: {outliers:g} of {total:g}"]
    for r in results:
        parts = [f"{k}={v}" for k, v in r["matcher"].items()]
        lines += ["", ", ".join(parts), *[f"  {k}: {v}" for part in ("metric", "aggregate") for k, v in r[part].items()]]
    return "\n".join(lines)
