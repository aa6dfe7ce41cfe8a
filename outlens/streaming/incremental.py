"""Explanations over a sliding window of panes, updated pane by pane.

State is bounded by the support: each tracked set held a share ``min_support`` of some pane's
outliers. Every pane costs two distributed aggregations; only tracked sets' counts reach
the driver. Counts of a set start when its tracking does, so they approximate a full recount; for
sets tracked since the first pane of the window they are one. Without a least support every set is tracked, and all
counts are a recount. A null value is a value like any other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.fpgrowth import _ratio
from .windows import items_of, tracked_counts

#: A set's place among the attribute sets, and its values.
Key = tuple[int, tuple]


class IncrementalExplainer:
    """Use ``process`` on each pane, or as the function of ``foreachBatch``."""

    def __init__(self, attributes: Sequence[str], outlier: str = "_OUTLIER", panes: int = 6, min_support: float = 0.1, min_ratio: float = 3.0, max_order: int = 3):
        self.attributes, self.outlier, self.panes = list(attributes), outlier, panes
        self.min_support, self.min_ratio, self.max_order = min_support, min_ratio, max_order
        self.totals: deque[tuple[float, float]] = deque(maxlen=panes)  # outliers, inliers
        self.tracked: dict[Key, deque[tuple[float, float]]] = {}

    def __call__(self, pane: DataFrame, _batch: int) -> None:
        self.process(pane)

    def process(self, pane: DataFrame) -> None:
        def least(outliers: float) -> float:
            if not self.min_support:
                return 0.0
            return self.min_support * outliers if self.min_support * outliers >= 1 else float("inf")

        outliers, inliers, here = tracked_counts(pane, self.attributes, self.outlier, self.max_order, list(self.tracked), least)
        self.totals.append((outliers, inliers))
        # Where all sets are tracked, one that is new was in none of the panes before.
        before = [] if self.min_support else [(0.0, 0.0)] * (len(self.totals) - 1)
        for s in {*self.tracked, *here}:
            self.tracked.setdefault(s, deque(before, maxlen=self.panes)).append(here.get(s, (0.0, 0.0)))
        self.tracked = {s: q for s, q in self.tracked.items() if self._supported(s)}

    def _since(self, s: Key) -> tuple[float, float, float, float]:
        q = self.tracked[s]
        totals = list(self.totals)[-len(q) :]
        return sum(o for o, _ in q), sum(i for _, i in q), sum(o for o, _ in totals), sum(i for _, i in totals)

    def _supported(self, s: Key) -> bool:
        o, i, outliers, _ = self._since(s)
        return o + i > 0 if not self.min_support else o > 0 and o >= self.min_support * outliers

    def results(self) -> list[dict]:
        """Tracked sets with enough support and risk ratio over the panes since they are tracked."""
        out = []
        for s in self.tracked:
            o, i, outliers, inliers = self._since(s)
            r = _ratio(o, outliers, i, inliers)
            if o > 0 and r >= self.min_ratio:
                out.append({"items": items_of(s, self.attributes, self.max_order), "records": o, "support": o / outliers, "ratio": r})
        return sorted(out, key=lambda x: (-x["ratio"], -x["records"], str(sorted(x["items"].items(), key=str))))
