"""Exponentially damped streaming: reservoirs, scorers, thresholds, heavy hitters and itemsets.

Micro-batches are distributed relations; what a class keeps between them is bounded by a
capacity and is all that reaches the driver. Without a capacity all rows are kept, as relations.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import linear_quantiles
from ..operators.scoring import MAD_TO_SIGMA, covariance, exact_median
from ..runtime import checkpointed, quoted
from .windows import items_of, tracked_counts


def weighted_sample(df: DataFrame, k: int, weight: Column | float = 1.0, seed: int = 1) -> DataFrame:
    """``k`` rows, each drawn in proportion to its weight: the largest of u ** (1 / weight). One top-k, no full sort."""
    w = weight if isinstance(weight, Column) else F.lit(weight)
    key = F.log(F.rand(seed)) / w
    return df.withColumn("_key", key).orderBy(F.desc("_key")).limit(k).drop("_key")


class DampedReservoir:
    """At most ``capacity`` entries; an entry's weight falls by ``decay`` each period."""

    def __init__(self, capacity: int, decay: float = 0.01, seed: int = 1):
        self.capacity, self.decay = capacity, decay
        self.rng = np.random.default_rng(seed)
        self.growth = 1.0  # weight of an entry that comes now, relative to the first
        self.heap: list[tuple[float, int, object]] = []
        self.count = 0

    def advance(self, periods: float = 1.0) -> None:
        self.growth *= (1 - self.decay) ** -periods

    def insert(self, entry, weight: float = 1.0) -> None:
        # A larger key means a later exponential arrival in log space; overflow-free.
        key = -math.log(-math.log(self.rng.random())) + math.log(weight) + math.log(self.growth)
        self.count += 1
        if len(self.heap) < self.capacity:
            heapq.heappush(self.heap, (key, self.count, entry))
        elif key > self.heap[0][0]:
            heapq.heapreplace(self.heap, (key, self.count, entry))

    def entries(self) -> list:
        return [e for _, _, e in self.heap]


def fill(reservoir: DampedReservoir, df: DataFrame, columns: Sequence[str], seed: int = 1) -> None:
    """A sample of a micro-batch, of at most the capacity, each entry standing for its share of the rows."""
    n = df.count()
    rows = weighted_sample(df.select(*[F.col(quoted(c)).cast("double") for c in columns]).dropna(), reservoir.capacity, seed=seed).collect()
    for r in rows:
        reservoir.insert(tuple(r), n / len(rows))


class AllRows:
    """The metrics of every micro-batch, as relations in the checkpoint folder: a reservoir without a capacity.

    As a reservoir's decay decides which entries give way once it is full, it has nothing to decide here.
    """

    #: Relations kept side by side before they are made one.
    PARTS = 32

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.names = [f"m{i}" for i in range(len(self.columns))]  # dropna takes no dots
        self.parts: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        self.parts.append(checkpointed(batch.select(*[F.col(quoted(c)).cast("double").alias(m) for c, m in zip(self.columns, self.names, strict=True)]).dropna()))
        if len(self.parts) > self.PARTS:
            self.parts = [checkpointed(self.rows().coalesce(batch.sparkSession.sparkContext.defaultParallelism))]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.parts)


class DampedScorer:
    """Scores micro-batches by median and deviation (one metric) or a robust distance, refitted each period.

    The fit is on a reservoir, or exact on all rows so far if ``capacity`` is None.
    """

    def __init__(self, columns: Sequence[str], capacity: int | None = 10_000, decay: float = 0.01, warm_up: int = 1, seed: int = 1):
        self.columns = list(columns)
        self.reservoir = AllRows(columns) if capacity is None else DampedReservoir(capacity, decay, seed)
        self.batches, self.warm_up, self.seed = 0, warm_up, seed
        self.fit: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, batch: DataFrame, output: str = "_SCORE") -> DataFrame:
        if isinstance(self.reservoir, AllRows):
            self.reservoir.add(batch)
            self.fit = self._fit_rows(self.reservoir.rows(), self.reservoir.names) or self.fit
        else:
            fill(self.reservoir, batch, self.columns, self.seed + self.batches)
            self.reservoir.advance()
            x = np.array(self.reservoir.entries(), dtype=float).reshape(-1, len(self.columns))
            if len(x):
                self.fit = self._fit(x)
        self.batches += 1
        return batch.withColumn(output, self._column() if self.fit is not None and self.batches >= self.warm_up else F.lit(0.0))

    @staticmethod
    def _fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = np.median(x, axis=0)
        if x.shape[1] == 1:
            return centre, np.array([[np.median(np.abs(x - centre))]])
        low, high = np.percentile(x, [5, 95], axis=0)
        return centre, np.cov(np.clip(x, low, high), rowvar=False)

    @staticmethod
    def _fit_rows(rows: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """What ``_fit`` is on these rows, by order statistics that leave them where they are."""
        if rows.isEmpty():
            return None
        if len(names) == 1:
            centre = exact_median(rows, names[0])
            off = rows.select(F.abs(F.col(names[0]) - centre).alias("off"))
            return np.array([centre]), np.array([[exact_median(off, "off")]])
        centre, clipped = [], []
        for c in names:
            low, middle, high = linear_quantiles(rows, c, [0.05, 0.5, 0.95])
            centre.append(middle)
            clipped.append(F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)).alias(c))
        return np.array(centre), covariance(rows.select(*clipped), names)[1]

    def _column(self) -> Column:
        centre, spread = self.fit
        off = [F.col(quoted(c)).cast("double") - float(m) for c, m in zip(self.columns, centre, strict=True)]
        if len(off) == 1:
            return F.try_divide(F.abs(off[0]), F.lit(float(spread[0, 0]) * MAD_TO_SIGMA))
        inverse = np.linalg.pinv(spread)
        total = F.lit(0.0)
        for i, a in enumerate(off):
            for j, b in enumerate(off):
                total = total + a * b * float(inverse[i, j])
        return F.sqrt(F.greatest(total, F.lit(0.0)))


class DampedThreshold:
    """Marks scores at or above a percentile of a damped reservoir of scores, refreshed each micro-batch.

    The percentile is exact and of all scores so far if ``capacity`` is None.
    """

    def __init__(self, percentile: float = 0.99, capacity: int | None = 10_000, decay: float = 0.01, seed: int = 2):
        self.percentile, self.seed = percentile, seed
        self.reservoir = AllRows(["score"]) if capacity is None else DampedReservoir(capacity, decay, seed)
        self.threshold = math.inf
        self.batches = 0

    def classify(self, batch: DataFrame, score: str = "_SCORE", output: str = "_OUTLIER") -> DataFrame:
        if isinstance(self.reservoir, AllRows):
            self.reservoir.add(batch.select(F.col(quoted(score)).alias("score")))
            (cut,) = linear_quantiles(self.reservoir.rows(), *self.reservoir.names, [self.percentile])
            if not math.isnan(cut):
                self.threshold = cut
        else:
            fill(self.reservoir, batch, [score], self.seed + self.batches)
            self.reservoir.advance()
            if held := [e[0] for e in self.reservoir.entries()]:
                self.threshold = float(np.quantile(held, self.percentile))
        self.batches += 1
        x = F.col(quoted(score))
        return batch.withColumn(output, F.coalesce((x >= self.threshold) | F.isnan(x), F.lit(False)).cast("double"))


def top_items(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, exactly: one aggregation and a top-k."""
    c = F.col(quoted(column))
    return df.groupBy(c.alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)


class SpaceSaving:
    """At most ``capacity`` counters; counts over-report by at most the total over the capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts: dict[object, float] = {}
        #: (count, turn, item), some of them outdated: the least counter in logarithmic time.
        self.heap: list[tuple[float, int, object]] = []
        self.turn = 0

    def _set(self, item, count: float) -> None:
        self.counts[item] = count
        self.turn += 1
        heapq.heappush(self.heap, (count, self.turn, item))
        if len(self.heap) > 4 * self.capacity + 16:
            self._rebuild()

    def _rebuild(self) -> None:
        self.heap = [(n, i, item) for i, (item, n) in enumerate(self.counts.items())]
        self.turn = len(self.heap)
        heapq.heapify(self.heap)

    def add(self, item, n: float = 1.0) -> None:
        if item in self.counts or len(self.counts) < self.capacity:
            self._set(item, self.counts.get(item, 0.0) + n)
            return
        while True:
            least, _, out = heapq.heappop(self.heap)
            if self.counts.get(out) == least:
                break
        del self.counts[out]
        self._set(item, least + n)

    def add_all(self, counted: dict[object, float]) -> None:
        """A batch's counts, merged in one go."""
        for item, n in sorted(counted.items(), key=lambda kv: -kv[1]):
            self.add(item, n)

    def decay(self, factor: float) -> None:
        self.counts = {k: v * factor for k, v in self.counts.items()}
        self._rebuild()


class MaintainedCounter:
    """Over-reporting heavy hitters, cut back to the ``capacity`` largest at the end of each epoch."""

    def __init__(self, capacity: int):
        self.capacity, self.floor = capacity, 0.0
        self.counts: dict[object, float] = {}

    def add_all(self, counted: dict[object, float]) -> None:
        for item, n in counted.items():
            self.counts[item] = self.counts.get(item, self.floor) + n

    def end_epoch(self, factor: float = 1.0) -> None:
        kept = heapq.nlargest(self.capacity, self.counts.items(), key=lambda kv: kv[1])
        dropped = set(self.counts) - {k for k, _ in kept}
        self.floor = max([self.floor, *(self.counts[k] for k in dropped)]) * factor
        self.counts = {k: v * factor for k, v in kept}


class DampedItemsets:
    """Damped counts of attribute combinations among outliers and inliers, with a corrected risk ratio.

    A combination is tracked from the first micro-batch in which a share ``min_support`` of the outliers has it (at most
    sets / min_support new ones a batch), and counted in every batch from then on, with or without outliers; without a
    least support every combination is. A null value is a value like any other.
    """

    def __init__(self, attributes: Sequence[str], outlier: str = "_OUTLIER", decay: float = 0.01, min_support: float = 0.001, min_ratio: float = 3.0, max_order: int = 3):
        self.attributes, self.outlier, self.decay = list(attributes), outlier, decay
        self.min_support, self.min_ratio, self.max_order = min_support, min_ratio, max_order
        self.totals = [0.0, 0.0]
        self.counts: dict[tuple[int, tuple], list[float]] = {}

    def consume(self, batch: DataFrame) -> None:
        out, rest, here = tracked_counts(batch, self.attributes, self.outlier, self.max_order, list(self.counts), lambda n: max(1.0, self.min_support * n) if self.min_support else 0.0)
        factor = 1 - self.decay
        self.totals = [self.totals[0] * factor + out, self.totals[1] * factor + rest]
        self.counts = {s: [o * factor, i * factor] for s, (o, i) in self.counts.items()}
        for s, (o, i) in here.items():
            kept = self.counts.setdefault(s, [0.0, 0.0])
            kept[0] += o
            kept[1] += i
        # Those far below the support are no longer worth their place.
        least = self.min_support * self.totals[0] / 4
        self.counts = {s: c for s, c in self.counts.items() if c[0] >= least}

    def results(self) -> list[dict]:
        out = []
        for s, (o, i) in self.counts.items():
            items = items_of(s, self.attributes, self.max_order)
            r = corrected(o, i, self.totals[0] - o, self.totals[1] - i)
            if o >= self.min_support * self.totals[0] and (r >= self.min_ratio if len(items) > 1 else r > self.min_ratio):
                out.append({"items": items, "records": o, "support": o / self.totals[0], "ratio": r})
        return sorted(out, key=lambda x: (-x["records"], -len(x["items"]), str(sorted(x["items"].items(), key=str))))


def corrected(exposed_out: float, exposed_in: float, other_out: float, other_in: float) -> float:
    """The risk ratio less twice its standard error."""
    if exposed_out <= 0:
        return 0.0
    exposed, other = exposed_out + exposed_in, other_out + other_in
    if other <= 0:
        return 0.0
    if other_out <= 0:
        return math.inf
    return exposed_out / exposed / (other_out / other) - 2 * math.sqrt(max(0.0, exposed_in / exposed_out / exposed + 1 / other))


def one_shot(batches: Sequence[DataFrame], metrics: Sequence[str], attributes: Sequence[str], percentile: float = 0.99, **options) -> list[dict]:
    """Score, classify and summarise each micro-batch; the summary at the end."""
    scorer, threshold, summary = DampedScorer(metrics), DampedThreshold(percentile), DampedItemsets(attributes, **options)
    for batch in batches:
        summary.consume(threshold.classify(scorer.score(batch)))
    return summary.results()


def every(n: int, action: Callable[[], None]) -> Callable[[], None]:
    """Calls ``action`` on every ``n``-th call."""
    calls = 0

    def tick() -> None:
        nonlocal calls
        calls += 1
        if calls % n == 0:
            action()

    return tick


