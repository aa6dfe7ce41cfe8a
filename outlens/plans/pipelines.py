"""Pipelines from a configuration: load, classify, explain."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import ratio_metric
from ..operators import classify as c
from ..operators import summarize as s
from ..operators.density import mixture, mixture_group, on_grid
from ..operators.fpgrowth import emerging_itemsets
from ..operators.render import as_json, as_results, as_text
from ..operators.scoring import SCORE, scorer
from ..runtime import quoted
from ..sources.files import write_csv, write_json
from ..sources.loaders import load_uri


class ConfigError(ValueError):
    """A configuration that names something unknown."""


class Config:
    def __init__(self, values: dict[str, Any]):
        self.values = values

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(json.loads(text))

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        return cls.from_json(text) if path.endswith(".json") or text.lstrip().startswith("{") else cls(simple_yaml(text))

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(key, default)


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    if text[:1] in "[{":
        return json.loads(text)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def simple_yaml(text: str) -> dict[str, Any]:
    """Keys with scalars, lists of scalars and one level of maps: what configurations hold."""
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- "):
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(_scalar(bare.lstrip()[2:]))
        elif bare[0].isspace():
            k, _, v = bare.strip().partition(":")
            if not isinstance(out.get(key), dict):
                out[key] = {}
            out[key][str(_scalar(k))] = _scalar(v)
        else:
            k, _, v = bare.partition(":")
            key = str(_scalar(k))
            out[key] = _scalar(v)
    return out


@dataclass
class Explanation:
    """An explanation with its totals; ``rows`` is a small relation."""

    rows: DataFrame
    attributes: Sequence[str]
    metrics: Sequence[str]
    aggregates: Sequence[str]
    total: float
    outliers: float
    _results: list[dict] | None = field(default=None, repr=False)

    def results(self) -> list[dict]:
        if self._results is None:
            if "items" in self.rows.columns:
                self._results = [{"matcher": dict(r["items"]), "metric": {"support": f"{r['support']:.3f}", "risk_ratio": f"{r['ratio']:.3f}"}, "aggregate": {"outliers": f"{r['records']:.3f}"}} for r in self.rows.collect()]
            else:
                self._results = as_results(self.rows, self.attributes, self.metrics, self.aggregates)
        return self._results

    def json(self) -> str:
        return as_json(self.results(), self.total, self.outliers)

    def text(self) -> str:
        return as_text(self.results(), self.total, self.outliers)


def _totals(df: DataFrame, outlier: str, count: str | None) -> tuple[float, float]:
    n = F.sum(F.col(quoted(count)).cast("double")) if count else F.count("*").cast("double")
    total, outliers = df.agg(n, F.sum(F.col(quoted(outlier)))).first()
    return total or 0.0, outliers or 0.0


def _dependencies(config: Config, attributes: Sequence[str]) -> list[set[str]]:
    """Groups of attribute numbers, by name here."""
    if not config.get("useFDs", False):
        return []
    groups = config.get("functionalDependencies", [])
    return [{attributes[i] if isinstance(i, int) else i for i in g} for g in groups]


def _explained(df: DataFrame, config: Config, attributes: list[str], count: str | None, min_support: float, min_ratio: float) -> Explanation:
    ratio = config.get("ratioMetric", "global_ratio")
    rows = s.explain_outliers(df, attributes, c.OUTLIER, count, min_support, min_ratio, ratio, int(config.get("maxOrder", 3)), _dependencies(config, attributes))
    return Explanation(rows, attributes, ["support", ratio_metric(ratio, 0).name], ["outliers", "count"], *_totals(df, c.OUTLIER, count))


def _shift_explained(df: DataFrame, config: Config, attributes: list[str], min_support: float) -> Explanation:
    rows = s.explain_mean_shift(df, attributes, min_support, float(config.get("meanShiftRatio", 1.0)))
    total, outliers = df.agg(F.sum(F.col("_OUTLIERCOUNT") + F.col("_INLIERCOUNT")), F.sum("_OUTLIERCOUNT")).first()
    return Explanation(rows, attributes, ["outlier_support", "inlier_support", "mean_shift"], ["outlier_count", "inlier_count"], total or 0.0, outliers or 0.0)


class BatchPipeline:
    """Rows: percentile, predicate or countmeanshift classifiers; aplinear, fpgrowth or countmeanshift summarizers."""

    def __init__(self, config: Config):
        self.config = config
        self.attributes = list(config.get("attributes") or [])
        self.metric = config.get("metric")
        self.classifier = (config.get("classifier") or "percentile").lower()
        self.summarizer = (config.get("summarizer") or "apriori").lower()
        self.cutoff = config.get("cutoff", 1.0)
        self.op = config.get("predicate", "==")
        self.min_support = float(config.get("minSupport", 0.01))
        self.min_ratio = float(config.get("minRatioMetric", config.get("minRiskRatio", 3.0)))

    def load(self, spark: SparkSession) -> DataFrame:
        types = {} if isinstance(self.cutoff, str) else {self.metric: "double"}
        required = list(dict.fromkeys([*self.attributes, self.metric]))
        if mean := self.config.get("meanColumn"):
            types[mean] = "double"
            required.append(mean)
        return load_uri(spark, self.config.get("inputURI"), types, required)

    def classify(self, df: DataFrame) -> DataFrame:
        if self.classifier == "percentile":
            return c.percentile_classify(df, self.metric, float(self.cutoff), bool(self.config.get("includeHi", True)), bool(self.config.get("includeLo", True)))
        value = self.cutoff if isinstance(self.cutoff, str) else float(self.cutoff)
        if self.classifier == "predicate":
            return c.predicate_classify(df, self.metric, self.op, value)
        if self.classifier == "countmeanshift":
            return c.count_mean_shift_classify(df, self.metric, self.config.get("meanColumn"), self.op, value)
        raise ConfigError(f"unknown classifier: {self.classifier}")

    def explain(self, df: DataFrame) -> Explanation:
        if self.summarizer in ("apriori", "aplinear"):
            return _explained(df, self.config, self.attributes, None, self.min_support, self.min_ratio)
        if self.summarizer == "fpgrowth":
            rows = emerging_itemsets(df, self.attributes, c.OUTLIER, self.min_support, self.min_ratio)
            return Explanation(rows, self.attributes, ["support", "ratio"], ["records"], *_totals(df, c.OUTLIER, None))
        if self.summarizer == "countmeanshift":
            return _shift_explained(df, self.config, self.attributes, self.min_support)
        raise ConfigError(f"unknown summarizer: {self.summarizer}")

    def run(self, spark: SparkSession) -> Explanation:
        return self.explain(self.classify(self.load(spark)))


class CubePipeline:
    """Pre-aggregated rows: arithmetic, quantile, predicate, countmeanshift, meanshift or raw."""

    def __init__(self, config: Config):
        self.config = config
        self.attributes = list(config.get("attributes") or [])
        self.classifier = (config.get("classifier") or "arithmetic").lower()
        self.count, self.mean, self.std = (config.get(k) for k in ("countColumn", "meanColumn", "stdColumn"))
        self.quantiles = dict(config.get("quantileColumns") or {})
        self.metric, self.op, self.cutoff = config.get("metric"), config.get("predicate", "=="), config.get("cutoff", 1.0)
        self.include = {"include_high": bool(config.get("includeHi", True)), "include_low": bool(config.get("includeLo", True))}
        # The usual meaning of the two: a share for the support, a factor for the ratio.
        self.min_support = float(config.get("minSupport", 0.01))
        self.min_ratio = float(config.get("minRatioMetric", 3.0))
        if self.classifier not in ("arithmetic", "quantile", "predicate", "countmeanshift", "meanshift", "raw"):
            raise ConfigError(f"unknown classifier: {self.classifier}")

    def load(self, spark: SparkSession) -> DataFrame:
        numbers = {
            "arithmetic": [self.count, self.mean, self.std],
            "meanshift": [self.count, self.mean, self.std],
            "quantile": [self.count, *self.quantiles],
            "predicate": [self.count, *([] if isinstance(self.cutoff, str) else [self.metric])],
            "countmeanshift": [self.count, self.mean, *([] if isinstance(self.cutoff, str) else [self.metric])],
            "raw": [self.count, self.config.get("outlierColumn", c.OUTLIER)],
        }[self.classifier]
        required = list(dict.fromkeys([*self.attributes, *numbers, *([self.metric] if self.metric else [])]))
        request = {"headers": self.config.get("restHeader") or {}, "body": self.config.get("jsonBody"), "post": bool(self.config.get("usePost", False))}
        return load_uri(spark, self.config.get("inputURI"), dict.fromkeys(numbers, "double"), required, **request)

    def classify(self, df: DataFrame) -> DataFrame:
        percent = float(self.cutoff) if not isinstance(self.cutoff, str) else 1.0
        value = self.cutoff if isinstance(self.cutoff, str) else float(self.cutoff)
        if self.classifier == "arithmetic":
            return c.arithmetic_classify(df, self.count, self.mean, self.std, percent, **self.include)
        if self.classifier == "quantile":
            return c.quantile_classify(df, self.count, self.quantiles, percent, **self.include)
        if self.classifier == "predicate":
            return c.predicate_cube_classify(df, self.count, self.metric, self.op, value)
        if self.classifier == "countmeanshift":
            return c.count_mean_shift_classify(df, self.metric, self.mean, self.op, value, self.count)
        if self.classifier == "raw":
            outlier = self.config.get("outlierColumn", c.OUTLIER)
            return c.raw_classify(df, self.count, outlier).withColumn(c.OUTLIER, F.col(quoted(outlier)))
        return df

    def explain(self, df: DataFrame) -> Explanation:
        if self.classifier == "countmeanshift":
            return _shift_explained(df, self.config, self.attributes, self.min_support)
        if self.classifier == "meanshift":
            rows = s.explain_mean(df, self.attributes, self.count, self.mean, self.std, self.min_support, self.min_ratio)
            total = df.agg(F.sum(quoted(self.count))).first()[0] or 0.0
            return Explanation(rows, self.attributes, ["support", "mean_deviation"], ["count"], total, s.mean_outlier_count(df, self.count, self.mean, self.std, self.min_ratio))
        return _explained(df, self.config, self.attributes, self.count, self.min_support, self.min_ratio)

    def run(self, spark: SparkSession) -> Explanation:
        df = self.classify(self.load(spark))
        if self.config.get("debugDump", False):
            write_csv(df, self.config.get("dumpPath", "classified.csv"))
        return self.explain(df)


class GridPipeline:
    """Fits a scorer to ``metrics`` and writes its scores at the points of a regular grid: ``ranges`` (metric: [low, high]), ``steps``."""

    def __init__(self, config: Config):
        self.config = config
        self.metrics = list(config.get("metrics") or [])
        self.ranges = {m: tuple(map(float, (config.get("ranges") or {})[m])) for m in self.metrics}
        self.steps = int(config.get("steps", 20))

    def run(self, spark: SparkSession) -> DataFrame:
        df = load_uri(spark, self.config.get("inputURI"), dict.fromkeys(self.metrics, "double"), self.metrics)
        fit = scorer(self.config.get("scorer", "MAD_OR_MCD"), df, self.metrics)
        out = on_grid(lambda grid: grid.withColumn(SCORE, fit.score()), spark, self.ranges, self.steps)
        if path := self.config.get("dumpPath"):
            write_json(out, path)
        return out


class MixturePipeline:
    """Gaussian mixture of ``metrics``: rows of the component ``targetGroup`` are explained by ``attributes``."""

    def __init__(self, config: Config):
        self.config = config
        self.metrics, self.attributes = list(config.get("metrics") or []), list(config.get("attributes") or [])
        self.min_support, self.min_ratio = float(config.get("minSupport", 0.01)), float(config.get("minRatioMetric", 3.0))

    def run(self, spark: SparkSession) -> Explanation:
        df = load_uri(spark, self.config.get("inputURI"), dict.fromkeys(self.metrics, "double"), [*self.attributes, *self.metrics])
        rows = mixture_group(mixture(df, self.metrics, int(self.config.get("components", 3))), int(self.config.get("targetGroup", 0)))
        return _explained(rows, self.config, self.attributes, None, self.min_support, self.min_ratio)


def pipeline(config: Config) -> BatchPipeline | CubePipeline | GridPipeline | MixturePipeline:
    name = config.get("pipeline", "BasicBatchPipeline")
    kinds = {"BasicBatchPipeline": BatchPipeline, "CubePipeline": CubePipeline, "GridPipeline": GridPipeline, "MixturePipeline": MixturePipeline}
    if name not in kinds:
        raise ConfigError(f"unknown pipeline: {name}")
    return kinds[name](config)
