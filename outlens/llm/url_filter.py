"""URL filters: domain rules first, then a naive Bayes score of segmented tokens.

Rules pair a host and a path prefix. A rule fits its host and all subdomains if the
url's path starts with the rule's path; the longest fitting rule decides. Urls
without a rule are scored: each label of the host is split into words by Viterbi
under a unigram model (log probability of the words of all page texts; unknown
stretches cost as much as a rare letter each), the path is split at marks, digits
becoming one token, and multinomial naive Bayes with add-one smoothing compares the
classes. It is trained on all urls that a rule decides.

All words and all tokens count, however rare; their counts stay in tables. A url is made of units
(runs of letters or digits of its host or path), and only distinct units are segmented and scored, by
joins of their substrings with the words and of their tokens with the log odds. The log odds of the
most frequent units, ``FEATURES`` at most, are broadcast, and urls with other units look these up by
a join: the parameter moves work between the two and changes no result.

Defined results: a null url or one without ``://`` has an empty host and path; it fits
no rule and has no token, so the prior decides; if a class was never seen (or no url
has a rule) the verdict is ``allow``; equal scores allow; rules are told apart by host and path, the longest
first; repeated rows are judged alike; urls and texts may be of any length; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepare

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FEATURES = 100_000
#: A host label has at most 63 characters, so a longer word can be part of none.
LONGEST_WORD = 63
#: Words of up to ``SHORT`` letters lie in many names: their join is dealt over ``SALTS`` keys each.
SHORT = 4
SALTS = 16
#: Substrings of names per Arrow batch.
SUBSTRINGS = 20_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _UPPER, _UPPER.lower()), F.regexp_extract(url, parts, 2)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, and the rule and verdict of the longest fitting rule (else null)."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    nothing = F.lit(None).cast("string")
    return out.withColumns({"rule": nothing if rule is None else rule, "ruled": nothing if verdict is None else verdict})


def level(n: Column) -> Column:
    """The class of a count: an eighth of a doubling."""
    return F.floor(F.log2(n.cast("double")) * 8)


def least_level(counts: DataFrame, size: int) -> float:
    """The lowest class down to which ``counts`` has at most ``size`` rows; infinite if the top class has more.

    The classes (a few hundred) are counted, so no task or driver holds more than the result.
    """
    per_level = sorted(((r.level, r["count"]) for r in counts.groupBy(level(F.col("n")).alias("level")).count().collect()), reverse=True)
    least, held = math.inf, 0
    for at, n in per_level:
        held += n
        if held > size:
            break
        least = at
    return least


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows of the largest ``n``, in whole classes; the others are for a join."""
    least = least_level(counts, size)
    return counts.where(level(F.col("n")) >= least) if least < math.inf else counts.where(F.lit(False))


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: all words of all page texts (tags, scripts and styles dropped)."""
    bare = F.regexp_replace(F.lower("html"), r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(bare, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """The most probable split of a name into words; ties go to the longer last word."""

    def __init__(self, logs: dict[str, float], least: float | None = None):
        """``least``: the log probability of the rarest word, if ``logs`` holds some words only."""
        self.logs = logs
        self.unknown = (min(logs.values(), default=0.0) if least is None else least) - math.log(30)
        self.memo: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[name] = [w for part in re.findall(r"[^\W\d_]+|\d+", name) for w in (["<num>"] if part.isdigit() else self._viterbi(part))]
        return self.memo[name]

    def _viterbi(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                word = name[start:end]
                log = self.logs.get(word, self.unknown if end - start == 1 else None)
                if log is not None:
                    options.append((best[start] + log, -start))
            score, start = max(options)
            best.append(score)
            back.append(-start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


_PARTS = re.compile(r"[^\W\d_]+|\d+")


def units(host: str, path: str) -> list[str]:
    """The runs of letters or digits of a url; those of the host are not segmented yet."""
    named = ["h:" + ("<num>" if t.isdigit() else t) for t in _PARTS.findall(host)]
    return named + ["p:" + ("<num>" if t.isdigit() else t.lower()) for t in _PARTS.findall(path)]


def tokens(host: str, path: str, split) -> list[str]:
    out = [f"h:{w}" for label in host.split(".") for w in split(label)]
    return out + [f"p:{'<num>' if t.isdigit() else t.lower()}" for t in _PARTS.findall(path)]


class Bayes:
    """Multinomial naive Bayes over counts by token and class."""

    def __init__(self, rows: list[tuple[str, str, int]], priors: dict[str, int]):
        seen: dict[str, dict[str, int]] = {}
        for token, kind, n in rows:
            seen.setdefault(token, {})[kind] = n
        self.classes = sorted(priors)
        totals = {k: sum(c.get(k, 0) for c in seen.values()) + len(seen) for k in self.classes}
        self.logs = {t: tuple(math.log((c.get(k, 0) + 1) / totals[k]) for k in self.classes) for t, c in seen.items()}
        every = sum(priors.values())
        self.prior = tuple(math.log(priors[k] / every) for k in self.classes)

    def block_odds(self, names: list[str]) -> float:
        """Log odds of ``block`` against ``allow``; tokens never seen say nothing."""
        if self.classes != ["allow", "block"]:
            return 0.0
        score = self.prior[1] - self.prior[0]
        for t in names:
            if logs := self.logs.get(t):
                score += logs[1] - logs[0]
        return score


def with_units(rows: DataFrame) -> DataFrame:
    """kind (the verdict of a rule, or null) and units of every url."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [units(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["kind", "units"])

    return rows.select("ruled", "host", "path").mapInArrow(cut, "kind string, units array<string>")


def salted_join(many: DataFrame, once: DataFrame, key: str) -> DataFrame:
    """Left join of ``many`` with ``once`` (unique keys), dealt over several keys where the key is short."""
    salts = F.when(F.length(key) <= SHORT, SALTS).otherwise(1)
    many = many.withColumn("salt", F.pmod(F.xxhash64("unit"), salts).cast("int"))
    return many.join(once.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), [key, "salt"], "left").drop("salt")


SUMS = ("allow", "block", "n")


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``names`` (unit, allow, block, n; units of hosts) with their tokens; ``words`` is checkpointed."""
    total, least = words.agg(F.sum("n"), F.min("n")).first()
    lowest = math.log(least / total) if total else 0.0
    schema = "unit string, allow long, block long, n long"

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch, at: list[int], found: list[str]) -> pa.RecordBatch:
            same = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(same) for c in b.columns), pa.array(found, pa.string())], names=[*b.schema.names, "word"])

        for b in batches:
            at, found = [], []
            for i, unit in enumerate(b.column(0).to_pylist()):
                for begin in range(2, len(unit)):
                    ends = range(begin + 1, min(begin + LONGEST_WORD, len(unit)) + 1)
                    found += [unit[begin:end] for end in ends]
                    at += [i] * len(ends)
                    if len(found) >= SUBSTRINGS:
                        yield made(b, at, found)
                        at, found = [], []
            yield made(b, at, found)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for unit, known in zip(b.column("unit").to_pylist(), b.column("known").to_pylist(), strict=True):
                words = Segmenter({w["word"]: math.log(w["seen"] / total) for w in known}, lowest).split(unit[2:])
                found.append([f"h:{w}" for w in words])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(pa.string()))], names=["unit", *SUMS, "tokens"])

    parts = names.select("unit", *SUMS).mapInArrow(substrings, schema + ", word string")
    met = salted_join(parts, words.select("word", F.col("n").alias("seen")), "word")
    known = F.collect_list(F.when(F.col("seen").isNotNull(), F.struct("word", "seen"))).alias("known")
    return met.groupBy("unit", *SUMS).agg(known).mapInArrow(split, schema + ", tokens array<string>")


def unit_odds(counts: DataFrame, words: DataFrame) -> DataFrame:
    """unit, n and odds (log odds of block, summed over its tokens; tokens never taught say nothing).

    ``counts`` (checkpointed): unit, allow and block (urls with a rule) and n (all urls), with multiplicity.
    """
    is_name = F.col("unit").startswith("h:") & (F.col("unit") != "h:<num>")
    names = checkpointed(segmented(counts.where(is_name), words))
    plain = counts.where(~is_name)
    parts = names.select("unit", "allow", "block", F.posexplode("tokens").alias("at", "token"))
    found = parts.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    taught = (F.col("allow") + F.col("block")) > 0
    seen = found.unionByName(plain.select(F.col("unit").alias("token"), "allow", "block")).where(taught)
    size, allow, block = seen.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    log = lambda kind, total: F.log((F.col(kind) + 1) / F.lit(float(max(1, total + size))))
    odds = F.when(taught, log("block", block) - log("allow", allow)).otherwise(F.lit(0.0)).alias("odds")
    by_token = salted_join(parts.select("unit", "at", "token"), found.select("token", odds), "token")
    # Summed in the order of the name: the same sum each time.
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "odds"))), F.lit(0.0), lambda total, x: total + x["odds"])
    summed = by_token.groupBy("unit").agg(in_order.alias("odds")).join(names.select("unit", "n"), "unit").select("unit", "n", "odds")
    return summed.unionByName(plain.select("unit", "n", odds))


def judge(pages: DataFrame, rules=RULES, features: int = FEATURES) -> DataFrame:
    """page_id, host, path, rule, verdict and odds (the method's log odds of block) for every row."""
    spark = pages.sparkSession
    prepare(spark)
    rows = ruled(pages, rules)
    per_kind = [F.count_if(F.col("kind") == k).alias(k) for k in ("allow", "block")]
    counts = with_units(rows).select("kind", F.explode("units").alias("unit")).groupBy("unit").agg(*per_kind, F.count("*").alias("n"))
    priors = {r.ruled: r["count"] for r in rows.where(F.col("ruled").isNotNull()).groupBy("ruled").count().collect()}  # two rows
    model = checkpointed(unit_odds(checkpointed(counts), checkpointed(word_counts(pages))))
    both = sorted(priors) == ["allow", "block"]
    prior = math.log(priors["block"] / sum(priors.values())) - math.log(priors["allow"] / sum(priors.values())) if both else 0.0
    least = least_level(model, features)
    shared = spark.sparkContext.broadcast({r.unit: r.odds for r in most_frequent(model, features).collect()})  # at most ``features`` rows

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            found = [units(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            odds = pa.array([sum((known[u] for u in us if u in known), prior) for us in found], pa.float64())
            rare = pa.array([[u for u in us if u not in known] for us in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, odds, rare], names=[*b.schema.names, "odds", "rare"])

    columns = ["page_id", "host", "path", "rule", "ruled"]
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string"
    out = rows.mapInArrow(scored, f"{schema}, odds double, rare array<string>")
    others = model if least == math.inf else model.where(level(F.col("n")) < least)
    if others.isEmpty():
        out = out.drop("rare")
    else:
        each = out.where(F.size("rare") > 0).withColumn("row", F.monotonically_increasing_id()).select("row", *columns, "odds", F.posexplode("rare").alias("at", "unit"))
        met = each.join(others.select("unit", F.col("odds").alias("more")), "unit")
        in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "more"))), F.col("odds"), lambda total, x: total + x["more"])
        looked_up = met.groupBy("row", *columns, "odds").agg(in_order.alias("sum")).select(*columns, F.col("sum").alias("odds"))
        out = out.where(F.size("rare") == 0).drop("rare").unionByName(looked_up)
    method = F.when(F.col("odds") > 0 if both else F.lit(False), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.col("odds") if both else F.lit(0.0).alias("odds"))
