"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Each rule is a score of a text, and texts at or above the rule's cutoff go. Each rule
has ``LEVELS`` cutoffs, fixed before any label is seen, from lenient to strict. A candidate verdict is a
set of rules (``SETS``) at one level: it rejects what any rule of the set rejects at that level.

Cutoffs come from labelled holdouts, per stratum (language). Of a stratum's distinct good texts (equal
texts count once, and as good if any label says so) that pass the base rules, a candidate rejects k of n.
It is certified if the exact binomial (Clopper-Pearson) upper bound of its false rejection rate is at most
``alpha``, that is if P(Bin(n, alpha) <= k) is at most ``delta`` over strata x sets (Bonferroni). The levels of a
set are nested, so they are tested in their fixed order, up to the first that fails, at no further cost. Of the
certified candidates that reject more bad texts than good ones, the one with the largest difference is used, the
most lenient of equal ones; a stratum without one rejects nothing beyond the base rules. So with probability
1 - delta the verdict of the method (all rules together) rejects at most a share ``alpha`` of the good texts of
every stratum.

Defined results: a null text has no words; null languages are one stratum; labels
with a null quality or without a document are ignored, and repeated labels or rows change nothing; repeated rows
are judged alike; texts may be of any length; a score equal to a cutoff reaches it; empty tables give no rows, and
empty labels certify nothing; further columns, whatever their names, are ignored by ``assess``, and ``keep_good``
returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, columns_of, fresh, text_or_empty, words_of

ALPHA = 0.02
DELTA = 0.05
#: Bounds of the base rules: fewest words, largest percentage of repeated words.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule -> cutoffs, from lenient to strict.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.2, 0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_lines": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "shouts": (3.0, 1.8, 1.2, 0.8, 0.5, 0.3, 0.2, 0.1),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "long_words": (40.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0),
    "short_words": (-1.5, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5),
}
LEVELS = 8
SETS: dict[str, tuple[str, ...]] = {
    "all": tuple(GRID),
    "marks": ("symbols", "shouts"),
    "repetition": ("repeats", "dup_lines"),
    "shape": ("capitals", "long_words", "short_words"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by 64-bit hash. A text without repeats costs one hash
    set; else windows are sorted with their places, and the union of the windows
    that equal a neighbour is measured.
    """

    def union_length(starts: Column) -> Column:
        step = lambda total, k: total + F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(3)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0), step))

    def covered(placed: Column) -> Column:
        # placed: (hash, place), sorted.
        same = lambda j, by: F.get(placed, j)["h"] == F.get(placed, j + by)["h"]
        hits = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda j: same(j, 1) | ((j > 0) & same(j, -1)))
        return let(F.sort_array(F.transform(hits, lambda j: F.get(placed, j)["i"])), union_length)

    def by_hash(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, covered))

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), by_hash))

    return let(words, windows)


def _dup_lines(text: Column) -> Column:
    """(lines with a word, those equal to an earlier line)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def measured(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the counts of each whole text."""
    text = text_or_empty()
    bare = F.translate(text, SPACES, "")
    p = prefix
    out = docs.withColumns(
        {
            f"{p}word_chars": F.length(bare).cast("long"),
            f"{p}n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            f"{p}_lines": _dup_lines(text),
            f"{p}n_shouts": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
            f"{p}n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            f"{p}_words": let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat"))),
        }
    )
    return out.withColumns(
        {
            f"{p}n_words": F.col(f"{p}_words.n").cast("long"),
            f"{p}n_repeat_words": F.col(f"{p}_words.repeat").cast("long"),
            f"{p}n_lines": F.col(f"{p}_lines.n").cast("long"),
            f"{p}n_dup_lines": F.col(f"{p}_lines.dup").cast("long"),
        }
    ).drop(f"{p}_words", f"{p}_lines")


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def scores(prefix: str = "") -> dict[str, Column]:
    words = F.greatest(F.col(f"{prefix}n_words"), F.lit(1)).cast("double")
    part = lambda c: F.col(f"{prefix}{c}") / words
    return {
        "symbols": part("n_symbols"),
        "repeats": part("n_repeat_words"),
        "dup_lines": F.col(f"{prefix}n_dup_lines") / F.greatest(F.col(f"{prefix}n_lines"), F.lit(1)).cast("double"),
        "shouts": part("n_shouts"),
        "capitals": F.col(f"{prefix}n_capitals") / F.greatest(F.col(f"{prefix}word_chars"), F.lit(1)).cast("double"),
        "long_words": part("word_chars"),
        "short_words": -part("word_chars"),
    }


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def most_rejections(n: Column, alpha: float, level: float) -> Column:
    """The largest k with P(Bin(n, alpha) <= k) <= level; -1 if there is none."""
    import math

    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct((n * math.log1p(-alpha)).alias("logp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        cdf = acc["cdf"] + F.exp(acc["logp"])
        after = acc["logp"] + F.log((n - k).cast("double") / (k + 1)) + odds
        return F.struct(F.coalesce(after, acc["logp"]).alias("logp"), cdf.alias("cdf"), F.when(cdf <= level, k).otherwise(acc["k"]).alias("k"))

    places = F.sequence(F.lit(0).cast("long"), F.ceil(n * alpha).cast("long"))
    return F.aggregate(places, start, step)["k"]


def certify(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (map of rule to cutoff): one row per stratum with a usable candidate.

    ``held``: labelled rows with lang, the counts of ``measured``, fingerprint (of the text) and quality.
    Texts that the base rules reject have no say.
    """
    level = {rule: sum(((score < c).cast("int") for c in GRID[rule]), F.lit(1)) for rule, score in scores().items()}
    reached = {name: F.least(*[level[r] for r in rules]) for name, rules in SETS.items()}
    rows = held.where(~base_failed()).select(stratum().alias("stratum"), "fingerprint", (F.col("quality") == 1).alias("good"), *[c.alias(n) for n, c in reached.items()])
    texts = rows.groupBy("stratum", "fingerprint").agg(F.max("good").alias("good"), *[F.min(n).alias(n) for n in SETS])
    each = texts.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(n).alias("set"), F.col(n).alias("level")) for n in SETS])).alias("c"))
    binned = each.groupBy("stratum", "c.set", "c.level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    over = Window.partitionBy("stratum", "set")
    down = over.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    summed = checkpointed(binned.withColumns({"k": F.sum("good").over(down), "caught": F.sum("bad").over(down), "n": F.sum("good").over(over)}))
    strata = max(1, summed.select(F.count_distinct("stratum")).first()[0])
    # k grows with the level, so what passes is a run of levels from the first on.
    certified = summed.where((F.col("n") > 0) & (F.col("k") <= most_rejections(F.col("n"), alpha, delta / (strata * len(SETS)))))
    useful = certified.where((F.col("level") <= LEVELS) & (F.col("caught") > F.col("k")))
    best = useful.groupBy("stratum").agg(F.max_by(F.struct("set", "level"), F.struct(F.col("caught") - F.col("k"), -F.col("level"), "set")).alias("best"))
    grid = F.create_map(*[x for rule, cuts in GRID.items() for x in (F.lit(rule), F.array(*map(F.lit, cuts)))])
    rules = F.element_at(F.create_map(*[x for name, rules in SETS.items() for x in (F.lit(name), F.array(*map(F.lit, rules)))]), F.col("best.set"))
    return best.select("stratum", F.map_from_arrays(rules, F.transform(rules, lambda r: F.element_at(F.element_at(grid, r), F.col("best.level")))).alias("cutoffs"))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality of all labels; a document with several has the best."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"))


#: Strata whose cutoffs may be broadcast, and labelled ids; more are joined by Spark's own choice.
BROADCAST_STRATA = 10_000
BROADCAST_LABELS = 1_000_000


def judged(rows: DataFrame, cutoffs: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` (with counts) with base_failed, rules (those broken) and kept."""
    key, cuts = f"{prefix}_stratum", f"{prefix}_cutoffs"
    small = cutoffs.count() <= BROADCAST_STRATA
    cutoffs = cutoffs.withColumnsRenamed({"stratum": key, "cutoffs": cuts})
    out = rows.join(F.broadcast(cutoffs) if small else cutoffs, stratum() == F.col(key), "left")
    broken = [F.when(score >= F.try_element_at(F.col(cuts), F.lit(rule)), F.lit(rule)) for rule, score in scores(prefix).items()]
    out = out.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}rules": F.array_join(F.array(*broken), ",")})
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rules") == "")).drop(key, cuts)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _narrow(docs: DataFrame) -> DataFrame:
    return measured(docs.withColumn("fingerprint", F.unhex(F.md5(text_or_empty())))).drop("text")


def assess(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, rules and kept for every row of ``docs``."""
    counts = checkpointed(_narrow(docs.select("doc_id", "lang", "text")))
    out = judged(counts, checkpointed(certify(counts.join(labelled(labels), "doc_id"), alpha, delta)))
    return out.select("doc_id", *COUNTS, "base_failed", "rules", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; no text is shuffled.

    Counts of labelled texts are taken twice, for the labels and in the final pass: that
    is cheaper than writing or shuffling all texts with them. If the labels are too many to be sent, the counts
    of all texts are taken and joined.
    """
    marks, bare = checkpointed(labelled(labels)), docs.select("doc_id", "lang", "text")
    few = marks.count() <= BROADCAST_LABELS
    held = _narrow(bare.join(F.broadcast(marks), "doc_id")) if few else _narrow(bare).join(marks, "doc_id")
    cutoffs = checkpointed(certify(held, alpha, delta))
    p = fresh(docs, "_q_")
    return judged(measured(docs, p), cutoffs, p).where(F.col(f"{p}kept")).select(columns_of(docs))
