"""Language identification by language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: each cell holds one bit per language,
and an n-gram of a language sets that language's bit in its ``HASHES`` cells. The AND
of an n-gram's cells is the mask of all languages that contain it, read at once. A
text's masks are counted, and every n-gram votes for each language in its mask, with weight
ln((L + 1) / (q + 1)) where L is the number of languages and q the number of others in the mask: what all
languages contain tells little. Counts are corrected for false positives: a bit counts as
(bit - f) / (1 - f), where f is the share of set bits in the language's slice to the power ``HASHES``.
The language with the largest sum is the answer; its score is the corrected share of the text's
n-grams that it contains.

N-grams of 2 to 4 characters come from the lower-cased text with every run of
other characters than letters and their marks as one blank. The filter is fitted on a bounded
sample of labelled rows (about ``SAMPLE_ROWS`` per language, chosen by hash of
doc_id) and holds every n-gram found in at least a share ``LEAST_SHARE`` of a language's sampled texts.
Each whole text is read.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or
when no language was learned; equal sums go to the alphabetically first language; more
than ``MAX_LANGUAGES`` languages are an error; rows with a null lang or doc_id teach nothing, and
a null doc_id is not held out; repeated rows get equal results; texts may be of any length; an empty table
gives no rows; further columns, whatever their names, are ignored, and ``keep_identified`` returns them as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, drop_held, fresh, mix64, prepare

SAMPLE_ROWS = 2_000
LEAST_SHARE = 0.001
#: With so many languages the filter has rows of 64 bytes.
MAX_LANGUAGES = 512
#: The filter has ``ROOM`` cells or more for each n-gram of the largest language, and ``CELLS`` at most.
CELLS = 1 << 22
ROOM = 12
HASHES = 3
SIZES = (2, 3, 4)
#: Up to so many languages, masks are counted in a table of all masks.
TABLED = 12
UNDETERMINED = "und"

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def grams(text: str) -> np.ndarray:
    """64-bit keys of the n-grams of a text, with repeats; empty if it has no letter."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):
        return np.zeros(0, np.uint64)
    code = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    parts, rolled = [], code * _PRIMES[0]
    for n in range(2, SIZES[-1] + 1):
        if len(code) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * _PRIMES[n - 1] + code[n - 1 :]
        parts.append(rolled * np.uint64(8) + np.uint64(n))
    return np.concatenate(parts)


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The ``HASHES`` cells of each n-gram."""
    h = mix64(keys)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(cells)).astype(np.int64) for i in range(HASHES)]


def unpacked(masks: np.ndarray, languages: int) -> np.ndarray:
    """(masks, languages) booleans."""
    return np.stack([(masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) for k in range(languages)], axis=1).astype(bool)


@dataclass
class Filter:
    languages: list[str]
    cells: np.ndarray  # (cells, words of 64 languages)
    false_rate: np.ndarray
    table: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self):
        n = len(self.languages)
        if 0 < n <= TABLED:
            self.table = np.hstack(self._votes(unpacked(np.arange(1 << n, dtype=np.uint64)[:, None], n)))

    def masks(self, keys: np.ndarray) -> np.ndarray:
        first, *others = places(keys, len(self.cells))
        out = self.cells[first]
        for at in others:
            out &= self.cells[at]
        return out

    def _votes(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each mask, the weighted and the plain corrected vote for each language."""
        n = len(self.languages)
        true = (bits - self.false_rate) / (1 - self.false_rate)
        others = bits.sum(axis=1)[:, None] - bits
        return np.log((n + 1) / (np.arange(n) + 1))[others] * true, true

    def judge(self, text: str | None) -> tuple[str, float]:
        keys = grams(text) if text and self.languages else np.zeros(0, np.uint64)
        n = len(self.languages)
        if not len(keys):
            return UNDETERMINED, 0.0
        masks = self.masks(keys)
        if self.table is not None:
            sums = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << n) @ self.table
        else:
            found, counts = np.unique(masks, axis=0, return_counts=True)
            sums = counts @ np.hstack(self._votes(unpacked(found, n)))
        best = int(sums[:n].argmax())
        return self.languages[best], float(np.clip(sums[n + best] / len(keys), 0.0, 1.0))


def assembled(languages: list[str], cells: np.ndarray) -> Filter:
    """A filter of filled cells, with the false positive rate of each slice."""
    full = np.array([((cells[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filter(languages, cells, np.minimum(full**HASHES, 0.999))


def words_for(languages: int) -> int:
    return max(1, -(-languages // 64))


def build(by_language: dict[str, np.ndarray], cells: int = CELLS) -> Filter:
    """The filter of sets of n-grams held in memory."""
    languages = sorted(by_language)
    out = np.zeros((cells, words_for(len(languages))), np.uint64)
    for k, lang in enumerate(languages):
        for at in places(by_language[lang].astype(np.uint64), cells):
            out[np.unique(at), k // 64] |= np.uint64(1) << np.uint64(k % 64)
    return assembled(languages, out)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def contained(docs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """k (the language's place), gram: every n-gram that enough sampled texts of a language hold."""
    languages = sorted(sizes)

    def by_lang(value) -> Column:
        return F.element_at(F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), value(k, lang))]), F.col("lang"))

    share = by_lang(lambda k, lang: F.lit(min(1.0, SAMPLE_ROWS / sizes[lang])))
    pick = docs.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select(by_lang(lambda k, lang: F.lit(k)).alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            by: dict[int, list[np.ndarray]] = {}
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(np.unique(grams(text)))
            for k, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["k", "gram", "n"])

    counted = pick.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    least = F.get(F.array(*[F.lit(LEAST_SHARE * min(SAMPLE_ROWS, sizes[lang])) for lang in languages]), F.col("k"))
    return counted.where(F.col("n") >= least).select("k", "gram")


def fit(docs: DataFrame) -> Filter:
    """The filter from the rows of ``docs`` that are not held out and have text and lang."""
    prepare(docs.sparkSession)
    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, words = sorted(sizes), words_for(len(sizes))
    if not languages:
        return assembled(languages, np.zeros((1, words), np.uint64))
    # Bounded by the sample.
    held = checkpointed(contained(taught, sizes))
    most = held.groupBy("k").count().agg(F.max("count")).first()[0] or 1
    n_cells = min(CELLS, 1 << (ROOM * most - 1).bit_length())
    cells = np.zeros((n_cells, words), np.uint64)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy().astype(np.uint64)
            bits = (np.uint64(1) << (k % np.uint64(64))).view(np.int64)
            for at in places(b.column(1).to_numpy().view(np.uint64), n_cells):
                yield pa.RecordBatch.from_arrays([pa.array(at * words + (k // np.uint64(64)).astype(np.int64)), pa.array(bits)], names=["cell", "bits"])

    # One row per word of the filter at most: its size is bounded by the parameters.
    found = held.mapInArrow(filed, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells.reshape(-1)[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return assembled(languages, cells)


def judged(docs: DataFrame, model: Filter, name: str = "_judged") -> DataFrame:
    """``docs`` with ``name``: a struct of lang_pred and score. Reads the text alone."""
    prepare(docs.sparkSession)
    # The filter's size is bounded by its parameters: 32 MB for up to 64 languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        drop_held()
        return pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(name, judge("text"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    out = judged(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "_judged.lang_pred", "_judged.score")


#: Texts of a lower score are of no learned language.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` with a determined language and at least ``min_score``."""
    name = fresh(docs, "_judged")
    out = judged(docs, fit(docs), name)
    return out.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score)).select(columns_of(docs))
