"""Hierarchical multi-length packing of token streams.

A document's ids (tokenizer ids, then the end id 1) lose their whole windows of
2048 first. The remainder is routed to the shortest context tier that holds it
(256, 512, 1024, 2048). Each pool of remainders is packed tier by tier, from the
longest: the longest remainders of a tier open windows of its length, the gap of a
window is filled best-fit from the same and the shorter tiers, and what is still
open takes the head of the next remainder. Only the end of a partition leaves an
unfilled window; its tokens are cut into sequences whose lengths are powers of two,
which need no padding. The sequences of each tier of a pool are dealt to step groups
so that the groups have as many of them and near equal attention cost (the sum of
squared piece lengths).

Each partition packs its own rows in one streaming pass: no shuffle, memory
bounded by one pool plus one document, and a lost task repeats alone with the same
result. Sequence ids are ``partition << 33 | local number``.

Defined results: a null or empty text is the one token [1]; texts may be of any length; repeated rows are
packed once each, and remainders of equal length in the order of the rows; an empty table gives no rows; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, prepare

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: A pool is packed once it holds so many tokens.
POOL_TOKENS = 1 << 19
#: Windows whose tokens make one optimiser step.
STEP_GROUP = 8
#: Units whose ids a worker keeps; beyond it the memo starts anew.
MEMO_UNITS = 1_000_000

#: Latin-1 letters: one code point each, lower-cased alone, untouched by normalisation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_CLOSING = f"([{_LETTERS}])([.,;:!?])"


class WordIds:
    """Ids of whole texts from a word tokenizer that never joins across white space.

    Texts are cut at ASCII blanks, and between a Latin-1 letter and a closing mark,
    where the tokenizer always parts; each distinct unit is encoded once and kept.
    New units of plain letters go to the library together, parted by blanks: each
    ends with a token that closes a word. Any other unit goes to it alone. That the tokenizer
    parts so is verified when it is loaded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._verify()
        self.clear()

    def _verify(self) -> None:
        """Probes of what ``batch`` and ``_add`` rely on; another kind of tokenizer is refused."""
        ids = lambda text: self.tok.encode(text, add_special_tokens=False).ids
        words = ["a", "the", "Straße", "Élan", "über", "zzqxj", "naïveté", "x" * 300]
        mixed = ["don't", "3.14", "a1b2", "#tag", "é́", "中文", "🙂", "x.y,z", "--", "<eos>", "a_b"]
        closed = all(sum(self.closes[ids(w)]) == 1 and self.closes[ids(w)[-1]] for w in words)
        parted = all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in words + mixed for b in words + mixed for gap in (" ", "\n", " \t "))
        marked = all(ids(f"{w}{mark}{w}") == ids(f"{w} {mark}{w}") for w in words for mark in ".,;:!?")
        if not (closed and parted and marked and not ids("") and not ids(" \t\n")):
            raise ValueError("this tokenizer does not part words at blanks and closing marks")

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.n, self.used = 1, 0

    def _keep(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + len(units) + 1 > len(self.starts):
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(units)] = self.used + ends
        self.index.update(zip(units, range(self.n, self.n + len(units)), strict=True))
        self.n, self.used = self.n + len(units), self.used + len(ids)

    def _add(self, units: list[str]) -> None:
        encode = lambda text: np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        plain = [u for u in units if _PLAIN.fullmatch(u)]
        if plain:
            ids = encode(" ".join(plain))
            self._keep(plain, ids, np.flatnonzero(self.closes[ids]) + 1)
        for u in set(units).difference(plain):
            ids = encode(u)
            self._keep([u], ids, np.array([len(ids)]))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        if self.n > MEMO_UNITS:
            self.clear()
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, pattern=_CLOSING, replacement=r"\1 \2"))
        units = split.flatten().dictionary_encode()
        names = units.dictionary.to_pylist()
        if new := [u for u in names if u not in self.index]:
            self._add(new)
        known = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        at = known[units.indices.to_numpy()]
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        counts = pc.list_value_length(split).to_numpy()
        cuts = np.append(0, ends)[np.cumsum(counts)]
        return [ids[a:b] for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True)]


def worker_ids(path: str) -> WordIds:
    """The worker's memo, which outlives its tasks."""
    return held(("ids", path), lambda: WordIds(path))


class Packer:
    """Pieces are (key, start, ids, doc_tokens); ``emit`` gets whole sequences."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.step = first_id
        self.pool: list[tuple] = []
        self.whole: list[list[tuple]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= WINDOW:
            self._sequence([(key, at, ids[at : at + WINDOW], n)], self.whole)
            at += WINDOW
        if at < n:
            self.pool.append((key, at, ids[at:], n))
        self.tokens += n
        if self.tokens >= POOL_TOKENS:
            self.pack(last=False)

    @staticmethod
    def _sequence(pieces: list[tuple], to: list[list[tuple]]) -> None:
        rows, offset = [], 0
        for key, start, ids, n in pieces:
            rows.append((key, start, ids, n, offset))
            offset += len(ids)
        to.append(rows)

    def _number(self, sequences: list[list[tuple]]) -> None:
        """Ids and step groups; per tier, the costliest sequences are dealt out first, to and fro."""
        cost = [sum(len(r[2]) ** 2 for r in rows) for rows in sequences]
        sizes = [sum(len(r[2]) for r in rows) for rows in sequences]
        tiers = [TIERS[bisect.bisect_left(TIERS, size)] for size in sizes]
        order = sorted(range(len(sequences)), key=lambda i: (-tiers[i], -cost[i], i))
        groups = max(1, -(-sum(sizes) // (STEP_GROUP * WINDOW)))
        for rank, i in enumerate(order):
            lap, at = divmod(rank, groups)
            group = self.step + (groups - 1 - at if lap % 2 else at)
            self.rows += [(*r, self.next_id, tiers[i], group) for r in sequences[i]]
            self.next_id += 1
        self.step += groups

    def pack(self, last: bool) -> None:
        # Sorted by length, the tiers are runs of this list; keys are lengths.
        items = sorted(self.pool, key=lambda p: len(p[2]))
        self.pool, self.tokens = [], 0
        sizes = [len(p[2]) for p in items]
        bounds = [bisect.bisect_right(sizes, t) for t in TIERS]
        tiers = [items[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]
        lengths = [[len(p[2]) for p in t] for t in tiers]
        done, self.whole = self.whole, []

        def take(tier: int, at: int) -> tuple:
            lengths[tier].pop(at)
            return tiers[tier].pop(at)

        while longest := next((k for k in range(len(TIERS) - 1, -1, -1) if tiers[k]), -1) + 1:
            held = [take(longest - 1, -1)]
            window = TIERS[longest - 1]
            gap = window - len(held[0][2])
            while gap:
                # Best fit from this tier downwards.
                for k in range(longest - 1, -1, -1):
                    if at := bisect.bisect_right(lengths[k], gap):
                        held.append(take(k, at - 1))
                        gap -= len(held[-1][2])
                        break
                else:
                    k = next((k for k in range(len(TIERS)) if tiers[k]), None)
                    if k is None:
                        break
                    key, start, ids, n = take(k, 0)
                    held.append((key, start, ids[:gap], n))
                    rest = (key, start + gap, ids[gap:], n)
                    tier = bisect.bisect_left(TIERS, len(rest[2]))
                    at = bisect.bisect_left(lengths[tier], len(rest[2]))
                    tiers[tier].insert(at, rest)
                    lengths[tier].insert(at, len(rest[2]))
                    gap = 0
            if gap and not last:
                self.pool, self.tokens = held, window - gap
                break
            if gap:
                self._tail(held, window - gap, done)
            else:
                self._sequence(held, done)
        if done:
            self._number(done)

    def _tail(self, pieces: list[tuple], total: int, done: list) -> None:
        """The last open window as sequences of descending powers of two."""
        for bit in range(total.bit_length() - 1, -1, -1):
            need = total & (1 << bit)
            held = []
            while need:
                key, start, ids, n = pieces.pop(0)
                held.append((key, start, ids[:need], n))
                if len(ids) > need:
                    pieces.insert(0, (key, start + need, ids[need:], n))
                need -= len(held[-1][2])
            if held:
                self._sequence(held, done)

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids."""
    prepare(docs.sparkSession)
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_ids(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33)

        def out() -> Iterator[pa.RecordBatch]:
            rows = packer.drain()
            for at in range(0, len(rows), 20_000):
                cols = [[], [], [], [], [], [], [], [], [], []]
                for key, start, ids, n, offset, seq, tier, group in rows[at : at + 20_000]:
                    for col, v in zip(cols, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, seq, offset, tier, group, ids.astype(np.int32) if with_ids else None), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encode.batch(b.column(1)), strict=True):
                packer.add(key, np.append(ids, np.uint32(END_ID)))
            yield from out()
        packer.pack(last=True)
        yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
