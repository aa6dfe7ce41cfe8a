"""Token counts by a compiled finite-state transducer.

For byte-level BPE the last token of every prefix of a piece is unique: a token
sequence is the encoding exactly if each token encodes to itself and each adjacent
pair encodes to itself. Reading a piece byte by byte thus is deterministic. The
vocabulary is compiled into one automaton that names the tokens ending at each byte;
with the last tokens of the prefixes it is a transducer whose transition on a byte
carries the number of tokens that it adds to (or takes from) the count, so a
piece's count is the sum along its path. Counts of pieces seen are kept.

Texts are cut into chunks. The map of a chunk is (head, count, tail): the text
before its first fixed piece boundary, the tokens of all pieces between fixed
boundaries, and the text after the last one. A boundary is fixed where white space
follows anything else, whatever stands around it. Maps compose associatively, so a
text's maps are combined by a balanced prefix scan, in the task that holds the text's row. Special tokens
count as the library counts them by default: one each, parting the text around them.

Transitions are followed, not tabulated: a table of states and transitions, compiled when first reached, gave
the same counts at more than twice the time, as new words mostly lead to new states.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts may be of any length, in one chunk or
many; repeated rows are counted once each, and there are no ties; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, prepare

#: Characters of a chunk.
CHUNK = 1 << 15
#: What a worker keeps before it starts anew: pairs of tokens, and characters of pieces with their counts.
MAX_PAIRS = 500_000
MAX_MEMO = 64 << 20
#: Longer pieces are counted each time; a kept piece costs so many characters besides its own.
LONGEST_KEPT, PIECE_COST = 64, 100

# The piece pattern of byte-level BPE as the tokenizer library defines it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space after something else. \s and \S agree with the piece pattern's classes.
_FIXED = regex.compile(r"(?<=\S)(?=\s)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts the tokens of pieces of byte-level BPE text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        # A token that its own bytes do not encode to never appears.
        self.tokens = {t for t in tokens if self._merge(t) == [t]}
        self.automaton = ahocorasick.Automaton()
        for t in self.tokens:
            self.automaton.add_word(t.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.pieces = regex.compile(PIECE)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}
        self.kept = 0

    def _merge(self, raw: bytes) -> list[bytes]:
        """BPE by its definition: the lowest-ranked adjacent pair first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._merge(a + b) == [a, b]
        return ok

    def piece(self, text: str) -> int:
        """Tokens of one piece: the sum of what its bytes' transitions emit.

        The automaton names, for each byte read, the tokens that end there, longest
        first; the one that may follow the prefix before it is the prefix's last token.
        """
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        last: list[bytes | None] = [None] * (len(raw) + 1)
        total = [0] * (len(raw) + 1)
        pairs, count, read = self.pairs, 0, -1
        for end, token in self.automaton.iter(raw):
            if end == read:
                continue
            start = end + 1 - len(token)
            if start:
                key = (last[start], token)
                if (ok := pairs.get(key)) is None:
                    ok = self._follows(*key)
                if not ok:
                    continue
            last[end + 1] = token
            total[end + 1] = total[start] + 1
            count += total[end + 1] - total[end]
            read = end
        return count

    def span(self, text: str) -> int:
        """Tokens of a text whose two ends are piece boundaries; no special tokens."""
        found = self.pieces.findall(text)
        counts = self.counts
        try:
            return sum(map(counts.__getitem__, found))
        except KeyError:
            if self.kept > MAX_MEMO:
                counts.clear()
                self.kept = 0
            more = {}
            for p in set(found).difference(counts):
                (counts if len(p) <= LONGEST_KEPT else more)[p] = self.piece(p)
                self.kept += PIECE_COST + len(p) if len(p) <= LONGEST_KEPT else 0
            return sum(counts[p] if p in counts else more[p] for p in found)

    # A chunk's map: (head, count, tail); count is None if the chunk has no fixed boundary.
    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        if not (first := _FIXED.search(text)):
            return text, None, ""
        begin, end = first.start(), self._last_fixed(text)
        return text[:begin], self.span(text[begin:end]), text[end:]

    @staticmethod
    def _last_fixed(text: str) -> int:
        """The last fixed boundary; searched backwards from the end."""
        size = 64
        while True:
            lo = max(0, len(text) - size)
            found = None
            for found in _FIXED.finditer(text, lo):  # noqa: B007
                pass
            if found:
                return found.start()
            if not lo:
                return 0
            size *= 8

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.span(a[2] + b[0]) + b[1], b[2]

    def _scan(self, text: str) -> int:
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.span(head) + (0 if count is None else count + self.span(tail))

    def count(self, text: str) -> int:
        total = 0
        parts = [text]
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            total = len(parts) - 1
        for p in parts:
            total += self.span(p) if len(p) <= CHUNK else self._scan(p)
        return total


def compiled(path: str) -> Transducer:
    """The worker's transducer, which outlives its tasks."""
    return held(("transducer", path), lambda: Transducer(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(tokenizer_path)
        for b in batches:
            counts = [fst.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
