"""Sampled piece segmentations by forward filtering and backward sampling.

A text's lattice has an edge for each piece that matches at a position, with weight
exp(alpha * score). Forward filtering sums the weights of all paths to each
position; backward sampling then draws the last piece, the one before it, and so
on, each in proportion to its share, so a whole segmentation is drawn with its
exact probability. Random numbers are hashes of (seed, row key, unit, step), so the
same row always gets the same segmentation, in any task.

No piece crosses from a character to a following blank, and none holds a line
end; so the lattice parts into units there, exactly. A unit's filtered table is kept, and all
units of a batch are sampled together. Characters that no piece covers, and literal
U+2581, go to byte pieces, so decoding gives back every text.

Defined results: a null text is empty and has no piece; a null row key counts as 0;
repeated rows get equal samples; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, mix64, prepare, unit_open

BLANK = "▁"
#: Scores are ranks in this model; their weight is tempered.
ALPHA = 0.0005
SEED = 20240607
#: Positions of filtered units that a worker keeps before it starts anew.
MEMO_NODES = 5_000_000
#: Where the lattice parts; a long stretch without a blank is one unit, not cut.
_UNITS = re.compile(r"\n| *[^ \n]+| +")


class Lattice:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[int, float]] = {}
        self.bytes = [-1] * 256
        self.texts: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.texts.append(bytes([value]))
                continue
            self.texts.append(piece.replace(BLANK, " ").encode())
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                raise ValueError(f"piece {i} crosses a unit boundary")
            self.scores[piece.replace(BLANK, " ")] = (i, alpha * sp.get_score(i))
        if -1 in self.bytes:
            raise ValueError("the model lacks byte pieces")
        self.by_byte = alpha * min(sp.get_score(i) for i in range(sp.get_piece_size()))
        self._compile_trie()
        self.bytes_flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.bytes_start = np.cumsum([0, *map(len, self.texts)])
        self.byte_ids = np.array(self.bytes, np.int32)
        self.clear()

    def _compile_trie(self) -> None:
        """The pieces as a trie: sorted (node, character) keys, their targets, and each node's piece and weight."""
        nodes: dict[tuple[int, str], int] = {}
        piece, weight = [-1], [0.0]
        for text, (i, w) in self.scores.items():
            at = 0
            for c in text:
                if (at_next := nodes.get((at, c))) is None:
                    at_next = nodes[at, c] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                at = at_next
            piece[at], weight[at] = i, w
        keys = np.array([(n << 21) | ord(c) for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_next = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.trie_piece, self.trie_weight = np.array(piece, np.int32), np.array(weight)

    def clear(self) -> None:
        """Drops the filtered units. Nodes are (unit, position); edges end at nodes, in their order."""
        self.units: dict[str, int] = {}
        self.unit_first = np.zeros(1 << 12, np.int64)  # a unit's node at position 0
        self.node_edge = np.zeros(1 << 12, np.int64)  # a node's first edge
        self.edge_share = np.zeros(1 << 12, np.float64)  # cumulative within the node
        self.edge_piece = np.zeros(1 << 12, np.int32)  # -1: byte pieces of one character
        self.edge_chars = np.zeros(1 << 12, np.int32)
        self.n_nodes = self.n_edges = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        while len(a) < n:
            a = np.append(a, np.zeros_like(a))
        return a

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges of some units: node reached, characters, piece, log weight; and each unit's first node."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(length + 1) - (length + 1)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), length)
        start = np.arange(len(code)) + unit  # the node before each character
        end_of_unit = np.repeat(np.cumsum(length), length)
        at, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        origin, single = np.arange(len(code)), np.zeros(len(code), bool)
        to, chars, piece, weight = [], [], [], []
        k = 0
        while len(at):
            key = (state << 21) | code[at]
            found = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            ok = self.trie_keys[found] == key
            at, origin, state = at[ok] + 1, origin[ok], self.trie_next[found[ok]]
            k += 1
            hit = self.trie_piece[state] >= 0
            o = origin[hit]
            to.append(start[o] + k)
            chars.append(np.full(len(o), k))
            piece.append(self.trie_piece[state[hit]])
            weight.append(self.trie_weight[state[hit]])
            if k == 1:
                single[o] = True
            go = at < end_of_unit[origin]
            at, origin, state = at[go], origin[go], state[go]
        bare = np.flatnonzero(~single)  # characters that only byte pieces cover
        size = 1 + (code[bare] > 0x7F).astype(np.int64) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
        to.append(start[bare] + 1)
        chars.append(np.ones(len(bare), np.int64))
        piece.append(np.full(len(bare), -1, np.int32))
        weight.append(self.by_byte * size)
        to, chars, piece, weight = (np.concatenate(x) for x in (to, chars, piece, weight))
        order = np.argsort(to, kind="stable")
        return to[order], chars[order], piece[order], weight[order], first

    def add(self, units: list[str]) -> None:
        """Forward filtering of new units, all at once, position by position."""
        to, chars, piece, weight, first = self.edges(units)
        nodes = int(first[-1]) + len(units[-1]) + 1
        begins = np.searchsorted(to, np.arange(nodes + 1))
        degree = np.diff(begins)
        forward = np.zeros(nodes)
        position = np.arange(nodes) - np.repeat(first, np.diff(np.append(first, nodes)))
        by_position = np.argsort(position, kind="stable")
        levels = np.searchsorted(position[by_position], np.arange(1, int(position.max()) + 2))
        share = np.empty(len(to))
        for lo, hi in zip(levels[:-1], levels[1:], strict=True):
            at = by_position[lo:hi]
            d = degree[at]
            cuts = np.cumsum(d) - d
            e = np.repeat(begins[at] - cuts, d) + np.arange(int(d.sum()))
            logs = forward[to[e] - chars[e]] + weight[e]
            top = np.maximum.reduceat(logs, cuts)
            w = np.exp(logs - np.repeat(top, d))
            total = np.add.reduceat(w, cuts)
            forward[at] = top + np.log(total)
            run = np.cumsum(w)
            share[e] = (run - np.repeat(run[cuts] - w[cuts], d)) / np.repeat(total, d)
        share[begins[1:][degree > 0] - 1] = 1.0
        self.unit_first = self._room(self.unit_first, len(self.units) + len(units))
        self.unit_first[len(self.units) : len(self.units) + len(units)] = first + self.n_nodes
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))
        self.node_edge = self._room(self.node_edge, self.n_nodes + nodes)
        self.node_edge[self.n_nodes : self.n_nodes + nodes] = begins[:-1] + self.n_edges
        self.n_nodes += nodes
        for name, new in (("edge_share", share), ("edge_piece", piece), ("edge_chars", chars)):
            table = self._room(getattr(self, name), self.n_edges + len(to))
            table[self.n_edges : self.n_edges + len(to)] = new
            setattr(self, name, table)
        self.n_edges += len(to)

    def sample(self, units: np.ndarray, length: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward sampling of many units at once: unit's place, edge and start position of each piece, in text order."""
        place, begin = np.arange(len(units)), self.unit_first[units]
        node = begin + length
        found = []
        while len(place):
            u = unit_open(mix64(keys + np.uint64(0x9E3779B97F4A7C15)))
            edge = self.node_edge[node]
            more = np.flatnonzero(self.edge_share[edge] < u)
            while len(more):
                edge[more] += 1
                more = more[self.edge_share[edge[more]] < u[more]]
            node = node - self.edge_chars[edge]
            found.append((place, edge, node - begin))
            go = node > begin
            place, begin, node, keys = place[go], begin[go], node[go], mix64(keys[go])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        count = np.bincount(np.concatenate([f[0] for f in found]), minlength=len(units))
        ends = np.cumsum(count)
        out = tuple(np.empty(int(ends[-1]), np.int64) for _ in range(3))
        for step, f in enumerate(found):
            at = ends[f[0]] - 1 - step
            for to, values in zip(out, f, strict=True):
                to[at] = values
        return out

    def encode(self, texts: list[str], row_keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        if self.n_nodes > MEMO_NODES:
            self.clear()
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        flat = [u for s in split for u in s]
        if new := list(set(flat).difference(self.units)):
            self.add(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(self.units.__getitem__, flat), np.int64, len(flat))
        length = np.fromiter(map(len, flat), np.int64, len(flat))
        rows = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        row_hash = mix64(np.array(row_keys, np.int64).view(np.uint64) ^ mix64(np.array([seed], np.uint64)))
        place, edge, left = self.sample(ids, length, mix64(row_hash[rows] + within.astype(np.uint64)))
        piece, owner = self.edge_piece[edge], rows[place]
        if len(bare := np.flatnonzero(piece < 0)):
            raw = [flat[p][at].encode("utf-8", "surrogatepass") for p, at in zip(place[bare].tolist(), left[bare].tolist(), strict=True)]
            size = np.ones(len(piece), np.int64)
            size[bare] = [len(r) for r in raw]
            ends = np.cumsum(size)
            piece, owner = np.repeat(piece, size), np.repeat(owner, size)
            begins = ends[bare] - size[bare]
            where = np.repeat(begins - (np.cumsum(size[bare]) - size[bare]), size[bare]) + np.arange(int(size[bare].sum()))
            piece[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [piece[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        begin = self.bytes_start[ids]
        size = self.bytes_start[1:][ids] - begin
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.bytes_flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))].tobytes()

    def decode(self, ids) -> str:
        """The text; the blank that encoding puts first goes."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")[1:]


def compiled(path: str, alpha: float = ALPHA) -> Lattice:
    """The worker's tables, which outlive its tasks."""
    return held(("lattice", path, alpha), lambda: Lattice(path, alpha))


def segment(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless (decoding gave the text back) and, on demand, ids for every row; no shuffle."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_pieces", "ids_crc32", "lossless"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = compiled(model_path, alpha)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = lattice.encode(texts, [k or 0 for k in keys], seed)
            cols = [b.column(0), pa.array(map(len, found), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()), pa.array([lattice.decode_bytes(x)[1:] == t.encode("utf-8", "surrogatepass") for x, t in zip(found, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(found, pa.list_(pa.int32()))] * with_ids, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)
