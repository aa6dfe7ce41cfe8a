"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Texts are lower-cased; their shingles are five consecutive words (a shorter text is
one shingle), weighted 1 + ln(count). Similarity is the probability Jaccard
J_P(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i); with equal
weights it is the plain Jaccard, and 1 - J_P is a metric. Pairs of at least
``THRESHOLD`` are linked; classes are the connected components.

Signatures: every shingle starts a Poisson process whose rate is its weight; each
arrival falls on a random register, and a register keeps its first arrival's shingle. A
shingle stops once its next arrival is later than the latest register. Two texts
agree on a register with probability J_P. ``BANDS`` bands of ``ROWS`` registers make the
candidates: a pair of similarity 0.8 shares one with probability 0.9994.

Exact copies (equal words) become one node first. Nodes of a bucket are compared
in rounds, each skipping pairs that are already in one class: each node with the
leader of its largest bucket (of its nodes the one with the most company in all its
buckets); then with those of its other buckets; then any pairs of a bucket that are
left, but those that the triangle inequality rules out, and those whose sketches (four
bits a register) differ by four standard deviations more than those of similarity 0.8. So
large groups of copies cost a few comparisons per node and no link is lost. For
a comparison each text is sent once to its leader's group, in parts of at most
``PART`` texts, and no row holds two texts.

Defined results: a document without a word (or with a null text) is a class of its
own; class_id is the least doc_id of the class (nulls aside; null if all are null);
repeated rows are copies; an empty table, or one of null and blank texts only, is no special
case; texts may be of any length (working arrays hold about ``PORTION`` characters, or one
text); further columns, whatever their names, are ignored, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, drop_held, fresh, mix64, prepare, text_or_empty, unit_open, words_of
from .components import components

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 40, 8
PART = 256
PORTION = 1_000_000
#: Texts (24 bytes each) whose list may be broadcast; a longer list is joined by shuffle.
BROADCAST_TEXTS = 1_000_000

_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.array(step, np.uint64)
        size, step = size + more, step * step % (1 << 64)
    return out


def shingles(norm: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of single-blank-parted words, sorted, and their weights.

    A shingle is a stretch of the text, so its hash is a difference of prefix sums.
    """
    if not norm:
        return np.zeros(0, np.uint64), np.zeros(0)
    raw = np.frombuffer(norm.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    blanks = np.flatnonzero(raw == 32)
    begin, end = np.append(0, blanks + 1), np.append(blanks, n)
    if len(begin) > SHINGLE:
        begin, end = begin[: -SHINGLE + 1], end[SHINGLE - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_P, n), out=sums[1:])
    h = mix64((sums[end] - sums[begin]) * _powers(_P_INVERSE, n)[begin] + (end - begin).astype(np.uint64))
    keys, counts = np.unique(h, return_counts=True)
    return keys, 1.0 + np.log(counts)


def signatures(texts: list[str], registers: int = BANDS * ROWS) -> np.ndarray:
    """(texts, registers) shingle hashes; each text has a word."""
    found = [shingles(t) for t in texts]
    size = [len(k) for k, _ in found]
    doc = np.repeat(np.arange(len(texts)), size)
    key = np.concatenate([k for k, _ in found])
    rate = np.concatenate([w for _, w in found])
    first = np.full(len(texts) * registers, np.inf)
    owner = np.zeros(len(first), np.uint64)
    time, state, origin = np.zeros(len(key)), key.copy(), key
    while len(doc):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(unit_open(state)) / rate
        at = doc * registers + (mix64(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = origin[won]
        latest = first.reshape(len(texts), registers).max(axis=1)
        go = time < latest[doc]
        doc, time, state, origin, rate = doc[go], time[go], state[go], origin[go], rate[go]
    return owner.reshape(len(texts), registers)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Texts in their order, by about ``PORTION`` characters: working arrays take some hundred bytes a word."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def band_keys(owners: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = owners.shape[1] // bands
    out = np.zeros((len(owners), bands), np.uint64)
    for i in range(rows):
        out = mix64(out ^ owners[:, i::rows][:, :bands]) + np.uint64(i)
    return mix64(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(owners: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a long."""
    four = (mix64(owners) >> np.uint64(60)).reshape(len(owners), owners.shape[1] // 16, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def differing(x: str, y: str, longs: int = BANDS * ROWS // 16) -> Column:
    """The number of registers on which two sketch columns differ."""
    folded = [f"(get({x}, {i}) ^ get({y}, {i}))" for i in range(longs)]
    folded = [f"({f} | shiftrightunsigned({f}, 1))" for f in folded]
    return F.expr(" + ".join(f"bit_count(({f} | shiftrightunsigned({f}, 2)) & {0x1111111111111111}L)" for f in folded))


def most_differing(threshold: float, registers: int = BANDS * ROWS) -> int:
    """Four standard deviations above the mean for texts of just ``threshold``."""
    p = (1 - threshold) * 15 / 16
    return math.ceil(registers * p + 4 * math.sqrt(registers * p * (1 - p)))


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = x[1][i], y[1][j]
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # Sorted by x_j / y_j: from i on x decides, before i y does; equal ratios may stand on either side.
    return float((1.0 / ((a[::-1].cumsum()[::-1] + only_x) / a + (b.cumsum() - b + only_y) / b)).sum())


def normalised(text: Column) -> Column:
    return F.array_join(words_of(F.lower(text)), " ")


def node_of(norm: Column) -> Column:
    """The node of a text: 16 bytes; null for a text without a word."""
    return F.when(norm != "", F.unhex(F.md5(norm)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, node, band keys and sketch of every row, written once."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for b in batches:
            nodes, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            one = {k: t for k, t in zip(nodes, texts, strict=True) if k is not None}
            parts = [signatures(t) for t in _portions(list(one.values()))]
            owners = np.concatenate(parts) if parts else np.zeros((0, BANDS * ROWS), np.uint64)
            longs = [dict(zip(one, x.view(np.int64).tolist(), strict=True)) for x in (band_keys(owners), sketches(owners))]
            lists = [pa.array([by.get(k) for k in nodes], pa.list_(pa.int64())) for by in longs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "node", "bands", "sketch"])

    norm = normalised(text_or_empty())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", node_of(F.col("norm")).alias("node"), "norm")
    return checkpointed(rows.mapInArrow(run, "doc_id long, node binary, bands array<long>, sketch array<long>"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of nodes with their similarity; written once."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = checkpointed(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART)).alias("part")))
    members = dealt.select(F.col("a").alias("leader"), "part", F.lit(1).alias("role"), F.col("b").alias("node"))
    leaders = dealt.select(F.col("a").alias("leader"), "part", F.lit(0).alias("role"), F.col("a").alias("node")).distinct()
    sent = checkpointed(members.union(leaders))
    wanted = checkpointed(sent.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_id")), "node"))
    wanted = wanted.withColumnRenamed("node", "_wanted")
    small = wanted.count() <= BROADCAST_TEXTS
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_or_empty().alias("_text"))
    # Only wanted texts are normalised, and, if the list is small enough to send, shuffled.
    texts = texts.join(F.broadcast(wanted) if small else wanted, F.col("_doc").eqNullSafe(F.col("_id")))
    texts = texts.select("_wanted", normalised(F.col("_text")).alias("norm"))
    rows = sent.join(texts, F.col("node") == F.col("_wanted")).select("leader", "part", "role", "node", "norm")
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        key = leading = None
        for batch in batches:
            out: list[tuple] = []
            for leader, part, role, node, norm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Another text of the same doc_id. As a join condition this would hash every text of the corpus.
                if hashlib.md5(norm.encode("utf-8")).digest() != node:
                    continue
                if not role:
                    key, leading = (leader, part), shingles(norm)
                elif key == (leader, part):
                    out.append((leader, node, similarity(leading, shingles(norm))))
            a, b, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "sim"])

    return checkpointed(rows.mapInArrow(run, "a binary, b binary, sim double").distinct())


def links(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, least doc_id, bands, sketch) and (node, root) of all nodes that are linked but not roots."""
    nodes = checkpointed(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowded = checkpointed(entries.join(sizes, "bucket"))
    # The text that near copies stem from shares most buckets with them, so it leads.
    fame = crowded.groupBy("node").agg(F.sum("n").alias("fame"))
    leaders = crowded.join(fame, "node").groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"))
    shared = checkpointed(crowded.join(leaders, "bucket"))
    star = shared.where(F.col("node") != F.col("leader"))

    best = star.groupBy(F.col("node").alias("b")).agg(F.max_by("leader", F.struct("n", "leader")).alias("a")).select("a", "b")
    seen = _verified(docs, nodes, best)
    linked = seen.where(F.col("sim") >= threshold)
    roots = components(linked)

    def apart(pairs: DataFrame) -> DataFrame:
        """Distinct new pairs (a, b) whose ends are in different classes as yet."""
        for side in ("a", "b"):
            named = roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
            pairs = pairs.join(named, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
        return pairs.where(F.col("_a") != F.col("_b")).select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")

    others = checkpointed(apart(star.select(F.col("leader").alias("a"), F.col("node").alias("b"))))
    if not others.isEmpty():
        more = _verified(docs, nodes, others)
        seen = seen.union(more)
        linked = seen.where(F.col("sim") >= threshold)
        if not more.where(F.col("sim") >= threshold).isEmpty():
            roots = components(linked)

    # Buckets that still hold several classes: all pairs across classes that the leader's distances allow.
    classes = roots.select("node", "root")
    member = shared.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = member.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket")
    near = seen.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("far"))
    rest = member.join(mixed, "bucket", "left_semi").where(F.col("node") != F.col("leader")).join(near, ["leader", "node"], "left")
    rest = checkpointed(rest.select("bucket", "node", "root", "far").join(nodes.select("node", "sketch", "bands"), "node"))
    left, right = (rest.select(*[F.col(c).alias(f"{c}_{s}") for c in rest.columns]) for s in "xy")
    allowed = F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= 1 - threshold + 1e-9, F.lit(True))
    alike = differing("sketch_x", "sketch_y") <= most_differing(threshold)
    # Once per pair: in the first bucket that both share. If one of them leads that one, they have been compared.
    once = F.col("bucket_x") == F.array_min(F.array_intersect("bands_x", "bands_y"))
    cross = left.join(right, (F.col("bucket_x") == F.col("bucket_y")) & (F.col("root_x") < F.col("root_y")) & allowed & alike & once)
    cross = cross.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    cross = checkpointed(cross.join(seen, ["a", "b"], "left_anti"))
    if not cross.isEmpty():
        more = _verified(docs, nodes, cross).where(F.col("sim") >= threshold)
        if not more.isEmpty():
            roots = components(linked.union(more))
    return nodes, roots


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), and nodes with class_id and keeper (the node that stands for the class)."""
    rows = _rows(docs)
    nodes, roots = links(docs, rows, threshold)
    named = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = named.groupBy("root").agg(F.min(least).alias("best"))
    return rows.select("doc_id", "node"), named.join(best, "root").select("node", F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("keeper"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and kept (doc_id = class_id) for every row of ``docs``."""
    rows, named = classes(docs, threshold)
    out = rows.join(named, "node", "left").withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class; rows without a word all stay.

    Texts are shuffled only if the list of keepers is too long to send, or if a keeper's row is
    repeated, id and all.
    """
    rows, named = classes(docs, threshold)
    keeper, known, node = (fresh(docs, n) for n in ("_keeper", "_class", "_node"))
    kept = checkpointed(named.where(F.col("node") == F.col("keeper")).select(F.col("node").alias(keeper), F.col("class_id").alias(known)))
    small = kept.count() <= BROADCAST_TEXTS
    to = F.broadcast(kept) if small else kept
    is_keeper = lambda r, key: (F.col(key) == F.col(keeper)) & r["doc_id"].cast("long").eqNullSafe(F.col(known))
    repeated = not rows.join(to, is_keeper(rows, "node")).groupBy("doc_id", "node").count().where(F.col("count") > 1).isEmpty()
    marked = docs.withColumn(node, node_of(normalised(text_or_empty())))
    first = marked.join(to, is_keeper(marked, node))
    first = first.dropDuplicates(["doc_id", node]) if repeated else first
    return first.select(columns_of(docs)).union(marked.where(F.col(node).isNull()).select(columns_of(docs)))
