"""Embedding near-duplicates by lattice hashing.

Vectors of one label and length are linked if their cosine, in double precision, is
at least ``THRESHOLD``. Each of ``TABLES`` tables projects the unit vectors on random
orthonormal directions, decodes two blocks of eight to their nearest E8 lattice
points, and files a vector under that cell; it also probes the cells of the neighbouring
lattice points nearest to it. With the default parameters a pair of cosine 0.93 meets in a cell
with probability 0.998. Vectors that meet are held against each other by sketches of
``BITS`` signs of random directions, inside the join that finds them: the share of differing bits
is their angle over pi, and pairs more than ``SIGMAS`` standard deviations beyond the threshold angle
go. The others are verified.

Dense groups cost no pairs. Equal vectors are one class. In a cell of the first
table, classes within half the threshold angle of the cell's mean form a core: any two of
them are linked by the triangle inequality, and are counted, not compared. Cells
file cores, not their members. Two cores are linked wholly or not at all where the angle of
their centres and their radii decide; only else members are compared, in blocks of at most
``BLOCK`` with counts as results.

Defined results: a row with a null label or vec_id, or a null, empty or zero vector
or one with null or non-finite components, links with nothing and is its own component
(null for a null vec_id); repeated rows are vectors of their own and link with each
other; of a component's vectors with equal least ids all are kept; vectors may be of any length, and
those of different lengths never link; an empty table gives no rows; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix64, prepare
from .components import components

THRESHOLD = 0.93
TABLES = 12
BLOCKS = 2
#: Edge of the lattice, in units of the root mean square of a unit vector's coordinates.
SCALE = 1.92
#: Nearest neighbouring cells probed.
PROBES = 4
#: Signs in a sketch, and standard deviations by which a pair's sketches may differ beyond its limit.
BITS = 1536
SIGMAS = 3.0
BLOCK = 256
#: Cells with fewer classes have no core.
MIN_CORE = 3
SEED = 93
SLACK = 1e-9


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


_NEAR = minimal_vectors()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(axis=1) % 2)
    off = x[odd] - out[odd]
    worst = np.abs(off).argmax(axis=1)
    out[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return out


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=64)
def directions(dim: int, table: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim, table])
    wide = 8 * BLOCKS
    if dim < wide:  # fewer coordinates than directions: plain Gaussian directions
        return rng.normal(size=(dim, wide)) / math.sqrt(wide)
    return np.linalg.qr(rng.normal(size=(dim, wide)))[0]


def _bucket(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt
    for column in (2 * points).astype(np.int64).T:
        h = mix64(h ^ column.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return mix64(h).view(np.int64)


def cells(unit: np.ndarray, labels: np.ndarray, table: int, probes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home cell, and (rows, probes) neighbouring cells, of one table."""
    n, dim = unit.shape
    x = (unit @ directions(dim, table)) * (math.sqrt(dim) / SCALE)
    blocks = [x[:, 8 * b : 8 * b + 8] for b in range(BLOCKS)]
    points = [nearest_point(b) for b in blocks]
    salt = mix64(labels.astype(np.int64).view(np.uint64) ^ mix64(np.array([dim * 1000 + table], np.uint64)))
    home = _bucket(np.concatenate(points, axis=1), salt)
    if not probes:
        return home, np.zeros((n, 0), np.int64)
    # |r - v|^2 = |r|^2 - 2 r.v + 2: the larger r.v, the nearer the neighbour.
    gain = [(b - p) @ _NEAR.T for b, p in zip(blocks, points, strict=True)]
    every = np.concatenate(gain, axis=1)
    best = np.argpartition(-every, PROBES, axis=1)[:, :PROBES]
    rows, out = np.arange(n), []
    for k in range(PROBES):
        moved = [p.copy() for p in points]
        for b in range(BLOCKS):
            at = rows[best[:, k] // 240 == b]
            moved[b][at] += _NEAR[best[at, k] % 240]
        out.append(_bucket(np.concatenate(moved, axis=1), salt))
    return home, np.stack(out, axis=1)


@lru_cache(maxsize=4)
def sketch_directions(dim: int) -> np.ndarray:
    """Random orthonormal bases side by side: their signs vary less than those of independent directions."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :BITS] for _ in range(-(-BITS // dim))], axis=1)[:, :BITS]


def sketches(x: np.ndarray) -> np.ndarray:
    """The signs along ``BITS`` random directions, 64 to a long."""
    return np.packbits(x @ sketch_directions(x.shape[1]) > 0, axis=1).view(np.int64)


def may_link(x: str, y: str, threshold: float) -> Column:
    """Whether two sketched balls, of columns sketch_x, radius_x, sketch_y and radius_y, may hold a pair of ``threshold``."""
    differing = F.expr(" + ".join(f"bit_count(get(sketch_{x}, {i}) ^ get(sketch_{y}, {i}))" for i in range(BITS // 64)))
    share = F.least((F.lit(math.acos(threshold)) + F.col(f"radius_{x}") + F.col(f"radius_{y}")) / math.pi, F.lit(1.0))
    return differing <= BITS * share + SIGMAS * F.sqrt(BITS * share * (1 - share))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, double matrix) for each length of vector in a list column without nulls."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, flat[offsets[at][:, None] + np.arange(dim)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _kind(vectors: DataFrame) -> str:
    """The type of the vectors; single precision is kept in tables, and becomes double for every product."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and key: 16 bytes naming (label, vector), null if the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for vec_id, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.array([], np.float64) if vec_id is None or label is None or not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = len(x) and not v.values.null_count and np.isfinite(x).all() and x.any()
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16, salt=int(label).to_bytes(8, "little", signed=True)).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=["vec_id", "label", "embedding", "key"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(_kind(vectors)))
    return rows.mapInArrow(run, f"vec_id long, label long, embedding {_kind(vectors)}, key binary")


def _with_cores(classes: DataFrame, half: float) -> DataFrame:
    """``classes`` with core (the least key of its core, or its own), angle to the core's centre, and the centre."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, cell = b.column("label").to_numpy(), np.zeros(len(b), np.int64)
            for at, x in _vectors(b.column("embedding")):
                cell[at] = cells(_unit(x), labels[at], 0, probes=False)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, out = b.column("cell").to_numpy(), ([], [])
            for at, x in _vectors(b.column("embedding")):
                names, which = np.unique(cell[at], return_inverse=True)
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, which, _unit(x))
                out[0].extend(names.tolist())
                out[1].extend(total.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64()))], names=["cell", "total"])

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = np.full(len(b), np.inf)
            has = np.flatnonzero(b.column("centre").is_valid().to_numpy(zero_copy_only=False))
            part = b.take(pa.array(has))
            for (at, x), (_, c) in zip(_vectors(part.column("embedding")), _vectors(part.column("centre")), strict=True):
                angle[has[at]] = np.arccos(np.clip((_unit(x) * _unit(c)).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle)], names=[*b.schema.names, "angle"])

    kind = f"key binary, id long, copies long, label long, embedding {_kind(classes)}"
    filed = checkpointed(classes.mapInArrow(home, f"{kind}, cell long"))
    crowded = filed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CORE).select("cell")
    inside = filed.join(crowded, "cell", "left_semi").select("cell", "embedding")
    by_place = inside.mapInArrow(sums, "cell long, total array<double>").select("cell", F.posexplode("total").alias("place", "value")).groupBy("cell", "place").agg(F.sum("value").alias("value"))
    # As many values as the vector has coordinates.
    centres = by_place.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("centre"))
    centres = checkpointed(centres.where(F.exists("centre", lambda v: F.abs(v) > 1e-6)))
    measured = checkpointed(filed.join(centres, "cell", "left").select(*[c.split(" ")[0] for c in kind.split(", ")], "cell", "centre").mapInArrow(angles, f"{kind}, cell long, centre array<double>, angle double"))
    heads = measured.where(F.col("angle") <= half).groupBy("cell").agg(F.min("key").alias("head"), F.count("*").alias("members")).where(F.col("members") > 1)
    own = F.col("head").isNotNull() & (F.col("angle") <= half)
    out = measured.join(heads, "cell", "left")
    return out.select(
        "key", "id", "copies", "label", "embedding", F.when(own, F.col("head")).otherwise(F.col("key")).alias("core"),
        F.when(own, F.col("angle")).otherwise(0.0).alias("angle"), F.when(own, F.col("centre")).alias("centre"),
    )


def shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of cells with a home and another core, of rows (bucket, name) sorted by bucket, homes first.

    Cells of any size pass through; of an unfinished cell only the first entry is kept for the next batch. A core's
    probe of its own home's cell may be missing.
    """
    bucket, name, sent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for b in batches:
        bucket, name = np.append(bucket, b.column(0).to_numpy()), np.append(name, b.column(1).to_numpy())
        sent = np.append(sent, np.zeros(len(b), bool))
        if not len(bucket):
            continue
        begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        run = np.cumsum(np.append(False, bucket[1:] != bucket[:-1]))
        first = name[begins]
        other = np.logical_or.reduceat((name | 1) != (first[run] | 1), begins)
        alive = ((first & 1) == 1) & other | sent[begins]
        again = np.append(False, (bucket[1:] == bucket[:-1]) & (name[1:] == name[:-1]))
        keep = alive[run] & ~sent & ~again
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(name[keep])], names=["bucket", "name"])
        last = begins[-1:]
        bucket, name, sent = bucket[last], name[last], alive[-1:]


def _candidates(members: DataFrame, cores: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of cores that meet in a cell of some table and whose sketches are alike.

    Cells name a core by a 64-bit hash: two cores of one hash would only mean more to verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, names = b.column(1).to_numpy(), b.column(0).to_numpy()
            for at, x in _vectors(b.column(2)):
                unit = _unit(x)
                for t in range(TABLES):
                    home, near = cells(unit, labels[at], t)
                    # The lowest bit tells homes from probes.
                    name = names[at] & ~np.int64(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(home, near.ravel())), pa.array(np.append(name | 1, np.repeat(name, near.shape[1])))], names=["bucket", "name"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _vectors(b.column(3)):
                out = pa.FixedSizeListArray.from_arrays(pa.array(sketches(_unit(x)).ravel()), BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:3]), out], names=["name", "core", "radius", "sketch"])

    name = F.xxhash64("core").bitwiseAND(F.lit(-2).cast("long"))
    filed = members.select(name.alias("name"), "label", "embedding").mapInArrow(run, "bucket long, name long")
    # Homes come first in their cell. Most cells hold one core, and go.
    live = checkpointed(filed.repartition("bucket").sortWithinPartitions("bucket", F.desc(F.col("name").bitwiseAND(F.lit(1).cast("long"))), "name").mapInArrow(shared_cells, "bucket long, name long"))
    entries = live.select("bucket", (F.col("name") % 2 != 0).alias("home"), F.col("name").bitwiseAND(F.lit(-2).cast("long")).alias("name"))
    named = cores.withColumn("name", name).join(entries.select("name").distinct(), "name", "left_semi").select("name", "core", "radius", "at")
    sketched = checkpointed(named.mapInArrow(sketch, "name long, core binary, radius double, sketch array<long>"))
    both = entries.join(sketched.drop("core"), "name")
    homes = both.where("home").select("bucket", *[F.col(c).alias(f"{c}_x") for c in ("name", "radius", "sketch")])
    others = both.select("bucket", "home", *[F.col(c).alias(f"{c}_y") for c in ("name", "radius", "sketch")])
    # Of two homes, the pair counts once.
    once = F.when(F.col("home"), F.col("name_x") < F.col("name_y")).otherwise(F.col("name_x") != F.col("name_y"))
    pairs = homes.join(others, "bucket").where(once & may_link("x", "y", threshold))
    pairs = pairs.select(F.least("name_x", "name_y").alias("lo"), F.greatest("name_x", "name_y").alias("hi")).distinct()
    first, second = (sketched.select(F.col("name").alias(n), F.col("core").alias(c)) for n, c in (("lo", "a"), ("hi", "b")))
    return pairs.join(first, "lo").join(second, "hi").select("a", "b")


def _judged(pairs: DataFrame, cores: DataFrame, threshold: float) -> DataFrame:
    """Pairs of cores with verdict: 1 all linked, -1 unsettled; pairs without a link are gone."""
    sides = [cores.select(*[F.col(c).alias(f"{c}_{s}") for c in ("core", "radius", "single", "at")]) for s in "ab"]
    met = pairs.join(sides[0], F.col("a") == F.col("core_a")).join(sides[1], F.col("b") == F.col("core_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = math.acos(threshold)
        for b in batches:
            verdict = np.zeros(len(b), np.int32)
            reach = b.column("radius_a").to_numpy() + b.column("radius_b").to_numpy()
            single = b.column("single").to_numpy(zero_copy_only=False)
            for (at, x), (_, y) in zip(_vectors(b.column("at_a")), _vectors(b.column("at_b")), strict=True):
                cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                apart = np.arccos(np.clip(cos, -1, 1))
                bound = np.where(apart + reach[at] <= limit - SLACK, 1, np.where(apart - reach[at] > limit + SLACK, 0, -1))
                verdict[at] = np.where(single[at], cos >= threshold, bound)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(verdict)], names=["a", "b", "verdict"])

    met = met.select("a", "b", "radius_a", "radius_b", (F.col("single_a") & F.col("single_b")).alias("single"), "at_a", "at_b")
    return checkpointed(met.mapInArrow(run, "a binary, b binary, verdict int").where(F.col("verdict") != 0))


def _compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Unsettled pairs of cores, member by member: (a, b, key, links) for members with a link."""
    wanted = pairs.select(F.col("a").alias("core")).union(pairs.select(F.col("b").alias("core"))).distinct()
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / (BLOCK // 2)))
    sizes = members.groupBy("core").agg(F.count("*").alias("n"))
    # Blocks hold BLOCK / 2 members on average, by hash.
    blocks = members.join(wanted, "core", "left_semi").join(sizes, "core").withColumn("part", part).groupBy("core", "part").agg(F.collect_list(F.struct("key", "copies", "embedding")).alias("rows"))
    blocks = checkpointed(blocks)
    left, right = (blocks.select(F.col("core").alias(c), F.col("rows").alias(f"rows_{c}")) for c in "ab")
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "rows_a", "rows_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for a, c, rows_a, rows_b in zip(*(x.to_pylist() for x in b.columns), strict=True):
                x, y = (np.array([r["embedding"] for r in rows]) for rows in (rows_a, rows_b))
                linked = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= threshold
                nx = linked @ np.array([r["copies"] for r in rows_b])
                ny = np.array([r["copies"] for r in rows_a]) @ linked
                out += [(a, c, r["key"], int(n)) for rows, counts in ((rows_a, nx), (rows_b, ny)) for r, n in zip(rows, counts, strict=True) if n]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "key", "links"])

    return checkpointed(met.mapInArrow(run, "a binary, b binary, key binary, links long"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    prepare(vectors.sparkSession)
    keyed = _keyed(vectors)
    rows = checkpointed(keyed.select("vec_id", "key"))
    some = F.any_value
    classes = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), some("label").alias("label"), some("embedding").alias("embedding"))
    members = checkpointed(_with_cores(classes, math.acos(threshold) / 2 - SLACK))

    cores = members.groupBy("core").agg(
        F.min("id").alias("id"), F.sum("copies").alias("size"), F.max("angle").alias("radius"), (F.count("*") == 1).alias("single"),
        F.coalesce(some("centre", True), some("embedding").cast("array<double>")).alias("at"),
    )
    cores = checkpointed(cores)
    judged = _judged(_candidates(members, cores, threshold), cores, threshold)
    whole, unsettled = judged.where(F.col("verdict") == 1), judged.where(F.col("verdict") == -1)
    compared = _compared(unsettled, members, threshold)

    sizes = cores.select("core", "size")
    there = whole.select(F.col("a").alias("to"), F.col("b").alias("core")).union(whole.select(F.col("b").alias("to"), F.col("a").alias("core")))
    by_core = there.join(sizes, "core").groupBy(F.col("to").alias("core")).agg(F.sum("size").alias("others"))
    by_key = compared.groupBy("key").agg(F.sum("links").alias("links"))
    counted = members.select("key", "core").join(cores.select("core", "size"), "core").join(by_core, "core", "left").join(by_key, "key", "left")
    zero = F.lit(0)
    counted = counted.select("key", "core", (F.col("size") - 1 + F.coalesce("others", zero) + F.coalesce("links", zero)).alias("n_links"))

    roots = components(whole.select("a", "b").union(compared.select("a", "b").distinct()))
    named = cores.select("core", "id").join(roots.withColumnRenamed("node", "core"), "core", "left").withColumn("root", F.coalesce("root", "core"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    found = counted.join(named.join(least, "root").select("core", "component_id"), "core").select("key", "n_links", "component_id")

    out = rows.join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", zero.cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
