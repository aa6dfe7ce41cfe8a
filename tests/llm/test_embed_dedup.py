import numpy as np
import pytest

from outlens.llm import embed_dedup as e

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(n_links, component) by row, comparing all pairs."""
    good = [r[0] is not None and r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1]) and r[2] is not None for r in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(r[0], links[i], least.get(find(i)), None if r[0] is None else r[0] == least[find(i)]) for i, r in enumerate(rows)]


def result(spark, rows):
    df = spark.createDataFrame([(r[0], None if r[1] is None else list(map(lambda v: None if v is None else float(v), r[1])), r[2]) for r in rows], KIND)
    return [tuple(r) for r in e.near_duplicates(df).collect()]


def near(r, x, cos):
    z = r.normal(size=len(x))
    z -= (z @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z)


def test_nearest_points_of_the_lattice():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    p = e.nearest_point(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert len(e.minimal_vectors()) == 240 and (d <= 1 + 1e-9).all()
    for v in e.minimal_vectors():
        assert (((x - p - v) ** 2).sum(axis=1) >= d - 1e-9).all()


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    unit = lambda v: v / np.linalg.norm(v)
    for g in range(12):  # groups from tight to loose, one of them large
        x = unit(r.normal(size=32))
        for _ in range(60 if g == 0 else 6):
            v = near(r, x, [0.995, 0.97, 0.96, 0.94][g % 4])
            rows.append((i, np.float32(v * r.uniform(0.5, 2)).tolist(), int(g % 3)))
            i += 1
    rows += [(i + k, np.float32(r.normal(size=32)).tolist(), k % 3) for k in range(60)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], 2), (902, rows[0][1], None)]
    assert sorted(result(spark, rows)) == sorted(brute(rows))


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        x = r.normal(size=64)
        x /= np.linalg.norm(x)
        rows += [(2 * k, x.tolist(), k % 4), (2 * k + 1, near(r, x, 0.9305).tolist(), k % 4)]
    got = {x[0]: x[1] for x in result(spark, rows)}
    want = {x[0]: x[1] for x in brute(rows)}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[k] <= want[k] for k in got)


def test_shared_cells_in_batches_of_any_size():
    import pyarrow as pa

    r = np.random.default_rng(3)
    rows = sorted({(int(b), int(n)) for b, n in zip(r.integers(0, 60, 300), r.integers(0, 12, 300), strict=True)}, key=lambda x: (x[0], -(x[1] & 1), x[1]))
    rows += [(99, 1)] * 5 + [(100, 4)] * 3 + [(101, 1), *[(101, 2 * k) for k in range(1, 40)]]
    of = {}
    for b, n in rows:
        of.setdefault(b, []).append(n)
    want = {(b, n) for b, ns in of.items() if any(x & 1 for x in ns) and len({x | 1 for x in ns}) > 1 for n in ns}
    for size in (1, 2, 7, len(rows)):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in c], pa.int64()) for k in (0, 1)], names=["bucket", "name"]) for c in cut]
        got = [x for b in e.shared_cells(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        # A core's probe of its own home's cell adds nothing.
        assert {(b, n) for b, n in want if n & 1 or n | 1 not in of[b]} <= set(got) <= want and len(got) <= len(want) + len(cut)


def test_looser_groups_cost_few_pairs(spark):
    """A topic whose vectors are all at cosine 0.85: no pair is a link, and few pairs are verified."""
    r = np.random.default_rng(9)
    z = r.normal(size=(1000, 64))
    z[:, 0] = 0
    z /= np.linalg.norm(z, axis=1)[:, None]
    x = np.sqrt(0.85) * np.eye(64)[0] + np.sqrt(0.15) * z
    cos = (x @ x.T)[np.triu_indices(1000, 1)]
    df = spark.createDataFrame([(f"{i:04d}".encode(), 1, v.tolist(), 0.0) for i, v in enumerate(x)], "core binary, label long, embedding array<double>, radius double")
    pairs = e._candidates(df, df.withColumnRenamed("embedding", "at"), 0.93).count()
    assert pairs < 0.05 * len(cos) and pairs >= 0.99 * (cos >= 0.93).sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 2.0], 1), (1, [1.0, 0.0, 2.0], 1), (2, [2.0, 0.0, 4.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [nan, 0.0, 1.0], 1),
        (8, [inf, 0.0, 1.0], 1), (None, [1.0, 0.0, 2.0], 1), (9, [1.0, 0.0, 2.0], None), (10, [1.0, 0.0, 2.0, 0.0], 1), (11, [-1.0, 0.0, -2.0], 1), (12, [1e-30, 0.0, 2e-30], 1),
    ]
    key = lambda x: tuple(map(str, x))
    assert sorted(result(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert result(spark, []) == []
