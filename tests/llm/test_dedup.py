import random
import re
from itertools import combinations

import numpy as np
import pytest

from outlens.llm import prob_minhash as p
from outlens.llm.components import components

from .conftest import words


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def norm(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))


def plain_similarity(a, b):
    """Probability Jaccard by its definition."""
    x, y = (dict(zip(*(v.tolist() for v in p.shingles(t)), strict=True)) for t in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x if i in y)


def test_similarity_and_signatures():
    base = words(1, 150, 5000) + "a b c d e f a b c d e f".split()
    for k in (0, 2, 5, 12, 100):
        v = list(base)
        for i in random.Random(k).sample(range(150), k):
            v[i] = f"x{i}"
        a, b = " ".join(base), " ".join(v)
        s = p.similarity(p.shingles(a), p.shingles(b))
        assert s == pytest.approx(plain_similarity(a, b))
        sig = p.signatures([a, b], 4000)
        assert (sig[0] == sig[1]).mean() == pytest.approx(s, abs=0.04)
    # Equal weights: the plain Jaccard of sets.
    a, b = " ".join(map(str, range(100))), " ".join(map(str, range(10, 110)))
    assert p.similarity(p.shingles(a), p.shingles(b)) == pytest.approx(86 / 106)
    assert len(p.shingles("one two")[0]) == 1 and len(p.shingles("")[0]) == 0


def test_signatures_do_not_depend_on_the_batch():
    texts = [" ".join(words(i, 5 + 40 * i)) for i in range(6)]
    together = p.signatures(texts)
    assert all((p.signatures([t])[0] == together[i]).all() for i, t in enumerate(texts))


def brute(rows, threshold=p.THRESHOLD):
    """class by place of the row, comparing all pairs."""
    made = [p.shingles(norm(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if len(made[i][0]) and len(made[j][0]) and p.similarity(made[i], made[j]) >= threshold:
            root[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(k)
    return [(rows[i][0], min((x for x in ids[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def family(seed, n, edits, size=120):
    """A text and ``n`` copies of it with some words changed."""
    r = random.Random(seed)
    base = words(seed, size, 3000)
    out = [" ".join(base)]
    for k in range(n):
        v = list(base)
        for i in r.sample(range(size), edits):
            v[i] = f"e{seed}_{k}_{i}"
        out.append(" ".join(v))
    return out


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(p, "PART", 8)
    texts = family(1, 40, 2) + family(2, 10, 4) + family(3, 10, 6) + [t for i in range(10, 60) for t in family(i, 0, 0)]
    texts += [texts[0]] * 30 + [texts[0].upper(), texts[0].replace(" ", "  \n")]
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in p.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


@pytest.mark.parametrize("limit", [p.BROADCAST_TEXTS, 0])
def test_odd_rows(spark, odd, none, limit, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_TEXTS", limit)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.class_id) for r in p.near_duplicates(odd).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    kept = p.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((str(r.doc_id), norm(r.text)[:9]) for r in kept.collect())
    # One of {1, 2, 8, 9, 9}, one of the two rows without an id, the two texts of 7, and all rows without a word.
    assert [i for i, _ in ids] == sorted(["1", "3", "4", "5", "None", "7", "7", "10", "11", "12"])
    assert p.near_duplicates(none).count() == 0 and p.keep_one(none).count() == 0


@pytest.mark.parametrize("texts", [[None], ["", " \n", None, ""]])
def test_tables_without_a_word(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, p.near_duplicates(df).collect())) == [(i, i, True) for i in range(len(texts))]
    assert sorted(r.doc_id for r in p.keep_one(df).collect()) == list(range(len(texts)))


def test_a_partition_without_a_word(spark):
    base = " ".join(words(1, 80))
    df = spark.createDataFrame([(1, base), (2, base)], "doc_id long, text string").repartition(1)
    df = df.union(spark.createDataFrame([(3, ""), (4, None)], "doc_id long, text string").repartition(1))
    assert sorted(map(tuple, p.near_duplicates(df).collect())) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]


def test_clashing_columns_keep_their_values(spark):
    base = " ".join(words(1, 80))
    kind = "doc_id long, text string, _node string, _Class string, _keeper string, `_node_.a` string, bands string"
    rows = [(1, base, "a", "b", "c", "d", "e"), (2, base, "f", "g", "h", "i", "j"), (3, None, "k", "l", "m", "n", "o")]
    kept = p.keep_one(spark.createDataFrame(rows, kind))
    assert kept.columns == ["doc_id", "text", "_node", "_Class", "_keeper", "_node_.a", "bands"]
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_sketches():
    none = np.zeros((0, 320), np.uint64)
    assert p.sketches(none).shape == (0, 20) and p.band_keys(none).shape == (0, p.BANDS)
    owners = np.random.default_rng(0).integers(0, 2**63, (2, 320)).astype(np.uint64)
    owners[1, :256] = owners[0, :256]
    assert p.sketches(owners).shape == (2, 20)
    assert p.most_differing(0.8) > 320 * 0.2


def test_sketch_distance(spark):
    owners = np.random.default_rng(1).integers(0, 2**63, (2, 320)).astype(np.uint64)
    owners[1, :200] = owners[0, :200]
    a, b = p.sketches(owners).view(np.int64).tolist()
    d = spark.createDataFrame([(a, b)], "x array<long>, y array<long>").select(p.differing("x", "y")).first()[0]
    nibble = lambda v: [(int(np.uint64(np.int64(w))) >> s) & 15 for w in v for s in range(0, 64, 4)]
    assert d == sum(i != j for i, j in zip(nibble(a), nibble(b), strict=True)) <= 120
