"""URL filter, language ID, quality rules."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from outlens.llm import lang_id, quality, url_filter

PAGES = "page_id long, url string, html string, host string"


def test_rules(spark):
    rows = [
        (1, "https://a.com/x", "com/", "allow"), (2, "http://www.Example.com/en/1?q", "www.example.com/en/", "allow"), (3, "http://blog.example.com/en/1", "example.com/en/", "block"),
        (4, "http://example.com/de/1", "com/", "allow"), (5, "x://n.net/es/a#b", "net/es/", "block"), (6, "x://n.net/fr/", "net/fr/", "block"), (7, "http://a.com", None, None),
        (8, "http://badcom/x", None, None), (9, None, None, None), (10, "no scheme/com/", None, None), (11, "http://notexample.com/en/z", "com/", "allow"), (12, "http://É.com/\n/x", "com/", "allow"),
        (13, "http://net/es/1://x", "net/es/", "block"), (None, "http://a.com/?", "com/", "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "<p>words here</p>", "clash") for r in rows], PAGES)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for page_id, url, rule, verdict in rows:
        g = got[page_id]
        assert g.rule == rule and g.verdict in ("allow", "block") and (verdict is None or g.verdict == verdict)
        at = (url or "").find("://")
        rest = (url or "")[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        assert g.host == "".join(c.lower() if c.isascii() else c for c in host) and g.path == re.match(r"[^?#]*", rest[len(host) :])[0]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_segmentation_is_the_best_split():
    logs = {w: math.log(p) for w, p in {"free": 0.2, "bets": 0.1, "fre": 0.01, "e": 0.05, "be": 0.1, "ts": 0.01, "cheap": 0.1, "pills": 0.1}.items()}
    s = url_filter.Segmenter(logs)
    assert s.split("freebets") == ["free", "bets"] and s.split("cheap-pills24") == ["cheap", "pills", "<num>"]

    def best(name):
        if not name:
            return 0.0, []
        options = []
        for k in range(1, len(name) + 1):
            w = name[:k]
            log = logs.get(w, s.unknown if k == 1 else None)
            if log is not None:
                score, rest = best(name[k:])
                options.append((log + score, [w, *rest]))
        return max(options)

    r = random.Random(1)
    for _ in range(200):
        name = "".join(r.choice(["free", "bets", "be", "e", "x", "ts"]) for _ in range(4))[:12]
        score = lambda ws: sum(logs.get(w, s.unknown) for w in ws)
        assert score(s.split(name)) == pytest.approx(best(name)[0])


def test_bayes():
    b = url_filter.Bayes([("x", "block", 8), ("x", "allow", 1), ("y", "allow", 9)], {"allow": 5, "block": 5})
    assert b.block_odds(["x", "x"]) > 0 > b.block_odds(["y"]) and b.block_odds(["never"]) == 0
    assert url_filter.Bayes([], {}).block_odds(["x"]) == 0


def test_the_method_learns_from_ruled_urls(spark):
    rows = [(i, f"http://{'casinowin' if i % 2 else 'quiet'}{i}.{'net/es' if i % 2 else 'com'}/p/{i}", "<p>casino win quiet</p>" * 5, "") for i in range(60)]
    rows += [(100, "http://www.casinowin.org/p/1", "", ""), (101, "http://quiet.org/p/1", "", "")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[100].verdict, got[101].verdict, got[100].rule) == ("block", "allow", None)


def test_most_frequent_is_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(500)], "word string, n long")
    top = url_filter.most_frequent(counts, 100).collect()
    assert 0 < len(top) <= 100 and min(r.n for r in top) > 30
    assert url_filter.most_frequent(counts.limit(0), 5).count() == 0
    assert url_filter.most_frequent(spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long"), 1).count() == 0


def test_all_words_and_tokens_count(spark):
    """More words seen once than any model held, and few units by broadcast: as if all counts were in memory."""
    letters = "abcdefghij"
    rare = ["".join(letters[int(c)] for c in f"{i:05d}") + "q" for i in range(60_000)]
    rows = [(i, f"http://{'slotparlour' if i % 2 else 'quietmeadow'}x{i % 7}.{'net/es' if i % 2 else 'com'}/p{letters[i % 9]}/{i}", " ".join(rare[i * 1000 : i * 1000 + 1000]), "") for i in range(60)]
    rows += [(100, "http://parlour.org/p/1", "<p>slot parlour quiet meadow</p>", ""), (101, "http://meadowslot.org/pb/odd", "", ""), (101, "http://meadowslot.org/pb/odd", "", "")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    words = Counter(w for r in rows for w in re.findall(r"[a-z]+", re.sub("<[^>]*>", " ", r[2])))
    split = url_filter.Segmenter({w: math.log(n / words.total()) for w, n in words.items()}).split
    tokens = {r[1]: url_filter.tokens(*re.match(r"http://([^/]*)(.*)", r[1]).groups(), split) for r in rows}
    kinds = ["block" if ".net/es/" in r[1] else "allow" for r in rows[:60]]
    taught = Counter((t, k) for r, k in zip(rows[:60], kinds, strict=True) for t in tokens[r[1]])
    bayes = url_filter.Bayes([(t, k, n) for (t, k), n in taught.items()], Counter(kinds))
    want = sorted((r[0], bayes.block_odds(tokens[r[1]])) for r in rows)
    for features in (url_filter.FEATURES, 5, 0):
        got = sorted((r.page_id, r.odds) for r in url_filter.judge(df, features=features).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert tokens["http://meadowslot.org/pb/odd"][:2] == ["h:meadow", "h:slot"]


def test_language_accuracy_on_held_out(spark, sf, docs):
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


def test_languages_of_odd_rows(spark, odd, none):
    rows = lang_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 5))
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert lang_id.identify(none).count() == 0
    untaught = lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in untaught] == ["und"]
    kept = lang_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (3, 4, 5)").count() == 0


def test_filter_masks_and_false_positives():
    import numpy as np

    r = np.random.default_rng(0)
    sets = {f"l{i:03}": r.integers(0, 2**63, 500).astype(np.uint64) for i in range(70)}  # more than one word of languages
    f = lang_id.build(sets, 1 << 16)
    for k, lang in enumerate(f.languages):
        masks = f.masks(sets[lang])
        assert ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    other = f.masks(r.integers(0, 2**63, 20_000).astype(np.uint64))
    seen = np.mean([((other[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(70)])
    assert seen == pytest.approx(f.false_rate.mean(), abs=2e-3)


def exact_judge(sets, text):
    """The decision from exact sets of n-grams."""
    keys = lang_id.grams(text or "").tolist()
    langs = sorted(sets)
    if not keys or not langs:
        return "und", 0.0
    votes, share = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0)
    for key in keys:
        within = [x for x in langs if key in sets[x]]
        for x in within:
            votes[x] += math.log((len(langs) + 1) / len(within))
            share[x] += 1
    best = max(langs, key=lambda x: (votes[x], [-ord(c) for c in x]))
    return best, share[best] / len(keys)


def test_the_filter_against_exact_sets(spark, sf, docs):
    """Same decisions as from exact sets; all n-grams are filed, so masks of three and four languages occur."""
    import numpy as np

    taught = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~lang_id.is_held_out(F.col("doc_id")))
    by_lang = {}
    for x in taught.collect():
        by_lang.setdefault(x.lang, []).append(set(lang_id.grams(x.text).tolist()))
    sets = {}
    for lang, texts in by_lang.items():
        seen = Counter(g for t in texts for g in t)
        sets[lang] = {g for g, n in seen.items() if n >= lang_id.LEAST_SHARE * len(texts)}
    model = lang_id.fit(docs)
    assert model.languages == sorted(sets)
    for k, lang in enumerate(model.languages):
        assert lang_id.unpacked(model.masks(np.array(sorted(sets[lang]), np.uint64)), len(sets))[:, k].all()
    got = {(x.doc_id, x.lang_pred): x.score for x in lang_id.identify(docs).collect()}
    popcounts = Counter()
    for x in docs.collect():
        lang, score = exact_judge(sets, x.text)
        assert got[x.doc_id, lang] == pytest.approx(score, abs=0.03)
        if x.text:
            popcounts.update(lang_id.unpacked(model.masks(np.unique(lang_id.grams(x.text))), len(sets)).sum(axis=1).tolist())
    assert popcounts[3] and popcounts[4]


def test_near_identical_languages_are_all_kept(spark):
    r = random.Random(2)
    roots = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, i = [], 0
    for lang, ending in (("xa", "um"), ("xb", "ov"), ("xc", "ig")):
        for _ in range(60):
            rows.append((i, " ".join(w + ending if r.random() < 0.2 else w for w in r.choices(roots, k=40)), lang))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = lang_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


def test_many_languages_and_marks(spark, monkeypatch):
    rows = [(i, f"{chr(0x4E00 + 50 * (i % 70))}{chr(0x4E01 + 50 * (i % 70))} " * 5, f"l{i % 70:02}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(lang_id, "CELLS", 1 << 14)
    assert lang_id.identify(df).join(df, "doc_id").where("lang <> lang_pred").count() == 0
    monkeypatch.setattr(lang_id, "MAX_LANGUAGES", 5)
    with pytest.raises(ValueError):
        lang_id.fit(df)
    # Combining marks belong to their letters; marks alone are no letters.
    assert len(lang_id.grams("\u0928\u093f")) == len(lang_id.grams("ab")) and len(lang_id.grams("\u0301 1 _")) == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, docs, sf, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = random.Random(4)
    texts = ["".join(r.choice("ab \n#é") for _ in range(r.randrange(120))) for _ in range(300)]
    made = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for df in (odd, docs, made):
        got = Counter(tuple(x[c] for c in ["doc_id", *quality.COUNTS, "base_failed"]) for x in quality.assess(df, labels).collect())
        want = Counter((x.doc_id, (c := counts(x.text))[0], *c[1:], c[0] < 50 or 100 * c[4] > 50 * c[0]) for x in df.select("doc_id", "text").collect())
        assert got == want
    assert quality.assess(none, labels).count() == 0
    assert quality.assess(odd, labels.limit(0)).where("kept <> (NOT base_failed)").count() == 0
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def binomial(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("alpha,level", [(0.01, 1e-3), (0.05, 0.05)])
def test_exact_bounds(spark, alpha, level):
    ns = [1, 10, 100, 500, 2000]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r[0] for r in df.select(quality.most_rejections(F.col("n"), alpha, level)).collect()]
    for n, k in zip(ns, got, strict=True):
        assert (k < 0 or binomial(n, k, alpha) <= level) and binomial(n, k + 1, alpha) > level


def test_cutoffs_reject_the_bad_and_spare_the_good(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(4000):
        bad = i % 8 == 0
        w = [f"x{r.randrange(9999)}" + ("|" if bad and r.random() < 0.8 else "") for _ in range(70)]
        rows.append((i, " ".join(w), "en" if i % 5 else "rare"))
        if i % 5 or i < 100:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(9999, 0, 0), (1, None, None)]
    out = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in out.collect()}
    assert sum(not got[i].kept for i in got if i % 8 == 0 and i % 5) > 350
    assert all(got[i].kept for i in got if i % 8)
    # Too few labels in a stratum certify nothing.
    assert all(got[i].kept for i in got if i % 5 == 0)


def simulated(spark, seed, copies=1):
    """One stratum of 1500 texts; good ones hold some symbols, shouts and capitals too."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        def word(k):  # noqa: E306
            w = f"x{r.randrange(9999)}"
            return (w + r.choice(["|", "!", "# "])) if r.random() < (0.6 if bad else 0.03 if i % 50 else 0.4) else w
        rows.append((i, " ".join(word(k) for k in range(70)), "en"))
        labels.append((i, 0 if bad else 1))
    held = [x for x in labels if x[0] % 2 == 0] * copies
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(held, "doc_id long, quality int"), labels


@pytest.mark.parametrize("seed", range(3))
def test_the_whole_verdict_keeps_the_bound(spark, seed):
    """Good texts that hold out (odd ids) are rejected no more often than alpha, with room for chance; repeated labels and rows change nothing."""
    docs, held, labels = simulated(spark, seed)
    got = {x.doc_id: x.kept for x in quality.assess(docs, held, alpha=0.05).collect()}
    fresh_good = [i for i, q in labels if q and i % 2]
    wrong = sum(not got[i] for i in fresh_good)
    assert wrong <= 0.05 * len(fresh_good) + 2.33 * math.sqrt(0.05 * 0.95 * len(fresh_good))
    assert sum(not got[i] for i, q in labels if not q) > 200
    for df, marks in ((docs, simulated(spark, seed, 8)[1]), (docs.union(docs), held)):
        assert {x.doc_id: x.kept for x in quality.assess(df, marks, alpha=0.05).collect()} == got


def test_cutoffs_by_brute_force(spark, sf, docs):
    """The certified candidate of each stratum, found by its definition from rows in memory."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, held, _ = simulated(spark, 7)
    rows = quality.measured(docs.withColumn("fingerprint", F.unhex(F.md5("text")))).join(quality.labelled(held), "doc_id")
    score = rows.select("quality", "fingerprint", quality.base_failed().alias("base"), *[c.alias(n) for n, c in quality.scores().items()]).collect()
    good = {x.fingerprint: x for x in score if not x.base and x.quality == 1}
    bad = {x.fingerprint: x for x in score if not x.base and x.quality == 0}
    n, options = len(good), []
    for name, rules in quality.SETS.items():
        for level in range(1, 9):
            goes = lambda x: any(x[r] >= quality.GRID[r][level - 1] for r in rules)  # noqa: B023, E731
            k, caught = sum(map(goes, good.values())), sum(map(goes, bad.values()))
            if binomial(n, k, 0.05) <= 0.05 / len(quality.SETS) and caught > k:
                options.append((caught - k, -level, name))
    got = quality.certify(rows, alpha=0.05).collect()
    _, level, name = max(options)
    assert [(x.stratum, x.cutoffs) for x in got] == [("en", {r: quality.GRID[r][-level - 1] for r in quality.SETS[name]})]
    assert quality.certify(quality.measured(docs.withColumn("fingerprint", F.unhex(F.md5("text")))).join(quality.labelled(labels.limit(0)), "doc_id")).count() == 0


def test_many_labels_are_joined(spark, monkeypatch):
    docs, held, _ = simulated(spark, 3)
    few = sorted(x.doc_id for x in quality.keep_good(docs, held, 0.05).collect())
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)
    assert sorted(x.doc_id for x in quality.keep_good(docs, held, 0.05).collect()) == few
    assert few == sorted(x.doc_id for x in quality.assess(docs, held, 0.05).where("kept").collect())


def test_filters_leave_clashing_columns_alone(spark, odd, docs, sf):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text + f" {i}", "en", "a", "b", "c", "d") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _judged string, _q_n_words string, _Q__kept string, `a.b` string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for kept in (lang_id.keep_identified(df), quality.keep_good(df, labels)):
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows


def test_quality_is_native(spark, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    plan = quality.keep_good(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
