"""PII, tokens, pieces, shards, packing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from outlens.llm import packing, pii, sharding, sp_sampling, token_count
from outlens.llm.queries import op4_sampled_pieces, tokenizer

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in BASE.items()}


@pytest.mark.parametrize("letters", ["ab@@.-+1 ", "0123.+ -()", "41 -", "a@b.c%1é"])
def test_base_spans(letters):
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(45))) + r.choice(["", "4111111111111111", "9.9.9.9"])
        assert pii.plain_spans(t) == brute(t), t


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to john.smith [at] example [dot] com now", "email:9:42"),
        ("j.s at mail dot example dot org", "email:0:31"),
        ("call +1 three one nine 555 five one three two please", "phone:5:45"),
        ("vаsilу@example.com", "email:0:18"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card:5:24"),
        ("ip 192 [dot] 168 [dot] 1 [dot] 10", "ip:3:33"),
        ("foo​@bar.com", "email:0:12"),
        ("look at the dot on that map", ""),
        ("one two three four people", ""),
        ("plain a@b.co and 10.0.0.1", ""),
        ("naïve café Ünïcode ÀÉ", ""),
    ],
)
def test_disguises(text, want):
    base, added = pii.spans(text)
    assert pii.listed(added) == want
    assert base == brute(text)
    for k in pii.KINDS:
        for b, e in added[k]:
            assert 0 <= b < e <= len(text)


@pytest.mark.parametrize(
    "text,want",
    [
        *((f"anna at firma dot {top} ok", f"email:0:{len(f'anna at firma dot {top}')}") for top in "it at be pt us in me tv dk fi".split()),
        ("write x at example.com now", "email:6:22"),
        ("ip 192 dot 168 dot 1 dot 7 ok", "ip:3:26"),
        ("ana arroba correo punto es", "email:0:26"),
        ("jean arobase poste point fr", "email:0:27"),
        ("ruf +49 drei eins neun fünf fünf fünf eins zwei an", "phone:4:47"),
        ("tel +33 six un deux trois quatre cinq sept huit neuf", "phone:4:52"),
        ("tel +34 seis uno dos tres cuatro cinco siete ocho", "phone:4:49"),
        ("look at the dot in that map, or at example.com", ""),
        ("see us at example.com", ""),
        ("1 dot 2 dot 3 and 999 dot 1 dot 1 dot 1", ""),
    ],
)
def test_disguises_of_four_languages(text, want):
    assert pii.listed(pii.spans(text)[1]) == want


def test_an_ip_part_of_many_zeros():
    t = "0" * 5000 + ".1.2.3 and 1.2.3." + "9" * 5000
    assert pii.listed(pii.spans(t)[0]) == "ip:0:5006"


def test_mask():
    assert pii.mask("mail a@b.co or +1 (319) 555-5132, (x [at] y.org)") == "mail [EMAIL] or [PHONE], ([EMAIL])"
    assert pii.mask("nothing") == "nothing"


def test_pii_of_rows(spark, odd, none, docs):
    for df in (odd, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            b = brute(r.text or "")
            want[(r.doc_id, *(len(b[k]) for k in pii.KINDS), hashlib.sha256(pii.listed(b).encode()).hexdigest())] += 1
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(df).collect())
        assert got == want
    assert pii.find(none).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 1
    assert all(not any(brute(r.text).values()) for r in pii.redact(docs).collect())


# Tokens.
def texts():
    r = random.Random(1)
    letters = " \t\n\r\x0b\x0c  \x85abcZ'sé1²９,.;<|endoftext|>日本🙂́​"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)]
    return ["", "  a  <|endoftext|>  b", "<|endoftext|>", "it's  \n\n x   ", "İstanbul ΣΑΣ fooΣ", "<|startoftext|>x<|endoftext|>y <|z", "a" * 700, "!?" * 400, *made]


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_token_counts(monkeypatch, docs, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "CHUNK", chunk)
    all_texts = texts() + [r.text for r in docs.select("text").limit(60).collect()]
    fst = token_count.compiled(tokenizer("byte_bpe_50k.json"))
    want = [len(e.ids) for e in Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode_batch(all_texts, add_special_tokens=False)]
    assert [fst.count(t) for t in all_texts] == want


def test_maps_compose_associatively():
    fst = token_count.compiled(tokenizer("byte_bpe_50k.json"))
    r = random.Random(2)
    for _ in range(300):
        a, b, c = (fst.chunk_map("".join(r.choice("ab  \n.") for _ in range(r.randrange(9)))) for _ in range(3))
        assert fst.compose(fst.compose(a, b), c) == fst.compose(a, fst.compose(b, c))


def test_token_rows(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = Counter(map(tuple, token_count.count_tokens(odd, tokenizer("byte_bpe_50k.json"), limit=100).collect()))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 100)] += 1
    assert got == want and token_count.count_tokens(none, tokenizer("byte_bpe_50k.json")).count() == 0


# Pieces.
def test_pieces_are_lossless_and_reproducible():
    lat = sp_sampling.compiled(tokenizer("piece_bpe_32k.model"))
    r = random.Random(1)
    all_texts = ["", " ", "\n", "  x \n\n y  ", "▁literal▁", "日本🙂 z", "\x00\x1f", "x" * 3000] + ["".join(r.choice(" \n\taé▁🙂thein") for _ in range(r.randrange(30))) for _ in range(800)]
    ids = lat.encode(all_texts, list(range(len(all_texts))))
    assert [lat.decode(x) for x in ids] == all_texts
    lat.clear()
    alone = [lat.encode([t], [i])[0] for i, t in enumerate(all_texts[:100])]
    assert all((a == b).all() for a, b in zip(alone, ids, strict=False))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert all(sp.decode(x.tolist()) == t for x, t in zip(ids, all_texts, strict=True) if "▁" not in t and t == t.strip() and "\x00" not in t)


def test_pieces_have_their_probabilities():
    lat = sp_sampling.Lattice(tokenizer("piece_bpe_32k.model"), alpha=1e-4)
    to, chars, piece, weight, _ = lat.edges([" there"])
    paths = {}

    def go(end, after, w):
        if end == 0:
            paths[tuple(after)] = math.exp(w)
        for i in np.flatnonzero(to == end) if end else []:
            go(end - chars[i], [int(piece[i]), *after], w + weight[i])

    go(6, [], 0.0)
    total, n = sum(paths.values()), 30_000
    seen = Counter(tuple(x.tolist()) for x in lat.encode(["there"] * n, list(range(n))))
    assert set(seen) <= set(paths)
    assert all(abs(seen[p] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-4 for p, w in paths.items())


def test_piece_rows(spark, odd, none, docs):
    path = tokenizer("piece_bpe_32k.model")
    got = sp_sampling.segment(odd, path)
    assert got.where("NOT lossless").count() == 0 and got.count() == odd.count()
    assert sp_sampling.segment(docs, path, with_ids=False).where("NOT lossless").count() == 0
    lat = sp_sampling.compiled(path)
    by = {r.doc_id: r for r in got.collect() if r.doc_id in (1, 2, 4, 11)}
    rows = {r.doc_id: r.text for r in odd.collect() if r.doc_id in by}
    for k, r in by.items():
        ids = lat.encode([rows[k]], [k])[0]
        assert r.ids == ids.tolist() and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
    assert sp_sampling.segment(none, path).count() == 0


def test_the_piece_query_returns_its_pieces(spark, sf):
    rows = op4_sampled_pieces(spark, sf).limit(20).collect()
    assert rows and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


# Shards.
def test_permutation():
    for n in (0, 1, 2, 3, 5, 10, 97, 1000, 4096, 30_011):
        p = sharding.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
    one, two = (sharding.permute(np.arange(1000), 1000, s) for s in (1, 2))
    assert (one != two).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), one)[0, 1]) < 0.15


def test_shards(spark, odd, none, docs):
    for df in (odd, docs):
        rows = sharding.shard(df, 7).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[k]) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1
        again = {(r.row_no, r.shard, r.slot) for r in sharding.shard(df.repartition(5), 7).collect()}
        assert again == {(r.row_no, r.shard, r.slot) for r in rows}
    assert sharding.shard(none).count() == 0


# Packing.
def test_word_ids_are_the_library_s(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    all_texts = texts() + [r.text for r in docs.select("text").limit(60).collect()]
    want = [e.ids for e in tok.encode_batch(all_texts, add_special_tokens=False)]
    got = packing.worker_ids(tokenizer("word_bpe_49k.json")).batch(pa.array(all_texts))
    assert [g.tolist() for g in got] == want


def check_pieces(df, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    streams = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in df.select("doc_id", "text").collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 2048 and len({r.tier for r in s}) == len({r.step_group for r in s}) == 1 and n <= s[0].tier
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0
    rebuilt = Counter()
    single = Counter(k for k, _ in streams.elements())
    for k, ps in pieces.items():
        if single[k] == 1:
            ps.sort(key=lambda r: r.start)
            rebuilt[(k, tuple(i for r in ps for i in r.ids))] += 1
            assert all(r.doc_tokens == len(next(s for kk, s in streams if kk == k)) for r in ps)
    assert rebuilt == Counter({x: n for x, n in streams.items() if single[x[0]] == 1})
    assert sum(r.length for r in rows) == sum(len(s) * n for (_, s), n in streams.items())


def test_packing(spark, odd, none, docs):
    path = tokenizer("word_bpe_49k.json")
    for df in (odd, docs, docs.repartition(3)):
        check_pieces(df, packing.pack(df, path, with_ids=True).collect())
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("sizes,tiers", [([100], {256}), ([90, 300], {256, 512}), ([300, 500], {256, 512}), ([3, 100, 400, 700, 1500, 5000], {256, 1024, 2048})])
def test_each_tier_has_its_own_windows(sizes, tiers):
    p = packing.Packer(0)
    r = random.Random(4)
    docs = [r.choice(sizes) for _ in range(200)]
    for k, n in enumerate(docs):
        p.add(k, np.ones(n, np.uint32))
    p.pack(last=True)
    sequences, dealt = defaultdict(list), defaultdict(Counter)
    for _, _, ids, _, offset, seq, tier, group in p.drain():
        sequences[seq, tier].append(len(ids))
        dealt[tier][group] += offset == 0
    assert sum(map(sum, sequences.values())) == sum(docs)
    # All but the tail of the partition (powers of two) fill their windows, opened by a remainder that no shorter tier holds.
    tail = {k: x for k, x in sequences.items() if sum(x) != k[1] or (k[1] > 256 and x[0] <= k[1] // 2)}
    assert all(sum(x).bit_count() == 1 for x in tail.values()) and len(set(map(sum, tail.values()))) == len(tail)
    assert tiers - {256} <= {tier for _, tier in sequences.keys() - tail.keys()} <= tiers | {256, 512}
    groups = {g for x in dealt.values() for g in x}
    assert all(max(x.values()) - min(x[g] for g in groups) <= 2 for x in dealt.values())


def test_step_groups_are_balanced(docs):
    p = packing.Packer(0)
    r = random.Random(3)
    for k in range(400):
        p.add(k, np.ones(r.choice([3, 100, 700, 1500, 5000]), np.uint32))
    p.pack(last=True)
    cost = defaultdict(int)
    for row in p.drain():
        cost[row[7]] += len(row[2]) ** 2
    full = sorted(cost.values())
    assert full[len(full) // 2] < 1.5 * full[len(full) // 4]
