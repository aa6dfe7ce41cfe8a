"""SQL for a second engine: queries of this subpackage whose whole result SQL can express."""

from __future__ import annotations

from . import embed_dedup, prob_minhash, quality, sharding

#: Words as the operators take them.
_WORD = r"[^\x20\x09-\x0D]+"
_TWO_64 = "18446744073709551616"


def embeddings_sql(threshold: float = embed_dedup.THRESHOLD) -> str:
    """All pairs of a label, and the closure of the links."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
        r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY 1), m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN m ON vec_id = m.a"""


def quality_sql(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    """Counts, certified candidates and verdicts by their definitions."""
    scores = {
        "symbols": "n_symbols / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "shouts": "n_shouts / greatest(n_words, 1)",
        "capitals": "n_capitals / greatest(word_chars, 1)", "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-word_chars / greatest(n_words, 1)",
    }
    level = lambda r: "1 + " + " + ".join(f"CAST({r} < {cut} AS INTEGER)" for cut in quality.GRID[r])
    reached = ", ".join(f"least({', '.join(level(r) for r in rules)}) AS l_{name}" for name, rules in quality.SETS.items())
    each = " UNION ALL ".join(f"SELECT stratum, '{name}' AS name, l_{name} AS level, good FROM texts" for name in quality.SETS)
    cut = lambda r: f"[{', '.join(map(str, quality.GRID[r]))}][best.level]"
    within = lambda r: ", ".join(f"'{name}'" for name, rules in quality.SETS.items() if r in rules)
    broken = ", ".join(f"CASE WHEN best.name IN ({within(r)}) AND {r} >= {cut(r)} THEN '{r}' END" for r in quality.GRID)
    log_term = f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM d),
        g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM w WHERE len(w) > 2),
        twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) ks GROUP BY 1),
        lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
        c AS (SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS n_shouts, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals
          FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
        s AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in scores.items())} FROM c),
        labelled AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
        held AS (SELECT stratum, md5(t) AS fingerprint, good, {reached} FROM s JOIN labelled USING (doc_id) WHERE NOT base_failed),
        texts AS (SELECT stratum, bool_or(good) AS good, {", ".join(f"min(l_{n}) AS l_{n}" for n in quality.SETS)} FROM held GROUP BY stratum, fingerprint),
        bins AS (SELECT stratum, name, level, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM ({each}) e GROUP BY 1, 2, 3),
        summed AS (SELECT stratum, name, level, sum(good) OVER upto AS k, sum(bad) OVER upto AS caught, sum(good) OVER (PARTITION BY stratum, name) AS n, (SELECT count(DISTINCT stratum) FROM bins) AS strata
          FROM bins WINDOW upto AS (PARTITION BY stratum, name ORDER BY level ROWS UNBOUNDED PRECEDING)),
        ok AS (SELECT * FROM summed WHERE n > 0 AND level <= {quality.LEVELS} AND caught > k AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i: exp({log_term}))) <= {delta} / ({len(quality.SETS)} * strata)),
        best AS (SELECT stratum, name, level FROM ok QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught - k DESC, level, name DESC) = 1),
        v AS (SELECT s.*, array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS rules FROM s LEFT JOIN best ON s.stratum = best.stratum)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
          base_failed, coalesce(rules, '') AS rules, NOT base_failed AND coalesce(rules, '') = '' AS kept FROM v"""


def near_copies_sql(threshold: float = prob_minhash.THRESHOLD) -> str:
    """The probability Jaccard of all pairs that can reach it, by weight classes, and the closure of the links.

    J_P is at most the share of either text's weight that is common, so the others cannot reach it.
    """
    k = prob_minhash.SHINGLE
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}'), ' ') AS norm FROM documents),
        nodes AS (SELECT norm, string_split(norm, ' ') AS w, min(doc_id) AS id, row_number() OVER (ORDER BY norm) AS node FROM d WHERE norm <> '' GROUP BY norm),
        s AS (SELECT node, g, 1 + ln(count(*)) AS weight FROM (SELECT node, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM nodes) x GROUP BY 1, 2),
        totals AS (SELECT node, sum(weight) AS total FROM s GROUP BY 1),
        pairs AS (SELECT p.a, p.b FROM (SELECT x.node AS a, y.node AS b, sum(x.weight) AS wa, sum(y.weight) AS wb FROM s x JOIN s y ON x.g = y.g AND x.node < y.node GROUP BY 1, 2) p
          JOIN totals ta ON ta.node = a JOIN totals tb ON tb.node = b WHERE wa >= {threshold} * ta.total - 1e-6 AND wb >= {threshold} * tb.total - 1e-6),
        each AS (SELECT a, b, g, max(wa) AS wa, max(wb) AS wb FROM (SELECT a, b, g, weight AS wa, 0.0 AS wb FROM pairs JOIN s ON node = a UNION ALL SELECT a, b, g, 0.0, weight FROM pairs JOIN s ON node = b) u GROUP BY 1, 2, 3),
        classes AS (SELECT a, b, wa, wb, count(*) AS m FROM each GROUP BY 1, 2, 3, 4),
        terms AS (SELECT i.a, i.b, i.wa, i.wb, any_value(i.m) / sum(j.m * greatest(j.wa / i.wa, j.wb / i.wb)) AS term FROM classes i JOIN classes j ON i.a = j.a AND i.b = j.b WHERE i.wa > 0 AND i.wb > 0 GROUP BY 1, 2, 3, 4),
        links AS (SELECT a, b FROM terms GROUP BY 1, 2 HAVING sum(term) >= {threshold}), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, sides.b FROM r JOIN sides ON r.b = sides.a),
        c AS (SELECT r.a, min(nodes.id) AS class_id FROM r JOIN nodes ON nodes.node = r.b GROUP BY 1)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept FROM d LEFT JOIN nodes ON d.norm = nodes.norm LEFT JOIN c ON c.a = nodes.node"""


def _mixed(prev: str, source: str, key: int, keep: str) -> str:
    """``keep`` and x: the 64-bit finaliser of ``source`` + key, step by step."""
    product = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * CAST('{c}' AS UHUGEINT)) % CAST('{_TWO_64}' AS UHUGEINT) AS UBIGINT)"
    out = f"SELECT {keep}, CAST((CAST({source} AS UHUGEINT) + CAST('{key}' AS UHUGEINT)) % CAST('{_TWO_64}' AS UHUGEINT) AS UBIGINT) AS x FROM ({prev}) q"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        out = f"SELECT {keep}, xor(x, x >> {shift}) AS x FROM ({out}) q"
        if factor:
            out = f"SELECT {keep}, {product('x', factor)} AS x FROM ({out}) q"
    return out


def shards_sql(shards: int, seed: int = 20240607, rounds: int = sharding.ROUNDS) -> str:
    """Row numbers, the Feistel network with its cycle walk, and checksums nibble by nibble."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = f"xor(list_reduce(nibbles, lambda c, x: xor([{', '.join(f'{t}::UBIGINT' for t in table)}][CAST(xor(c, x) & 15 AS INTEGER) + 1], c >> 4), 4294967295::UBIGINT), 4294967295::UBIGINT)"
    keys = [int(k) for k in sharding.round_keys(seed, rounds)]
    step = "SELECT row_no, a, b, n, p // b AS l, p % b AS r FROM walk WHERE p >= n OR NOT begun"
    for i, key in enumerate(keys):
        keep = "row_no, a, b, n, l, r"
        if i % 2:
            step = f"SELECT row_no, a, b, n, l, CAST((r + x % CAST(b AS UBIGINT)) % b AS BIGINT) AS r FROM ({_mixed(step, 'l', key, keep)}) q"
        else:
            step = f"SELECT row_no, a, b, n, CAST((l + x % CAST(a AS UBIGINT)) % a AS BIGINT) AS l, r FROM ({_mixed(step, 'r', key, keep)}) q"
    return f"""WITH RECURSIVE h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
        m AS (SELECT doc_id, strlen(t) + {sharding.ROW_OVERHEAD} AS size, flatten(list_transform(bytes, lambda s: [CAST(instr('0123456789ABCDEF', s[2]) - 1 AS UBIGINT), CAST(instr('0123456789ABCDEF', s[1]) - 1 AS UBIGINT)])) AS nibbles FROM h),
        k AS (SELECT doc_id, size, CAST({crc} AS BIGINT) AS text_crc32 FROM m),
        o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no, count(*) OVER () AS n FROM k),
        e AS (SELECT row_no, n, CAST(floor(sqrt(n - 1)) + 1 AS BIGINT) AS a FROM o),
        walk AS (SELECT row_no, n, a, CAST(ceil(n / a) AS BIGINT) AS b, row_no AS p, FALSE AS begun FROM e UNION ALL SELECT row_no, n, a, b, l * b + r AS p, TRUE AS begun FROM ({step}) q)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, o.row_no
        FROM o JOIN walk ON walk.row_no = o.row_no WHERE begun AND p < walk.n"""
