"""Personal data in whole texts, with offset-preserving deobfuscation.

Base spans are the plain patterns, leftmost and non-overlapping per kind. The
method adds spans of disguised identifiers: a chain of transducers rewrites the
text (look-alike letters and digits; hidden characters; spelled digits; "at" and
"dot" disguises), each keeping for every output character the source range that it
stands for. Identifiers found in the rewritten text are mapped back to source
characters, and are added where they overlap no base span of their kind.

Spans are kind:start:end in code points, end exclusive. Defined results: a null
text is empty; repeated rows give the same spans; of matches that begin together the first alternative counts;
an empty table gives no rows; further columns, whatever their names, are ignored by ``find`` and returned as they
are by ``redact``. Each row costs time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_held, prepare

KINDS = ("email", "ip", "card", "phone")

# Base patterns. A look-behind only spares starts inside a run, which can match nothing that its first character does not.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Walks from @ to @; the local part is the run of its characters before it."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return found


def _ip_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in s.split(".")))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_DIGITS.findall(s)) <= 15


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    take = lambda pattern, ok: [m.span() for m in pattern.finditer(text) if ok(m[0])]
    return {
        "email": _emails(text),
        "ip": take(_IP, _ip_ok),
        "card": take(_CARD, _card_ok),
        "phone": take(_PHONE, _phone_ok) if "+" in text else [],
    }


# Characters that look like ASCII letters, digits and marks.
CYRILLIC = dict(zip("АВЕЗКМНОРСТУХаеорсухіјѕԁһӏ", "ABE3KMHOPCTYXaeopcyxijsdhl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχ", "ABEZHIKMNOPTYXaikvoptux", strict=True))
MARKS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " "}
HIDDEN = "­​‌‍⁠﻿"
#: First code points of runs of the ten digits.
DIGIT_RUNS = (0x0660, 0x06F0, 0x0966, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
# Digit words of English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "ein": "1", "zwo": "2", "fuenf": "5", "une": "1"}


def look_alikes() -> dict[str, str]:
    full = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    digits = {chr(first + i): str(i) for first in DIGIT_RUNS for i in range(10)}
    return full | digits | CYRILLIC | GREEK | MARKS


_ALIKE = look_alikes()
_ALIKE_RUN = re.compile("[" + re.escape("".join(_ALIKE) + HIDDEN) + "]")
# The longest first: "siete" is no "six", "eins" no "ein".
_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_SPELLED = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:(?:{_WORD}|[0-9])[ .-]{{0,2}}){{3,}}(?:{_WORD}|[0-9])(?![A-Za-zÀ-ÿ])", re.IGNORECASE)
_ONE_WORD = re.compile(rf"(?:{_WORD})", re.IGNORECASE)
# Fixed values: "at" and "dot" in the four languages.
_AT_WORD, _DOT_WORD = "at|ät|arobase|arroba|chez", "dot|punkt|point|punto"
_AT_MARK = re.compile(rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_AT_WORD})[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}", re.IGNORECASE)
_DOT_MARK = re.compile(rf"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{_DOT_WORD})[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}", re.IGNORECASE)
# Top-level domains, of two letters (all countries) and common longer ones.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz io co ai app dev name pro online site shop store tech cloud blog xyz "
    "ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz "
    "tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
)
# Top-level domains that are common words, which follow no article as a host.
_WORD_TOPS = frozenset("am as at be do er et id il im in is it la ma me my ne ni no pa re sa si so su ta to tu us va".split())
_ARTICLES = frozenset("a an the this that each every my your his her its our their le la les un une ce der die das den dem ein eine el los las una este esta".split())
# Words of prose before "at" and a host that is written plainly.
_NO_NAMES = frozenset(
    "look looks looked looking see us me him her them it is are was be found find available online visit hosted live here there more read now site page pages "
    "website blog shop store out up down on one that this what not only and or contact email mail server files code docs starting works worked working est sont bin ist sind es está".split()
)
#: Bare words count only in the full shape: name at host dot name, where either the "at" alone or the dots too are words.
_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}( (?:{_AT_WORD}) )([A-Za-z0-9-]{{1,63}}(?:(?: (?:{_DOT_WORD}) |\.)[A-Za-z0-9-]{{1,63}}){{0,6}}(?: (?:{_DOT_WORD}) |\.))({TOP_DOMAINS.replace(' ', '|')})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_BARE_AT = re.compile(rf" (?:{_AT_WORD}) ", re.IGNORECASE)
_BARE_DOT = re.compile(rf" (?:{_DOT_WORD}) ", re.IGNORECASE)
#: Four numbers with bare dots between them, or some.
_BARE_IP = re.compile(rf"(?<![0-9])[0-9]+(?:(?: (?:{_DOT_WORD}) |\.)[0-9]+){{3}}(?![0-9])", re.IGNORECASE)


def _is_address(m: re.Match) -> bool:
    if not _BARE_DOT.search(m[2]):
        return m[0][: m.start(1) - m.start()].lower() not in _NO_NAMES
    labels = re.split(r"[ .]", m[2].lower())
    return m[3].lower() not in _WORD_TOPS or _ARTICLES.isdisjoint(labels)


class Mapped:
    """A rewritten text; the source range of each character, or None for the source itself."""

    def __init__(self, text: str):
        self.text = text
        self.begins: list[int] | None = None
        self.ends: list[int] | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ascending, non-overlapping ranges; a replacement stands for its whole range."""
        if not edits:
            return
        begins = self.begins if self.begins is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        out, ob, oe, at = [], [], [], 0
        for b, e, new in edits:
            out += (self.text[at:b], new)
            ob += begins[at:b] + [begins[b]] * len(new)
            oe += ends[at:b] + [ends[e - 1]] * len(new)
            at = e
        out.append(self.text[at:])
        self.text, self.begins, self.ends = "".join(out), ob + begins[at:], oe + ends[at:]

    def source(self, begin: int, end: int) -> tuple[int, int]:
        return (begin, end) if self.begins is None else (self.begins[begin], self.ends[end - 1])


def deobfuscated(text: str) -> Mapped | None:
    """The rewritten text, or None if it holds no disguise."""
    m = Mapped(text)
    if not text.isascii():
        m.rewrite([(x.start(), x.end(), _ALIKE.get(x[0], "")) for x in _ALIKE_RUN.finditer(text)])
    if _ONE_WORD.search(m.text):
        edits = []
        for run in _SPELLED.finditer(m.text):
            # Words become digits; the marks between them stay, single blanks between two words go.
            edits += [(x.start() + run.start(), x.end() + run.start(), DIGIT_WORDS[x[0].lower()]) for x in _ONE_WORD.finditer(run[0])]
        m.rewrite(edits)
    low = m.text.lower() if len(m.text.lower()) == len(m.text) else m.text
    at, dot = _BARE_AT.search(low), _BARE_DOT.search(low)
    if at or dot or _AT_MARK.search(m.text) or _DOT_MARK.search(m.text):
        edits = [(x.start(), x.end(), "@") for x in _AT_MARK.finditer(m.text)] + [(x.start(), x.end(), ".") for x in _DOT_MARK.finditer(m.text)]
        for x in _BARE.finditer(m.text) if at else ():
            if _is_address(x):
                edits.append((*x.span(1), "@"))
                edits += [(d.start() + x.start(2), d.end() + x.start(2), ".") for d in _BARE_DOT.finditer(x[2])]
        for x in _BARE_IP.finditer(m.text) if dot else ():
            edits += [(d.start() + x.start(), d.end() + x.start(), ".") for d in _BARE_DOT.finditer(x[0])]
        edits.sort()
        kept, end = [], 0
        for e in edits:
            if e[0] >= end:
                kept.append(e)
                end = e[1]
        m.rewrite(kept)
    return None if m.begins is None else m


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans by kind."""
    base = plain_spans(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if m := deobfuscated(text):
        for kind, found in plain_spans(m.text).items():
            taken = base[kind]
            for b, e in found:
                begin, end = m.source(b, e)
                # The part of the source that is itself plain needs no disguise: base has judged it.
                if m.text[b:e] != text[begin:end] and not any(x < end and begin < y for x, y in taken):
                    added[kind].append((begin, end))
    return base, added


def listed(by_kind: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k in KINDS for b, e in sorted(by_kind[k]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans and n_added for every row; no shuffle."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = spans(text)
                both = {k: base[k] + added[k] for k in KINDS}
                row = (key, *(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(map(len, added.values())))
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str) -> str:
    """``text`` with every span of personal data replaced by its kind, as in [EMAIL]."""
    base, added = spans(text)
    every = sorted((b, e, k) for k in KINDS for b, e in base[k] + added[k])
    if not every:
        return text
    out, at = [], 0
    for i, (b, e, k) in enumerate(every):
        if b < at:  # overlaps the last one: hide its rest too
            at = max(at, e)
            continue
        out += (text[at:b], f"[{k.upper()}]")
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts and their n_chars; other columns as they are, null texts stay null."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        drop_held()
        return texts.map(lambda t: t if t is None else mask(t))

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", size)
    return out.select(docs.columns)
