"""Secret scan: fixed patterns, and a battery of randomness tests for what no pattern names.

A candidate is a run of 16 or more characters of an encoding with a letter in it (digits alone are numbers), outside the
spans of the patterns. Its encoding is inferred from its characters (hex, base32, one case with digits, base62, base64,
base64url). Three tests ask how well it fits a random string of that encoding: chi-squared uniformity over cells of the
alphabet, the number of runs of one class of characters, and lag-one serial correlation; Fisher's method combines them.

The null hypothesis of a report is that the run is ordinary. Its p-value is the share of ordinary runs of like length and
case that look as random or more so: `REFERENCE` runs are made, from a fixed seed, of words of four languages and of
programs, joined in the ways of identifiers, paths, titles and part numbers. Candidates of the whole table are one family:
p-values weighted by length (a longer run tells more) go through the Benjamini-Hochberg step, so of the runs reported an
expected share of at most `fdr` is ordinary, as far as the reference is like the table's ordinary runs. The step needs
only counts by p-value and length, of which there are a bounded number, whatever the size of the table.

Null or empty text: no spans, and an empty table an empty result. Spans count code points, the end is exclusive. Repeated
rows are rows each. A very long text is scanned whole. Only doc_id and text are read: other columns may have any name.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import ship

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 or more: a run is leftmost and whole either way
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
LETTER = re.compile(r"[A-Za-z]")
KINDS = ("assign", "access", "hex", "random")
#: the share of false reports; ordinary runs that a p-value is taken from; lengths beyond the last count as the last
FDR, REFERENCE, LENGTHS = 0.05, 2000, (16, 20, 24, 28, 32, 40, 48, 64, 96, 128)

LOWER, UPPER, DIGIT = "etaoinsrlhdcumfpgwybvkxjqz", "ETAOINSRLHDCUMFPGWYBVKXJQZ", "0123456789"
#: name, alphabet in order of its cells, sizes of its cells: letters that are common, less common and rare in words
ENCODINGS = [
    ("hex", DIGIT + "abcdef", (5, 5, 3, 3)),
    ("HEX", DIGIT + "ABCDEF", (5, 5, 3, 3)),
    ("base32", UPPER + "234567", (8, 10, 8, 6)),
    ("lower", LOWER + DIGIT, (8, 10, 8, 10)),
    ("upper", UPPER + DIGIT, (8, 10, 8, 10)),
    ("base62", UPPER + LOWER + DIGIT, (8, 18, 8, 10, 8, 10)),
    ("base64", UPPER + LOWER + DIGIT + "+/", (8, 18, 8, 10, 8, 12)),
    ("base64url", UPPER + LOWER + DIGIT + "-_", (8, 18, 8, 10, 8, 12)),
    ("any", UPPER + LOWER + DIGIT + "+/-_", (8, 18, 8, 10, 8, 14)),
]
_CLASS = {c: 0 for c in "BCDFGHJKLMNPQRSTVWXYZ"} | {c: 1 for c in "AEIOU"} | {c: 2 for c in "bcdfghjklmnpqrstvwxyz"} | {c: 3 for c in "aeiou"} | {c: 4 for c in DIGIT} | {c: 5 for c in "+/-_"}


def _table(name: str, alphabet: str, cells: tuple):
    cell_of = [k for k, n in enumerate(cells) for _ in range(n)]
    same = sum((n / len(alphabet)) ** 2 for n in Counter(_CLASS[c] for c in alphabet).values())
    # for serial correlation, letters stand in the order of the alphabet
    return name, set(alphabet), dict(zip(alphabet, cell_of)), cells, {c: i for i, c in enumerate(sorted(alphabet))}, 1 - same


_TABLES = [_table(*e) for e in ENCODINGS]
_WORDS = """the and for with that this from have more when will user name value count index list item data file path page node tree hash
table column query join group order limit number string parse token stream batch worker server client request response session
config default option result error message handler service manager factory builder adapter controller component module package
version release branch commit build test debug trace cache buffer queue stack image video audio title article author comment
world people government company report market history science nature travel health music school street house water summer
und der die das nicht eine werden schaft lich keit ung gesell arbeit zeit haus land wasser stadt verein buch recht grund
les des une pour dans avec plus tout faire monde ville temps maison travail gouvernement entreprise nouvelle
los las una para como mas todo hacer mundo ciudad tiempo casa trabajo gobierno empresa nueva informacion""".split()
_STYLES = {  # how words are joined, and whether both cases are in the run
    True: ["camel", "Pascal", "Snake", "Kebab", "Path", "camel9", "Title9"],
    False: ["lower", "snake", "kebab", "path", "UPPER", "UPPER_SNAKE", "lower9", "part", "PART", "date"],
}


def _ordinary(r: random.Random, style: str, length: int) -> str:
    cap, parts, sep = str.capitalize, [], {"snake": "_", "Snake": "_", "UPPER_SNAKE": "_", "kebab": "-", "Kebab": "-", "path": "/", "Path": "/", "part": "-", "PART": "-", "date": "/"}.get(style, "")
    while sum(map(len, parts)) + len(sep) * len(parts) < length:
        w = r.choice(_WORDS)
        if style in ("camel", "Pascal", "camel9", "Title9", "Snake", "Kebab", "Path"):
            w = cap(w) if parts or style != "camel" else w
        if style in ("UPPER", "UPPER_SNAKE", "PART"):
            w = w.upper()
        if style in ("camel9", "Title9", "lower9") and r.random() < 0.4:
            w += str(r.randrange(10 ** r.randint(1, 4)))
        if style in ("part", "PART"):
            w = (w[:4] if r.random() < 0.6 else "") + str(r.randrange(10 ** r.randint(1, 5)))
        if style == "date" and r.random() < 0.4:
            w = f"{r.randint(1990, 2030)}/{r.randint(1, 12):02}"
        parts.append(w)
    return sep.join(parts)[: max(length, LEAST)]


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for 3 or an even number of degrees of freedom, and 5."""
    h = x / 2
    if df % 2:
        tail = math.erfc(math.sqrt(h)) + math.sqrt(2 * x / math.pi) * math.exp(-h)
        return tail + (math.sqrt(2 * x / math.pi) * math.exp(-h) * x / 3 if df == 5 else 0)
    term = total = 1.0
    for k in range(1, df // 2):
        term *= h / k
        total += term
    return math.exp(-h) * total


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(run: str) -> tuple[str, float]:
    """The inferred encoding of a run, and the combined p-value of "it is random in that encoding"."""
    body = run.rstrip("=")
    used = set(body)
    name, _, cell, cells, place, turn = next(t for t in _TABLES if used <= t[1])
    n, size = len(body), len(cell)
    counts = [0] * len(cells)
    for c in body:
        counts[cell[c]] += 1
    chi = sum((o - n * c / size) ** 2 / (n * c / size) for o, c in zip(counts, cells))
    p1 = chi2_tail(chi, len(cells) - 1)
    kinds = [_CLASS[c] for c in body]
    turns = sum(u != v for u, v in zip(kinds, kinds[1:]))
    p2 = two_sided((turns - (n - 1) * turn) / math.sqrt((n - 1) * turn * (1 - turn)))
    x = [place[c] for c in body]
    m = sum(x) / n
    var = sum((i - m) ** 2 for i in x)
    p3 = two_sided((sum((u - m) * (v - m) for u, v in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n)) if var else 0.0
    ps = [max(p, 1e-100) for p in (p1, p2, p3)]
    return name, chi2_tail(-2 * sum(map(math.log, ps)), 6)


@lru_cache(maxsize=None)
def reference(length: int, mixed: bool) -> list[float]:
    """How random ordinary runs of a length look, in ascending order; `mixed`: with letters of both cases."""
    r = random.Random(f"{length} {mixed}")
    styles = _STYLES[mixed]
    made = [_ordinary(r, styles[k % len(styles)], r.randint(length, 2 * length)) for k in range(REFERENCE)]
    return sorted(randomness(x)[1] for x in made)


def ordinary(run: str) -> int:
    """The p-value of "the run is ordinary", as a count of REFERENCE + 1."""
    body = run.rstrip("=")
    length = max((x for x in LENGTHS if x <= len(body)), default=LENGTHS[0])
    found = reference(length, body.lower() != body != body.upper())
    return 1 + len(found) - bisect_left(found, randomness(run)[1])


def weight(length: int) -> int:
    return min(length, LENGTHS[-1])


def candidates(text: str, base: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, p as a count) of the runs outside the base spans."""
    return [
        (m.start(), m.end(), ordinary(m[0])) for m in RUN.finditer(text) if LETTER.search(m[0]) and not any(a <= m.start() and m.end() <= b for a, b in base)
    ]


def cut_of(family: Iterable[tuple[int, int, int]], fdr: float = FDR) -> float:
    """What p / length a report may have at most, from (p as a count, length, number) of all candidates: the weighted
    Benjamini-Hochberg step. Below 0: nothing is reported."""
    rows = sorted((p / (REFERENCE + 1) / weight(n), n, c) for p, n, c in family)
    m, total = sum(c for _, _, c in rows), sum(weight(n) * c for _, n, c in rows)
    seen, cut = 0, -1.0
    for q, _, c in rows:
        seen += c
        if q * total / m <= fdr * seen / m:
            cut = q
    return cut


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def spans(text: str, cut: float | None = None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), by start, then kind. The base kinds stay; a random run is added unless
    it lies within one of them. cut: that of the family the text belongs to; None: the text is a family of its own."""
    out = base_spans(text)
    found = candidates(text, [(s, e) for s, _, e in out])
    if cut is None:
        cut = cut_of([(p, e - s, 1) for s, e, p in found])
    out += [(s, 3, e) for s, e, p in found if p / (REFERENCE + 1) / weight(e - s) <= cut]
    return sorted(out)


def family_cut(docs: DataFrame, fdr: float = FDR) -> float:
    """cut_of all candidates of a table."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                seen.update((p, weight(e - s)) for s, e, p in candidates(text, [(s, e) for s, _, e in base_spans(text)]))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)] + [pa.array([seen[k] for k in keys], pa.int64())], ["p", "length", "n"])

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "p int, length int, n long")
    # at most REFERENCE + 1 p-values times 128 lengths, however large the table
    return cut_of([tuple(r) for r in found.groupBy("p", "length").agg(F.sum("n").alias("n")).collect()], fdr)


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def masked(text: str, found, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap are replaced together."""
    out, at = [], 0
    for s, _, e in found:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    cut = family_cut(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = spans(text or "", cut)
                n = [sum(k == i for _, k, _ in found) for i in range(4)]
                base = joined(x for x in found if x[1] < 3)
                rows.append((n[0], n[1], n[2], sha256(base.encode()).hexdigest(), joined(found), n[3]))
            c = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(c, types)]], names)

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def masker(cut: float | None = None):
    """A column function that masks the secrets of a text; null stays null. cut: as in spans()."""

    @F.pandas_udf("string")
    def mask_secrets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, spans(t, cut)))

    return mask_secrets
