"""Secret scans: fixed patterns, and password guess costs for values in a credential context.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them, a value that stands after a
credential word ("pwd is ...", "login -> ...", DB_PASS=..., user:value@host) is a secret if guessing it is dear. Its cost is
the cheapest way to spell it: dynamic programming over segments that are words (also capitalised or with digits
for letters), dates, repeats of any unit, keyboard or alphabet walks of any length, or single characters by brute force;
log10 of guesses add up, and each further segment costs where it is cut. Words are ranked: common passwords first,
then the word entries of a public vocabulary file in its order (`vocabulary`, a path that tasks can read like any library
file; none gives the common passwords alone).

A value that is cheap hides nothing behind it: the scan goes on at its start. Repeats are found by runs (a few steps for
each period and start, so a random value of n characters takes n log n of them), and of the starts of a repeat or walk
only those are kept that may yet be the cheapest, so that very long values take little more than proportional time (0.2 ms a character).

Texts are scanned whole, in tasks, without a shuffle. Defined results: null counts as empty; rows without any span give
an empty list; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import inf, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from convoweave.llm.rows import slices
from convoweave.session import table

KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 6, "access": 20, "hex": 24}  # characters; of an assignment's value
LEAST_COST = 8.0  # log10 of guesses from which a value in context counts
CUT = 0.3  # of a further segment
SHORTEST = 3  # characters of a word or walk
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("cost", "double"))

#: Common passwords and words in them, the most common first.
COMMON = """password qwerty dragon monkey letmein football baseball welcome login admin princess master sunshine shadow
michael superman batman trustno hello freedom whatever starwars summer winter spring autumn secret test guest root
default changeme love iloveyou killer pepper jordan hunter ranger thomas robert soccer hockey george andrew charlie
computer internet server system user service public private access token orange purple yellow green black white
silver golden diamond flower cookie cheese banana apple chocolate coffee ginger tigger matrix phoenix mustang harley
corvette yankees lakers eagles cowboys steelers rangers chelsea liverpool arsenal london paris berlin madrid america
company office money lucky happy angel jesus god family mother father brother sister friend forever always
january february march april may june july august september october november december monday friday sunday""".split()
#: The rows of a keyboard with their shift in keys, digits that stand for letters.
ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
LEET = str.maketrans("01345$@7", "oleassat")

PLACE = {c: (k, i + shift) for k, (row, shift) in enumerate(ROWS) for i, c in enumerate(row)}
NEAR = {(a, b) for a, (r, x) in PLACE.items() for b, (s, y) in PLACE.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1}
DATES = tuple(re.compile(p, re.A) for p in (
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:[0-2]\d|3[01])", r"(?:[0-2]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", r"(?:19|20)\d\d",
))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more: the runs of [0-9a-f]+ that are long enough
WORD = "pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|login|(?:api|access|private|secret)[_\\x20-]?key"
VALUE = r"""(?:"([^"\r\n]{4,}+)"|'([^'\r\n]{4,}+)'|["']?([^\s"'<>]{4,}+))"""
CONTEXT = re.compile(rf"""(?<![a-z])(?:{WORD})(?![a-z])["']?\s*+(?:=>|->|[:=]|is\b)\s*+{VALUE}|://[^\s/:@]++:([^\s/@]{{4,}}+)@""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "key")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "login", "key", "://")


def alphabet(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def key_step(a: str, b: str) -> tuple | None:
    """How a walk goes from one key to the next, on the keyboard or in the alphabet; None if it does not."""
    if (a, b) in NEAR:
        return PLACE[b][0] - PLACE[a][0], PLACE[b][1] > PLACE[a][1]
    return (ord(b) - ord(a),) if abs(ord(b) - ord(a)) == 1 else None


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None) -> dict[str, int]:
    """The rank of each known word: common passwords, then the words of a vocabulary file in its order."""
    words = list(COMMON)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        words += [w.removesuffix("</w>") for w in sorted(entries, key=entries.get) if w.endswith("</w>")]
    words = dict.fromkeys(w for w in words if len(w) >= SHORTEST and w.isalpha())
    return {w: r for r, w in enumerate(words, 1)}


@lru_cache(maxsize=4)
def longest(vocabulary: str | None) -> int:
    return max(map(len, ranks(vocabulary)))


def repeated(value: str) -> list[tuple[int, int, int]]:
    """The runs (start, end, period) of a text, each at least twice its period long and as long as it gets; runs whose
    period is a multiple of another's that covers them are left out."""
    n, found = len(value), []
    cover: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by place: period and end of the runs that hold it
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            held = next((end for period, end in cover[k] if p % period == 0 and end > k + p), 0)
            if held:
                k += max(p, (held - k - p) // p * p)
                continue
            z = k + p
            while z < n and value[z] == value[z - p]:
                z += 1
            a = k
            while a and value[a - 1] == value[a - 1 + p]:
                a -= 1
            if z - a >= 2 * p:
                found.append((a, z, p))
                for i in range(a, z):
                    cover[i].append((p, z))
            k = max(k + p, (z - p) // p * p)
    return found


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of `value` takes."""
    n, low = len(value), value.lower()
    plain, rank, most = low.translate(LEET), ranks(vocabulary), longest(vocabulary)
    brute = [alphabet(c) for c in value]
    best = [0.0] + [inf] * n
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: start and cost of words and dates
    for i in range(n):
        for k in range(SHORTEST, min(most, n - i) + 1):
            written = low[i : i + k]
            known = rank.get(written)
            at = known or rank.get(plain[i : i + k])
            if at:
                ending[i + k].append((i, log10(at + 1) + 0.5 * (value[i : i + k] != written) + 0.7 * (not known)))
        for date in filter(None, (pattern.match(value, i) for pattern in DATES)):
            ending[date.end()].append((i, 4.7 if date.end() - i > 4 else 2.2))
    opening: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n + 1)]  # by the first end of a repeat: its run
    for a, z, p in repeated(value):
        if a + max(2 * p, 3) <= z:
            opening[a + max(2 * p, 3)].append((a, z, p, sum(brute[a : a + p])))
    step = [None, *(key_step(a, b) for a, b in zip(low, low[1:], strict=False))]  # by place: how the walk comes there
    turn, walk = 0.0, Starts()
    runs: list[tuple[int, int, float, dict[int, Starts]]] = []
    turns = [0.0] * n  # of the walk up to a place
    for k in range(2, n):
        turn += 0.8 * (step[k] is not None and step[k - 1] is not None and step[k] != step[k - 1])
        turns[k] = turn
    from_cut = lambda i: best[i] + (CUT if i else 0.0)
    for j in range(1, n + 1):
        least = best[j - 1] + brute[j - 1]
        for i, cost in ending[j]:
            least = min(least, from_cut(i) + cost)
        if j > 1 and step[j - 1] is None:
            walk = Starts()
        if j >= SHORTEST and None not in step[j - SHORTEST + 1 : j]:
            i = j - SHORTEST
            walk.add(i, from_cut(i) - turns[min(i + 1, n - 1)])
            least = min(least, walk.least(j) + log10(47) + turns[j - 1])
        runs = [r for r in runs if j <= r[0]]
        runs += [(z, p, unit, {}) for _, z, p, unit in opening[j]]
        for _, p, unit, starts in runs:
            shortest = max(2 * p, 3)
            here = starts.setdefault(j % p, Starts())
            here.add(j - shortest, from_cut(j - shortest))
            least = min(least, here.least(j) + unit - log10(p))
        best[j] = least
    return best[n]


class Starts:
    """The starts i, with what comes before them, that may yet be the cheapest for an end j by before + log10(j - i).

    An earlier start that is cheaper for one end is so for every later one, so later starts that lose are dropped; one
    that has no cheaper way before it never is.
    """

    __slots__ = ("rows",)

    def __init__(self):
        self.rows: list[tuple[int, float]] = []

    def add(self, i: int, before: float) -> None:
        while self.rows and self.rows[-1][1] >= before:
            self.rows.pop()
        self.rows.append((i, before))

    def least(self, j: int) -> float:
        costs = [before + log10(j - i) for i, before in self.rows]
        least = min(costs)
        del self.rows[costs.index(least) + 1 :]
        return least


def spans_of(text: str | None, vocabulary: str | None = None) -> list[tuple[str, int, int, float | None]]:
    """The spans (kind, start, end, cost) of one text, by start and kind; offsets in code points, end exclusive."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        at = 0
        while m := CONTEXT.search(text, at):
            group = m.lastindex
            start, end = m.span(group)
            if group == 3:  # a bare value ends before the marks that close a sentence or a list
                end = start + len(m[3].rstrip(",;.)]}"))
            cost = guess_cost(text[start:end], vocabulary)
            if end - start >= 4 and cost >= LEAST_COST:
                found.append(("guess", start, end, round(cost, 3)))
                at = m.end()
            else:
                at = start
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, cost) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
        for b in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in spans_of(t, vocabulary)] for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("spans", SPANS))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in all `documents`."""
    import public_tokenizers

    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    found = secret_spans(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}
