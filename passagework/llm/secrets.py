"""Secret scans: fixed patterns, and literals that reach a sensitive name.

A text that mentions a word that can make a name sensitive is lexed as source
or configuration: names, assignment signs, literals, references and their
concatenations. A name
that stands for a literal hands it on to whatever refers to it. A literal is
reported if the score of the name it ends up under, times that of the literal
itself, is high enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import computed, forget, fresh, texts, with_fields
from passagework.llm.lexing import DEFINING, NAME, Literal, Term, assignments, values

# The base patterns and the least length of what they must catch.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

KINDS = ["assign", "access", "hex", "literal"]
MASK = "[secret]"
REPORTED = 0.5

# Parameters: what words of a name say about its value.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 0.9, "token": 0.8,
    "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.7, "auth": 0.5, "api": 0.4, "private": 0.4,
    "access": 0.4, "signing": 0.4, "encryption": 0.4, "client": 0.2, "key": 0.5,
    "public": -0.6, "count": -1.0, "limit": -1.0, "length": -1.0, "size": -1.0, "max": -1.0, "min": -1.0, "type": -0.8,
    "name": -0.6, "url": -0.5, "path": -0.5, "file": -0.5, "expiry": -0.8, "ttl": -0.8, "primary": -0.6, "foreign": -0.6,
}
# A name scores above 0 only with one of these in it, so no other text has a literal to report.
RAISING = [w for w, score in NAME_WORDS.items() if score > 0]
TRIGGERS = tuple(w for w in RAISING if not any(other != w and other in w for other in RAISING))
INSIDE = r"example|change.?me|your|placeholder|dummy|redacted|<.*>"
PLACEHOLDER = re.compile(rf"{INSIDE}|^(.)\1*$|^(none|null|true|false|undefined)$", re.I)
INSIDE = re.compile(INSIDE, re.I)
EDGE = 10  # one character less than the longest of these words

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*+://[^\s:/@\"'<>]*+:(?P<word>[^\s/@\"'<>]++)@")

Span = tuple[int, int, str]


def base_spans(text: str, lowered: str) -> list[Span]:
    found = []
    if any(w in lowered for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How much a name promises a secret, 0 to 1; its last two parts count."""
    words = [w.lower() for part in re.split(r"[._\-$]+", name)[-4:] for w in WORDS.findall(part)]
    return min(1.0, max(0.0, sum(NAME_WORDS.get(w, NAME_WORDS.get(w.removesuffix("s"), 0.0)) for w in words)))


class Said:
    """What the parts of a literal say when joined, as running counts, so that no joined text is ever made.

    Counts are floats times ``2 ** scale``: names that refer to each other may double a literal without end.
    """

    __slots__ = ("size", "counts", "scale", "head", "tail", "inside")

    def __init__(self, value: str = ""):
        self.size = len(value)
        self.counts: dict[str, float] = dict(Counter(value))
        self.scale = 0
        self.head, self.tail = value[:EDGE], value[-EDGE:]
        self.inside = bool(INSIDE.search(value))

    def add(self, other: Said) -> None:
        self.inside = (
            self.inside
            or other.inside
            or ("<" in self.counts and ">" in other.counts)
            or bool(INSIDE.search(self.tail + other.head))
        )
        self.size = min(self.size + other.size, 1 << 60)  # only compared with small numbers
        self.head, self.tail = (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:]
        added = other.counts
        if self.scale != other.scale:
            top = max(self.scale, other.scale)
            added = {c: math.ldexp(n, other.scale - top) for c, n in added.items()}
            self.counts = {c: math.ldexp(n, self.scale - top) for c, n in self.counts.items()}
            self.scale = top
        for c, n in added.items():
            self.counts[c] = self.counts.get(c, 0) + n
        if sum(self.counts.values()) > 2.0**500:
            self.counts = {c: math.ldexp(n, -500) for c, n in self.counts.items()}
            self.scale += 500

    def score(self) -> float:
        """How much a literal looks like a secret, 0 to 1."""
        if self.size < 8 or self.inside or (self.size <= EDGE and PLACEHOLDER.search(self.head)):
            return 0.0
        if any(c.isspace() for c in self.counts) or len({c.lower() for c in self.counts}) == 1:
            return 0.0
        total = sum(self.counts.values())
        bits = -sum(n / total * math.log2(n / total) for n in self.counts.values() if n)
        kinds = {next((k for k in ("a-z", "A-Z", "0-9") if k[0] <= c <= k[2]), "other") for c in self.counts}
        plain = 0.4 if len(kinds) == 1 and "0-9" not in kinds else 1.0  # a lone word
        return plain * min(1.0, bits / 2.5)


def literal_score(value: str) -> float:
    return Said(value).score()


class Parts:
    """Where the parts of a constant stand: its own, and those of the constants it refers to."""

    __slots__ = ("own", "others", "reported")

    def __init__(self):
        self.own: list[tuple[int, int]] = []
        self.others: list[Parts] = []
        self.reported = False

    def report(self) -> Iterator[tuple[int, int]]:
        """Every part that was not reported before."""
        left = [self]
        while left:
            parts = left.pop()
            if not parts.reported:
                parts.reported = True
                yield from parts.own
                left += parts.others


def is_name(value: str) -> bool:
    """A literal that says which secret is wanted, and is none."""
    return bool(re.fullmatch(NAME, value)) and not re.search("[0-9]", value) and name_score(value) >= REPORTED


class Constants:
    """What names stand for, by the functions they were given a value in."""

    def __init__(self, elsewhere: Constants | None = None):
        self.now: dict[tuple[int, str], tuple[Parts, Said]] = {}
        self.first: dict[tuple[int, str], tuple[Parts, Said]] = {}
        self.elsewhere = elsewhere  # for names that get their value further down

    def set(self, path: tuple[int, ...], name: str, value: tuple[Parts, Said]) -> None:
        self.now[path[-1], name] = value
        self.first.setdefault((path[-1], name), value)

    def get(self, path: tuple[int, ...], name: str) -> tuple[Parts, Said] | None:
        for scope in reversed(path):
            if (scope, name) in self.now:
                return self.now[scope, name]
        for scope in reversed(path) if self.elsewhere else ():
            if (scope, name) in self.elsewhere.first:
                return self.elsewhere.first[scope, name]
        return None


def _evaluated(terms: list[Term], path: tuple[int, ...], known: Constants) -> tuple[Parts, Said]:
    parts, said = Parts(), Said()
    for term in terms:
        name = term if isinstance(term, str) else term.value if not term.certain else None
        value = known.get(path, name) if name else None
        if value:
            parts.others.append(value[0])
            said.add(value[1])
        elif isinstance(term, Literal):
            word = term.value
            surely = term.certain or not re.fullmatch(NAME, word) or re.search("[0-9]", word)
            if word and surely and not is_name(word):
                parts.own.append((term.start, term.end))
                said.add(Said(word))
    return parts, said


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names, which may get their values later.

    All parts of a literal are scored together and reported together, however many and short they are.
    """
    found = {
        (*m.span("word"), "literal") for m in ADDRESS.finditer(text) if literal_score(m["word"]) >= REPORTED
    }
    every = list(assignments(text))
    scores = [[name_score(name) for name in given.names] for given in every]
    if not any(score >= REPORTED for own in scores for score in own):  # a literal scores 1 at most
        return list(found)
    read = []
    for given, own in zip(every, scores):
        sensitive = max(own) >= REPORTED
        if sensitive or given.kind in DEFINING:
            read.append((given, own, values(text, given.at, given.kind == "many", sensitive)))
    known = None
    for last in (False, True):
        known = Constants(known)
        for given, own, elements in read:
            by_name: list[list[tuple[Parts, Said]]] = [[] for _ in given.names]
            for place, terms in elements:
                value = _evaluated(terms, given.path, known)
                if place < len(by_name) and (value[0].own or value[0].others):
                    by_name[place].append(value)
            for name, score, made in zip(given.names, own, by_name):
                if last and score >= REPORTED:
                    for parts, said in made:
                        if score * said.score() >= REPORTED:
                            found |= {(a, z, "literal") for a, z in parts.report()}
                if made and given.kind in DEFINING:
                    known.set(given.path, re.split(r"[.\-]", name)[-1], made[0])
    return list(found)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by start and then kind. Ends are exclusive."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    added = literal_spans(text) if "://" in lowered or any(w in lowered for w in TRIGGERS) else []
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str) -> str:
    """The text without its secrets: values are replaced, names stay."""
    _, spans = scan(text)
    cuts = []
    for start, end, kind in spans:
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        cuts.append((start, end))
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


FIELDS = (
    "n_assign: bigint, n_access: bigint, n_hex: bigint, n_literal: bigint, base_sha256: string, spans: string"
)


def with_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds counts by kind, the digest of the base spans, and all spans; such columns are replaced.

    A null text is empty and has no spans: all counts 0, ``spans`` empty. Places
    are code points of the whole text, however long. Repeated rows are
    reported each.
    """

    def setup():
        forget()

        def work(batch: pa.Array) -> list[pa.Array]:
            rows = []
            for text in texts(batch):
                base, spans = scan(text)
                n = Counter(kind for _, _, kind in spans)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [[]] * 6
            return [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)]

        return work

    return with_fields(docs, F.col(text_col), FIELDS, setup)


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets masked in the text. A null text stays null.

    ``length_col``, if there is one, becomes the new length where the text changed.
    """

    def setup():
        forget()
        return lambda batch: [pa.array([t if t is None else masked(t) for t in batch.to_pylist()], pa.string())]

    (holder,) = fresh(docs, "made")
    made = docs.withColumn(holder, computed("value: string", setup)(F.col(text_col)))
    value = F.col(f"{holder}.value")
    changes = {text_col: value}
    if length_col in docs.columns:
        same = value.eqNullSafe(F.col(text_col))
        kind = docs.schema[length_col].dataType
        changes = {length_col: F.when(same, F.col(length_col)).otherwise(F.length(value).cast(kind)), **changes}
    return made.withColumns(changes).drop(holder)
