"""URL filters by a bit-parallel wildcard automaton.

All glob rules together are one long bit string, packed into 64-bit words: one
bit per place in a rule. A character moves every rule at once by a shift and
two masks. The URLs of a batch take their n-th step together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import computed, forget, fresh, quoted

# The base rules, as verdict, host and path.
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# What no base rule decides: a page is blocked if one of these fits ".host/path".
BLOCK_GLOBS = [
    "**casino**",
    "*.spam-*/**",
    "*-spam.*/**",
    "*.adserver.*/**",
    "*.doubleclick.*/**",
    "**/wp-login.php**",
    "**/cgi-bin/**",
    "**/search?result**",
    "**.exe",
    "**.zip",
    "**/tag/?/**",
]


def rule_glob(host: str, path: str) -> str:
    """The host and all below it, and every path that starts so, as a glob on ``.host/path``."""
    return f"*.{host}{path}**"


class GlobAutomaton:
    """Shift-And over many globs at once, anchored at both ends.

    ``**`` is any run of bytes, ``*`` any run without ``/``, ``?`` one byte but
    ``/``; other characters stand for their UTF-8 bytes.
    """

    def __init__(self, globs: list[str]):
        parsed = [self._parse(glob) for glob in globs]
        bits = sum(len(steps) + 1 for steps, _ in parsed)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        slash = np.arange(256) == ord("/")
        base = 0
        for steps, runs in parsed:
            self._set(self.start, base)
            for place, run in runs.items():
                self._set(self.stay, base + place, slice(None) if run == "**" else ~slash)
            for place, symbol in enumerate(steps, start=base + 1):
                self._set(self.step, place, ~slash if symbol is None else symbol)
            self.ends.append(((base + len(steps)) // 64, np.uint64(1 << (base + len(steps)) % 64)))
            base += len(steps) + 1

    @staticmethod
    def _set(masks: np.ndarray, bit: int, rows=...) -> None:
        masks[..., bit // 64][rows] |= np.uint64(1 << bit % 64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, str]]:
        steps: list[int | None] = []
        runs: dict[int, str] = {}
        raw = glob.encode()
        at = 0
        while at < len(raw):
            if raw[at : at + 1] == b"*":
                double = raw[at : at + 2] == b"**"
                runs[len(steps)] = "**" if double or runs.get(len(steps)) == "**" else "*"
                at += 2 if double else 1
            else:
                steps.append(None if raw[at : at + 1] == b"?" else raw[at])
                at += 1
        return steps, runs

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """``[text, glob]``: whether the whole text fits the glob."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        falling = -lengths[order]
        for at in range(int(lengths.max(initial=0))):
            going = int(np.searchsorted(falling, -at, "left"))  # those with more than `at` bytes
            byte = buffer[begin[:going] + at]
            now = state[:going]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:going] = (moved & self.step[byte]) | (now & self.stay[byte])
        found = np.empty((len(texts), len(self.ends)), bool)
        for number, (word, bit) in enumerate(self.ends):
            found[order, number] = (state[:, word] & bit) != 0
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null, and for an URL without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_CASES)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


_CASES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(
    pages: DataFrame,
    url_col: str = "url",
    rules: list[tuple[str, str, str]] | None = None,
    block_globs: list[str] | None = None,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    The longest rule that fits decides; of equally long ones the first. Where
    none fits, ``rule`` is null and a page is blocked by any of ``block_globs``,
    else allowed. A null URL, or one without ``://``, has neither host nor path
    and is judged as such. Rows are judged one by one, repeated ones alike.
    """
    rules = BASE_RULES if rules is None else rules
    globs = [rule_glob(host, path) for _, host, path in rules] + (BLOCK_GLOBS if block_globs is None else block_globs)

    def setup():
        forget()
        automaton = GlobAutomaton(globs)
        by_length = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]) - len(rules[i][2]), i))

        def work(batch: pa.Array) -> list[pa.Array]:
            found = automaton.matches([u.encode() for u in batch.to_pylist()])
            blocked = found[:, len(rules) :].any(axis=1)
            rule = np.full(len(found), -1)
            for i in reversed(by_length):
                rule[found[:, i]] = i
            names = [None if i < 0 else rules[i][1] + rules[i][2] for i in rule]
            verdicts = [("block" if b else "allow") if i < 0 else rules[i][0] for i, b in zip(rule, blocked)]
            return [pa.array(names, pa.string()), pa.array(verdicts, pa.string())]

        return work

    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in made]
    host, path, holder = fresh(pages, "own_host", "own_path", "judged")
    parts = pages.withColumns(dict(zip((host, path), host_and_path(F.col(url_col)))))
    whole = F.concat(F.lit("."), F.col(host), F.col(path))
    parts = parts.withColumn(holder, computed("rule: string, verdict: string", setup)(whole))
    columns = [F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{holder}.rule"), F.col(f"{holder}.verdict")]
    return parts.select(*quoted(*kept), *columns)


def glob_regex(glob: str) -> str:
    """The glob as an anchored regular expression, for the SQL check."""
    special, out, at = ".^$+(){}[]|\\", "", 0
    while at < len(glob):
        if glob[at] == "*":
            double = glob[at : at + 2] == "**"
            out += "(?s:.*)" if double else "[^/]*"
            at += 2 if double else 1
            continue
        out += "[^/]" if glob[at] == "?" else ("\\" + glob[at] if glob[at] in special else glob[at])
        at += 1
    return f"^{out}$"


def oracle() -> str:
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in BASE_RULES]
    order = sorted(range(len(BASE_RULES)), key=lambda i: -len(BASE_RULES[i][1] + BASE_RULES[i][2]))
    rule = " ".join(f"WHEN {fits[i]} THEN '{BASE_RULES[i][1]}{BASE_RULES[i][2]}'" for i in order)
    verdict = " ".join(f"WHEN {fits[i]} THEN '{BASE_RULES[i][0]}'" for i in order)
    blocked = " OR ".join(f"regexp_matches('.' || host || path, '{glob_regex(g)}')" for g in BLOCK_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_CASES[0]}', '{_CASES[1]}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
