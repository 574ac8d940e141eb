"""Quality rules on how well public vocabularies fit a text.

Every distinct word is encoded once per worker; counts of a document are sums
over its words. Text in a language a vocabulary knows has usual characters per
token, few byte-fallback tokens and many different tokens; outside the bands of
its language or script a document is rejected.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import per_worker, runs_of, with_fields
from passagework.operators.ranking import ranges

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_multi_50k.tiktoken"
WINDOW_WORDS = 8
RUN_BYTES = 4 << 20
TABLE_WORDS = 1 << 18
SLACK_TOKENS = 1.0  # a text of n tokens has so many nths of room beyond its bands: a short one says less

# Parameters: least and most characters per piece token and per byte token, most
# byte-fallback share, least entropy as a share of what so many tokens can have.
BANDS = {
    "latin": (1.2, 9.0, 0.15, 0.42),
    "cyrillic": (1.0, 9.0, 0.25, 0.42),
    "greek": (0.7, 9.0, 0.50, 0.38),
    "cjk": (0.3, 4.0, 0.75, 0.35),
    "other": (0.2, 9.0, 0.85, 0.30),
}
LANGUAGES = {"en": "latin", "fr": "latin", "de": "latin", "es": "latin", "it": "latin", "pt": "latin", "nl": "latin"}
LANGUAGES |= {"ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "el": "greek", "zh": "cjk", "ja": "cjk", "ko": "cjk"}

FIELDS = (
    "n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "n_tokens: bigint, chars_per_token: double, chars_per_byte_token: double, fallback_share: double, "
    "token_entropy: double, base_failed: boolean, kept: boolean"
)

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = ~_BLANK & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))  # first byte of a code point in a word


def script(text: str) -> str:
    """The script of most letters."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = letters[(letters > 0x40) & ~((letters > 0x5A) & (letters < 0x61)) & ~((letters > 0x7A) & (letters < 0xC0))]
    limits = [(0x0250, "latin"), (0x0370, "other"), (0x0400, "greek"), (0x0530, "cyrillic"), (0x2E80, "other"), (0xD7B0, "cjk")]
    if not len(letters):
        return "other"
    place = np.searchsorted([limit for limit, _ in limits], letters, "right")
    most = int(np.bincount(place, minlength=len(limits) + 1).argmax())
    return limits[most][1] if most < len(limits) else "other"


class WordTable:
    """What the vocabularies make of every word seen; emptied when it has grown too large."""

    def __init__(self, pieces: str, ranks: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as lines:
            items = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.bytes = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=items, special_tokens={})
        size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.byte_tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > TABLE_WORDS:
            self.clear()
        new = list(set(words) - self.number.keys())
        if new:
            text = [w.decode(errors="replace") for w in new]
            ids = self.pieces.encode(text, num_threads=1)
            lengths = np.array([len(i) for i in ids], np.int64)
            self.start = np.r_[self.start, len(self.ids) + np.cumsum(lengths) - lengths]
            self.length = np.r_[self.length, lengths]
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))]
            self.hash = np.r_[self.hash, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)]
            tokens = [len(self.bytes.encode_ordinary(" " + w)) for w in text]
            self.byte_tokens = np.r_[self.byte_tokens, np.array(tokens, np.int64)]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that end at ``ends``."""
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[np.r_[0, ends[:-1]]]


def repeated_words(hashes: np.ndarray, counts: np.ndarray, width: int = WINDOW_WORDS) -> np.ndarray:
    """Words of each document that lie in a window of ``width`` words found twice or more in it."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    rolled = np.zeros(n, np.uint64)
    for place in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[place : place + n]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled += doc[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    rolled = rolled[inside]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        at = inside[twice[np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)] == rolled]
        covered[at] += 1
        covered[at + width] -= 1
    return _sums(np.cumsum(covered[:-1]) > 0, ends)


def measure(table: WordTable, raw: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of every text."""
    split = [t.split() for t in raw]
    counts = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(counts)
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    byte_ends = np.cumsum([len(t) for t in raw])
    lines = [[line for line in t.split(b"\n") if line and not line.isspace()] for t in raw]
    number = table.numbers(list(chain.from_iterable(split)))
    tokens = table.length[number]
    per_doc = _sums(tokens, ends)
    ids = table.ids[ranges(table.start[number], tokens)]
    size = len(table.fallback)
    cells = np.sort(np.repeat(np.arange(len(raw)), per_doc) * size + ids)
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(cells)])
    spread = np.bincount(cells[first] // size, times * np.log2(times), minlength=len(raw)) if len(cells) else np.zeros(len(raw))
    total = np.maximum(per_doc, 1)
    chars = _sums(_LETTER[buffer], byte_ends)
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": _sums(_SYMBOL[buffer], byte_ends),
        "n_dup_lines": np.array([len(rows) - len(set(rows)) for rows in lines], np.int64),
        "n_repeat_words": repeated_words(table.hash[number], counts),
        "n_tokens": per_doc,
        "chars_per_token": chars / total,
        "chars_per_byte_token": chars / np.maximum(_sums(table.byte_tokens[number], ends), 1),
        "fallback_share": _sums(table.fallback[ids], np.cumsum(per_doc)) / total,
        "token_entropy": np.maximum(np.log2(total) - spread / total, 0.0),
    }


def judge(found: dict[str, np.ndarray], bands: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """``base_failed`` and ``kept``."""
    words = found["n_words"]
    failed = (words < 20) | (100 * found["n_repeat_words"] > 30 * words)
    least, most, fallback, entropy = bands.T
    tokens = found["n_tokens"]
    possible = np.log2(np.clip(tokens, 2, vocabulary))
    room = SLACK_TOKENS / np.maximum(tokens, SLACK_TOKENS)
    fits = (found["fallback_share"] <= fallback * (1 + room)) & (found["token_entropy"] >= entropy * (1 - room) * possible)
    for name in ("chars_per_token", "chars_per_byte_token"):
        fits &= (found[name] >= least * (1 - room)) & (found[name] <= most * (1 + room))
    return failed, ~failed & fits


def with_quality(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", pieces: str | None = None, ranks: str | None = None
) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept``; columns of these names are replaced.

    A null or empty text has no words and fails the base rules. A language
    that is null or has no band is judged by the script of the text. Every row
    is judged by itself and whole, however long.
    """
    pieces, ranks = pieces or public_tokenizers.path(PIECES), ranks or public_tokenizers.path(BYTES)
    names = [f.split(":")[0].strip() for f in FIELDS.split(",")]

    def setup():
        table = per_worker(("word table", pieces, ranks), lambda: WordTable(pieces, ranks))

        def work(batch: pa.StructArray) -> list[pa.Array]:
            raw = [t or b"" for t in batch.field("text").cast(pa.large_binary()).to_pylist()]
            langs = batch.field("lang").to_pylist()
            columns: dict[str, list] = {n: [] for n in names}
            at = 0
            for run in runs_of(raw, len, RUN_BYTES):
                found = measure(table, run)
                own = [LANGUAGES.get(lang) or script(t.decode(errors="replace")) for t, lang in zip(run, langs[at:])]
                bands = np.array([BANDS[o] for o in own]).reshape(-1, 4)
                found["base_failed"], found["kept"] = judge(found, bands, len(table.fallback))
                for n in names:
                    columns[n].append(found[n])
                at += len(run)
            return [pa.array(np.concatenate(columns[n])) if columns[n] else pa.array([], t) for n, t in zip(names, types)]

        return work

    types = [*[pa.int64()] * 6, *[pa.float64()] * 4, pa.bool_(), pa.bool_()]
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    return with_fields(docs, F.struct(F.col(text_col).alias("text"), lang.alias("lang")), FIELDS, setup)
