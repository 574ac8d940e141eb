"""Public tokenizers with word memos: the library's own ids, without encoding a word twice."""

from __future__ import annotations

import re
import string
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from passagework.llm.common import MEMO_ENTRIES, MEMO_KEY_CHARS, Memo

# Fixed value: how byte-level vocabularies write the 256 bytes as characters.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_MOVED = [b for b in range(256) if b not in set(_KEPT)]
BYTE_CHARS = {**{b: chr(b) for b in _KEPT}, **{b: chr(256 + i) for i, b in enumerate(_MOVED)}}

# Fixed value: the pre-tokens of byte_bpe_50k.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Latin letters, all composed and of one simple lower case, and the ASCII marks but the apostrophe
LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
MARKS = string.punctuation.replace("'", "")

# a plain word: such letters, and such marks behind them
PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(MARKS)}]*)").fullmatch


def byte_chars(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


def gathered(values: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that are wanted, one after the other, and where each begins and the last ends."""
    lengths = np.diff(offsets)[wanted]
    ends = np.cumsum(lengths)
    bounds = np.r_[0, ends]
    return values[np.repeat(offsets[wanted] - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids by a vocabulary that drops white space and lower-cases (word_bpe_49k).

    No token spans white space, so the ids of a text are those of its parts
    between blanks. Texts are cut in batches, and only the distinct parts of a
    batch are looked at. A plain word and the marks behind it are two
    pre-tokens, each of them encoded once in a batch and remembered for the
    next; any other part goes through the library as it is. The words that are
    tokens of the vocabulary are given.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        ending = "</w>"  # how the vocabulary marks the end of a word
        whole = {w.removesuffix(ending): i for w, i in self.tokenizer.get_vocab().items() if w.endswith(ending)}
        self.given = {w: array("I", [i]).tobytes() for w, i in whole.items() if w.isascii() and w.isalpha() and w.islower()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _remember(self, made: dict[str, bytes]) -> None:
        """In two generations: when the young one is full it becomes the old one."""
        if len(self.young) + len(made) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        self.young |= made

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens in lower case."""
        ids, ends, tokenize = array("I"), [0], self.model.tokenize
        for word in map(byte_chars, words):
            ids.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(ids))
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip(ends, ends[1:])]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens, from memory as far as they are there."""
        given, young, old = self.given.get, self.young.get, self.old.get
        found = [given(w) or young(w) or old(w) for w in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._encoded([words[i] for i in missing])):
            found[i] = ids
        used = ((w, ids) for w, ids in zip(words, found) if w not in self.given and len(w) <= MEMO_KEY_CHARS)
        self._remember(dict(islice(used, MEMO_ENTRIES)))
        return found

    def of_parts(self, parts: pa.Array) -> list[bytes]:
        """The ids of distinct parts between blanks."""
        behind = pc.utf8_ltrim(parts, LETTERS)
        plain = pc.and_(pc.equal(pc.utf8_ltrim(behind, MARKS), ""), pc.less(pc.binary_length(behind), pc.binary_length(parts)))
        words = pc.utf8_lower(pc.utf8_rtrim(parts.filter(plain), MARKS)).dictionary_encode()
        marks = behind.filter(plain).dictionary_encode()
        both = self.of_words(strings(words.dictionary) + [m for m in strings(marks.dictionary) if m])
        rest = iter(both[len(words.dictionary) :])
        of_mark = [next(rest) if m else b"" for m in strings(marks.dictionary)]
        of_word = map(both.__getitem__, np.asarray(words.indices).tolist())
        ready = list(map(bytes.__add__, of_word, map(of_mark.__getitem__, np.asarray(marks.indices).tolist())))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for at, part in zip(odd.tolist(), strings(parts.take(pa.array(odd)))):
            ready.insert(at, self._whole(part))
        return ready

    def _whole(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes() if part else b""

    def of_batch(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts, and the places where each text begins and the last ends."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(batch, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        made = self.of_parts(coded.dictionary)
        offsets = np.cumsum([0, *map(len, made)]) // 4
        ids, bounds = gathered(np.frombuffer(b"".join(made), "<u4"), offsets, np.asarray(coded.indices))
        return ids, bounds[np.cumsum(np.r_[0, np.asarray(parts.value_lengths())])]


def frequent_lengths(path: str) -> dict[str, int]:
    """Token counts of the words that the vocabulary itself lists, as it saw them often.

    At most one entry per vocabulary item, and the same whatever the corpus.
    Keys are words that follow a blank.
    """
    tokenizer = Tokenizer.from_file(path)
    back = {c: b for b, c in BYTE_CHARS.items()}
    found = {}
    for item in tokenizer.get_vocab():
        if item[0] == BYTE_CHARS[0x20] and all(c in back for c in item):
            word = bytes(back[c] for c in item[1:]).decode(errors="replace")
            if PLAIN(word):
                found[word] = len(tokenizer.encode(" " + word, add_special_tokens=False).ids)
    return found


class TokenLengths:
    """Token counts by a byte-level vocabulary (byte_bpe_50k), two lookups deep.

    A pre-token starts at every blank between two other characters, so a text
    without double blanks falls into parts that are counted one by one. Each
    part is looked up in the shared table of frequent ones, then in the
    worker's memo, and only then encoded.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo(lambda piece: len(self.model.tokenize(byte_chars(piece))))
        self.parts = Memo(self._part, frequent)
        self.split = regex.compile(BYTE_PATTERN)

    def _part(self, part: str) -> int:
        if plain := PLAIN(part):
            word, marks = plain.groups()
            return self.pieces[" " + word] + (self.pieces[marks] if marks else 0)
        return self._whole(" " + part)

    def _whole(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.pieces.__getitem__, self.split.findall(text)))

    def count(self, text: str) -> int:
        if "  " in text:
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + sum(map(self.parts.__getitem__, rest))
