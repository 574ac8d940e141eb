"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most k edits keeps at least
m + 1 - q (k + 1) of its q-grams, all on neighbouring diagonals. So the shared
q-grams of a document and a passage are counted in overlapping bands of
diagonals; bands that reach the bound are aligned, and what needs no more than
k edits is a leak.

Benchmark items are cut into overlapping windows of two lengths, so part of an
item is found as well. The next window is never further than the edits of one, so
a verbatim excerpt is found wherever it begins: from 60 characters on it is no more
than 5 edits from a window. The windows are a query set that is stated beforehand: they go
to the tasks in blocks of bounded size, and each block takes one scan of the
documents.

Windows of an item share most q-grams. So each q-gram of an item is looked up
once, in bands of diagonals of the item, and only what may reach the bound of a
window there is counted for every window that holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import computed, fresh, per_worker, runs_of, texts
from passagework.operators.ranking import ranges
from passagework.session import scratch_path

Q = 8
SHORT_Q = 4  # of the second count, before the alignment
WINDOWS = (60, 100)  # characters of a passage that is looked for as a whole
SHORTEST = 32  # a shorter item is looked for as it is, between word borders; one without a q-gram is none
ERRORS = 0.1  # edits per character
WORD = 64  # characters of a window that is aligned in one machine word
BLOCK_WINDOWS = 1 << 16
NEIGHBOURS = 1 << 10  # windows of an item that begin in so many characters go in one block
RUN_CHARS = 1 << 20
RUN_PAIRS = 1 << 19
TABLE_BITS = 22
ALIGNED_AT_ONCE = 1 << 12


def normal(text: str) -> str:
    """Lower case, one blank between words."""
    return " ".join(text.lower().split())


def cuts(text: str) -> list[tuple[int, str]]:
    """The windows of a text and where they begin: of each length, or the whole text if it is shorter."""
    text = normal(text)
    if len(text) < SHORTEST:
        return [(0, text)] if len(text) >= Q else []
    found = set()
    for length in WINDOWS:
        last = max(len(text) - length, 0)
        found |= {(start, length) for start in (*range(0, last, int(length * ERRORS)), last)}
    return [(start, text[start : start + length]) for start, length in sorted(found) if length <= len(text) or length == WINDOWS[0]]


def windows(text: str) -> list[str]:
    return [passage for _, passage in cuts(text)]


def codes(chars: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each character, one byte for each of its characters.

    Different characters may share a byte; the alignment tells them apart.
    """
    folded = (chars ^ (chars >> 8)).astype(np.uint8)
    n = len(folded) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    made = np.empty(n, np.uint64)
    for offset in range(Q):
        part = folded[offset : offset + (len(folded) - offset) // Q * Q]
        part = np.frombuffer(part.tobytes(), "<u8")
        made[offset::Q] = part[: len(made[offset::Q])]
    return made


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, how often each is there, and how often the key that follows it is."""
    if len(keys) == 1:
        key, total = keys[0], counts[0]
    else:
        key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.zeros(0), *counts])).astype(np.int64)
    after = np.zeros_like(total)
    after[:-1] = np.where(key[1:] == key[:-1] + 1, total[1:], 0)
    return key, total, after


class WindowIndex:
    """The q-grams of the windows of one block. ``starts`` says where a window begins in its item."""

    def __init__(self, items: list[int], passages: list[str], starts: list[int] | None = None):
        self.whole = ahocorasick.Automaton()
        for item, passage in zip(items, passages):
            if len(passage) < SHORTEST:
                held = self.whole.get(passage, (passage, set()))
                held[1].add(item)
                self.whole.add_word(passage, held)
        if len(self.whole):
            self.whole.make_automaton()
            long = [i for i, passage in enumerate(passages) if len(passage) >= SHORTEST]
            items, passages = [items[i] for i in long], [passages[i] for i in long]
            starts = None if starts is None else [starts[i] for i in long]
        self.items = np.array(items, np.int64)
        self.chars = [code_points(p) for p in passages]
        self.length = np.array([len(c) for c in self.chars], np.int64)
        self.edits = (self.length * ERRORS).astype(np.int64)
        self.bound = self.length + 1 - Q * (self.edits + 1)
        self.reach = 2 * self.edits + 1  # diagonals of one occurrence
        self.widest = int(self.reach.max(initial=1))
        # windows of an item are a group; if it is not known where they begin, each is one of its own
        group = np.arange(len(items)) if starts is None else np.unique(self.items, return_inverse=True)[1]
        self.start = np.zeros(len(items), np.int64) if starts is None else np.array(starts, np.int64)
        self.least = np.full(len(items), 1 << 30)
        np.minimum.at(self.least, group, self.bound)
        found = [codes(c) for c in self.chars]
        window = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, np.int64)
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        # entries: a q-gram at a place of a group; each has its windows
        entry_place = place + self.start[window]
        order = np.lexsort((entry_place, group[window], every))
        window, place, every, entry_place = window[order], place[order], every[order], entry_place[order]
        own = group[window]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (own[1:] != own[:-1]) | (entry_place[1:] != entry_place[:-1])
        at = np.flatnonzero(new)
        self.window, self.place = window, place
        self.window_first, self.window_times = at, np.diff(np.r_[at, len(every)])
        self.group, self.group_place = own[at], entry_place[at]
        self.room = int(self.group_place.max(initial=0)) + 1
        self.codes, self.first, self.times = np.unique(every[at], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.codes)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text whose q-gram is in the index, and its number there."""
        at = np.flatnonzero(self.table[self._slot(code)])
        number = np.minimum(np.searchsorted(self.codes, code[at]), max(len(self.codes) - 1, 0))
        true = self.codes[number] == code[at] if len(self.codes) else np.zeros(0, bool)
        return at[true], number[true]

    def near(self, chars: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions and entries in bands of a group that hold as many as a window of it must."""
        at, number = self.hits(codes(chars))
        times = self.times[number]
        ends = np.cumsum(times)
        bands = (len(chars) + self.room) // self.widest + 4
        keys, counts = [], []

        def part_of(begin: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
            done = ends[begin - 1] if begin else 0
            upto = max(int(np.searchsorted(ends, done + RUN_PAIRS, "right")), begin + 1)
            part = slice(begin, upto)
            entry = ranges(self.first[number[part]], times[part])
            text_at = np.repeat(at[part], times[part])
            own = doc[text_at]
            band = (text_at - first[own] - self.group_place[entry] + self.room) // self.widest
            return upto, text_at, entry, (own * len(self.length) + self.group[entry]) * bands + band

        begin = 0
        while begin < len(at):
            begin, _, _, key = part_of(begin)
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            counts.append(n)
        key, total, after = tally(keys, counts)
        # an occurrence lies in one band or in two that follow each other
        enough = total + after >= self.least[key // bands % len(self.length)]
        enough[1:] |= enough[:-1] & (after[:-1] > 0)
        passed = key[enough]
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(at) and len(passed):
            begin, text_at, entry, key = part_of(begin)
            found = passed[np.minimum(np.searchsorted(passed, key), len(passed) - 1)] == key
            kept.append((text_at[found], entry[found]))
        if not kept:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate([t for t, _ in kept]), np.concatenate([e for _, e in kept])

    def candidates(self, chars: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """``doc, window, band`` that reach the bound, of texts laid end to end.

        ``doc`` numbers the text of each character, ``first`` is where a text begins.
        """
        at, held = self.near(chars, doc, first)
        times = self.window_times[held]
        ends = np.cumsum(times)
        keys, counts = [], []
        begin = 0
        bands = 2 * (len(chars) + WINDOWS[-1]) // int(self.reach.min(initial=1)) + 8
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            upto = max(int(np.searchsorted(ends, done + RUN_PAIRS, "right")), begin + 1)
            part = slice(begin, upto)
            entry = ranges(self.window_first[held[part]], times[part])
            text_at = np.repeat(at[part], times[part])
            window, place = self.window[entry], self.place[entry]
            own = doc[text_at]
            diagonal = text_at - first[own] - place + WINDOWS[-1]  # not negative
            key, n = np.unique((own * len(self.length) + window) * bands + diagonal // self.reach[window], return_counts=True)
            keys.append(key)
            counts.append(n)
            begin = upto
        key, total, after = tally(keys, counts)
        rest, band = np.divmod(key, bands)
        own, window = np.divmod(rest, len(self.length))
        enough = total + after >= self.bound[window]
        return own[enough], window[enough], band[enough] + 1  # band b holds the diagonals from (b - 1) * reach to (b + 1) * reach

    def align(self, chars: np.ndarray, size: np.ndarray, first: np.ndarray, own: np.ndarray, window: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Least edits of each window against its band."""
        least = np.empty(len(own), np.int64)
        order = np.argsort(self.length[window], kind="stable")
        lengths, begins = np.unique(self.length[window[order]], return_index=True)
        for length, same in zip(lengths, np.split(order, begins[1:])):
            by = self._by_word if length <= WORD else self._by_diagonals
            for begin in range(0, len(same), ALIGNED_AT_ONCE):
                part = same[begin : begin + ALIGNED_AT_ONCE]
                pattern = np.stack([self.chars[w] for w in window[part]])
                reach = int(self.reach[window[part[0]]])
                from_text = (band[part] - 1) * reach - WINDOWS[-1]  # the first diagonal
                where = size[own[part]], first[own[part]]
                may = self._shares(pattern, reach, from_text, chars, *where)
                least[part] = length
                least[part[may]] = by(pattern[may], reach, from_text[may], chars, *(w[may] for w in where))
        return least

    @staticmethod
    def _shares(pattern: np.ndarray, reach: int, from_text: np.ndarray, chars: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which windows keep as many shorter q-grams in their band as the lemma asks for."""
        n, length = pattern.shape
        grams = length + 1 - SHORT_Q
        place = from_text + np.arange(length + 2 * reach)[:, None]
        inside = (place >= 0) & (place < size)
        text = np.where(inside, chars[np.where(inside, first + place, 0)], 0)

        def short(c: np.ndarray) -> np.ndarray:
            byte = (c ^ (c >> 8)).astype(np.uint8).astype(np.uint32)
            return sum(byte[i : len(byte) + 1 - SHORT_Q + i] << np.uint32(8 * i) for i in range(SHORT_Q))

        own, other = short(np.ascontiguousarray(pattern.T)), short(text)
        kept = np.zeros(n, np.int64)
        for row in range(grams):
            kept += (other[row : row + 2 * reach] == own[row]).any(axis=0)
        return kept >= grams - SHORT_Q * ((reach - 1) // 2)

    @staticmethod
    def _by_word(pattern: np.ndarray, reach: int, from_text: np.ndarray, chars: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Alignment column by column, the differences down a column as bits (Myers 1999)."""
        n, length = pattern.shape
        slack = (reach - 1) // 2
        one, top = np.uint64(1), np.uint64(length - 1)
        plus, minus = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
        cost = np.full(n, length)
        least = cost.copy()
        same = np.zeros((n, WORD), bool)
        for column in range(length + 2 * reach + 2 * slack):
            place = from_text - slack + column
            inside = (place >= 0) & (place < size)
            text = chars[np.where(inside, first + place, 0)]
            same[:, :length] = inside[:, None] & (pattern == text[:, None])
            equal = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(across | plus), plus & across
            cost = cost + ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
            up, down = up << one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
            least = np.minimum(least, cost)
        return least

    @staticmethod
    def _by_diagonals(pattern: np.ndarray, reach: int, from_text: np.ndarray, chars: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Alignment row by row along the diagonals of the band."""
        slack = (reach - 1) // 2
        width = 2 * reach + 2 * slack
        across = np.arange(width)
        cost = np.zeros((len(pattern), width), np.int64)
        for row in range(pattern.shape[1]):
            place = (from_text - slack)[:, None] + row + across
            inside = (place >= 0) & (place < size[:, None])
            text = chars[np.where(inside, first[:, None] + place, 0)]
            other = ~inside | (text != pattern[:, row : row + 1])
            skipped = np.c_[cost[:, 1:], np.full(len(pattern), 1 << 20)] + 1
            cost = np.minimum(cost + other, skipped)
            cost = np.minimum.accumulate(cost - across, axis=1) + across
        return cost.min(axis=1)

    def whole_items(self, text: str) -> list[tuple[int, int, int]]:
        """The short items that stand in a text as they are, not inside of longer words."""
        if not len(self.whole):
            return []
        found = set()
        for last, (passage, items) in self.whole.iter(text):
            before, after = text[last - len(passage) : last - len(passage) + 1] if last >= len(passage) else "", text[last + 1 : last + 2]
            if not (before.isalnum() and passage[0].isalnum()) and not (after.isalnum() and passage[-1].isalnum()):
                found |= items
        return [(int(i), 1, 0) for i in sorted(found)]

    def leaks(self, run: list[str]) -> list[list[tuple[int, int, int]]]:
        """``item, windows found, least edits`` for every text."""
        plain = [normal(t) for t in run]
        found = [self.whole_items(t) for t in plain]
        if not len(self.codes):
            return found
        size = np.array([len(t) for t in plain], np.int64)
        # texts are kept apart by more characters than a q-gram has
        chars = code_points(("\0" * Q).join(plain))
        first = np.cumsum(size + Q) - size - Q
        doc = np.repeat(np.arange(len(run)), size + Q)[: len(chars)]
        own, window, band = self.candidates(chars, doc, first)
        if not len(own):
            return found
        edits = self.align(chars, size, first, own, window, band)
        true = edits <= self.edits[window]
        own, window, edits = own[true], window[true], edits[true]
        item = self.items[window]
        for d in np.unique(own):
            mine = own == d
            for i in np.unique(item[mine]):
                here = mine & (item == i)
                found[d].append((int(i), len(np.unique(window[here])), int(edits[here].min())))
        return found


FIELDS = "leaks: array<struct<item_id: bigint, n_windows: bigint, edits: bigint>>"
Block = tuple[list[int], list[str], list[int]]  # items, windows, where they begin
LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_windows", pa.int64()), ("edits", pa.int64())]))


@dataclass
class StoredBlock:
    """One block of windows, in memory only when it is its turn."""

    rows: DataFrame

    def read(self) -> Block:
        mine = self.rows.toArrow()
        return mine["item"].to_pylist(), mine["passage"].to_pylist(), mine["start"].to_pylist()


def list_of_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[StoredBlock]:
    """The windows of all items, cut once, in blocks of about ``BLOCK_WINDOWS`` rows. Items without id or text have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, start, passage)
                for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)))
                for start, passage in cuts(text)
            ]
            columns = zip(*rows) if rows else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "start", "passage"])

    named = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col))
    spark, path, schema = items.sparkSession, scratch_path(items.sparkSession, "windows"), "item bigint, start bigint, passage string"
    named.mapInArrow(cut, schema).distinct().write.parquet(path)
    every = spark.read.schema(schema).parquet(path)
    piece = F.floor(F.col("start") / NEIGHBOURS)
    size = every.agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("item", piece).alias("pieces")).first()
    blocks = max(1, min(-(-size["windows"] // BLOCK_WINDOWS), size["pieces"]))
    number = F.pmod(F.xxhash64("item", piece), F.lit(blocks))
    return [StoredBlock(every.where(number == block)) for block in range(blocks)]


def with_leaks(docs: DataFrame, name: str, block: Block, text_col: str = "text") -> DataFrame:
    """Adds the array of leaks found with the windows of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = uuid.uuid4().hex

    def setup():
        index = per_worker(key, lambda: WindowIndex(*shared.value))

        def work(batch: pa.Array) -> list[pa.Array]:
            rows = [row for run in runs_of(texts(batch), len, RUN_CHARS) for row in index.leaks(run)]
            named = [[dict(zip(("item_id", "n_windows", "edits"), leak)) for leak in row] for row in rows]
            return [pa.array(named, LEAKS)]

        return work

    (holder,) = fresh(docs, "made")
    made = docs.withColumn(holder, computed(FIELDS, setup)(F.col(text_col)))
    return made.withColumn(name, F.col(f"{holder}.leaks")).drop(holder)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, edits``: every document that holds a passage of an item.

    A null text is empty and leaks nothing, as do items that are null or have
    fewer than 8 characters; one of fewer than 32 must stand in the text as it
    is. Rows with the same or no id are documents of their own and each has its
    rows. Without items or documents there are none. Each block of windows is a
    job of its own, whose result is stored.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "leaks")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = list_of_blocks(items)
    if len(blocks) == 1:
        return with_leaks(own, "leaks", blocks[0].read()).select("doc_id", F.inline("leaks"))
    # numbered once, so that a row is the same one in every block
    numbered = own.withColumn("row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path)
    found = scratch_path(spark, "found")
    for block in blocks:
        with_leaks(numbered, "leaks", block.read()).select("doc_id", "row", F.inline("leaks")).write.mode("append").parquet(found)
    merged = spark.read.parquet(found).groupBy("doc_id", "row", "item_id")
    return merged.agg(F.sum("n_windows").alias("n_windows"), F.min("edits").alias("edits")).drop("row")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no passage of an item, with all their columns. Items need no id here."""
    (name,) = fresh(docs, "leaks")
    spark = docs.sparkSession
    blocks = list_of_blocks(items.select(F.xxhash64("text").alias("item_id"), "text"))
    for number, block in enumerate(blocks, 1):
        docs = with_leaks(docs, name, block.read(), text_col).where(F.size(name) == 0).drop(name)
        if number < len(blocks):  # one index at a time in a worker
            path = scratch_path(spark, "without-leaks")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
