"""Bytes that repeat from earlier documents, by a distributed merge sort of sparse suffixes.

Whatever fifty bytes two documents share, the sixteen bytes of least hash among
them stand at the same place in both. So suffixes that begin there are enough,
about one byte in seventeen, if each carries what stands before it as well.
Suffixes whose sixteen bytes occur in one document only cannot match and stay
where they are; for that, hashes are exchanged first.

Each part of the table sorts its suffixes and sends them as front-coded runs: a
suffix is the length of the prefix it shares with the one before, and the rest.
Where runs of a range meet, a loser tree merges them. It holds the length of
the prefix that each run's head shares with the last suffix that came out, so
heads are told apart by these numbers, and bytes are compared only from there
on. The merged order and its prefix lengths say which suffixes share how much;
what they share before is compared where the prefixes meet.

Equal suffixes of a part travel once, with the least document. Sixteen bytes
that very many suffixes begin with would meet in one range: there, the fifty
bytes of every place travel as suffixes of their own, dealt by all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import forget, give_back
from passagework.llm.parts import groups, in_parts, numbered, spread, squeezed, table_of
from passagework.session import scratch_path

LEAST = 50
GRAM = 16
BEFORE = LEAST - GRAM  # bytes that are kept of what stands before a suffix
WIDTH = LEAST + BEFORE + 2  # a suffix, what is before it, and which places it stands for


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results do not depend on it. All but the last two are bytes of text."""

    part: int = 8 << 20
    bucket: int = 16 << 20
    span: int = 16 << 20  # whose suffixes are merged in one range
    slot: int = 64 << 20  # whose hashes are compared in one task
    pack: int = 32 << 20  # of what a task reads, that is compressed together
    block: int = 1 << 20  # at most 2^24 less 64
    hot: int = 1 << 15  # suffixes with one beginning, from which on they are dealt by all their bytes


SIZES = Sizes()

_AT = np.uint64((1 << 24) - 1)


# places


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the sixteen bytes from every place on."""
    made, factor, size = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        made = made[:-size] * np.uint64(factor) + made[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(29)
    return made


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every place on."""
    places, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:places], values[width - size : width - size + places])


def anchors(text: np.ndarray, ends: np.ndarray, size: int = SIZES.block) -> Iterator[tuple[np.ndarray, ...]]:
    """``place, hash, least, most`` of suffixes, by blocks: windows begin from ``least`` to ``most`` bytes before.

    ``ends`` are those of the documents in ``text``; no window crosses one.
    """
    for begin in range(0, len(text) - LEAST + 1, size):
        block = text[begin : begin + size + LEAST - 1]
        hashes = gram_hashes(block)
        keyed = (hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64)
        first = (least_of(keyed, BEFORE + 1) & _AT).astype(np.int64)  # of equal hashes the foremost
        whole = np.ones(len(first), bool)
        inside = ends[(ends > begin) & (ends < begin + len(block))] - begin
        for end in inside.tolist():
            whole[max(0, end - LEAST + 1) : end] = False
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        place = first[at]
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
        last = np.r_[new[1:] - 1, len(at) - 1]
        place = place[new]
        yield place + begin, hashes[place], place - at[last], place - at[new]


PACKS = "part int, numbers array<bigint>, ids array<bigint>, lengths array<bigint>, texts binary"
PACKS_ARROW = pa.schema(
    [("part", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("numbers", "ids", "lengths")), ("texts", pa.binary())]
)


def packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The texts that a task has for each part, compressed together, about ``size`` bytes of text at a time."""
    forget()
    held: dict[int, list[tuple]] = {}
    waiting = 0

    def given() -> list[pa.RecordBatch]:
        rows = []
        for part, texts in held.items():
            numbers, ids, raw = zip(*texts)
            joined = np.frombuffer(b"".join(raw), np.uint8)
            rows.append((part, list(numbers), list(ids), [len(t) for t in raw], squeezed(joined)))
        held.clear()
        return table_of(PACKS_ARROW, rows).combine_chunks().to_batches()

    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "doc_id", "text"))):
            held.setdefault(part, []).append(row)
            waiting += len(row[-1])
            if waiting >= size:
                yield from given()
                waiting = 0
    yield from given()


class Part:
    """The texts of one part, one after the other in the order of their numbers."""

    def __init__(self, table: pa.Table):
        packs = sorted(table.select(["numbers", "ids", "lengths", "texts"]).to_pylist(), key=lambda p: p["numbers"][0])
        self.ids = [i for p in packs for i in p["ids"]]
        self.lengths = np.array([n for p in packs for n in p["lengths"]], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.raw = b"".join(spread(p["texts"], sum(p["lengths"]), "u1").tobytes() for p in packs)
        self.text = np.frombuffer(self.raw, np.uint8)
        self.known = np.array([i is not None for i in self.ids], bool)
        self.keys = np.array([i if i is not None else 0 for i in self.ids], np.int64)

    def anchors(self, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``place, hash, least, most, document``; documents without an id have none."""
        for found in anchors(self.text, self.ends, size):
            document = np.searchsorted(self.ends, found[0], "right")
            kept = self.known[document]
            yield tuple(c[kept] for c in (*found, document))


# small columns


def short(hashes: np.ndarray) -> np.ndarray:
    """48 bits, which travel. Equal ones of different bytes cost some work and change nothing.

    Mixed anew, as the least of many hashes is a small number.
    """
    return (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def dealt(values: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` equal ranges a 48-bit number is in."""
    return ((values >> np.uint64(16)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


# what can match at all


HASHES = "slot int, part int, hashes binary, seen binary"
HASHES_ARROW = pa.schema([("slot", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("seen", pa.binary())])
SURVIVORS = "part int, hashes binary, hot binary"
SURVIVORS_ARROW = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())])


def hashes_of(table: pa.Table, slots: int, sizes: Sizes) -> pa.Table:
    """The distinct beginnings of the suffixes of a part: how often each occurs, and whether in two documents."""
    forget()
    found = [(short(h), document) for _, h, _, _, document in Part(table).anchors(sizes.block)]
    if not found:
        return table_of(HASHES_ARROW, [])
    values, documents = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(values, kind="stable")
    values, documents = values[order], documents[order]
    first = groups(values)
    counts = np.diff(np.r_[first, len(values)])
    twice = np.minimum.reduceat(documents, first) != np.maximum.reduceat(documents, first)
    seen = (np.minimum(counts, 127) | (twice << 7)).astype(np.uint8)
    values = values[first]
    slot = dealt(values, slots)
    bounds = np.r_[groups(slot), len(slot)]
    part = table.column("part")[0].as_py()
    rows = [(int(slot[a]), part, six_bytes(values[a:z]), seen[a:z].tobytes()) for a, z in zip(bounds[:-1], bounds[1:])]
    give_back()
    return table_of(HASHES_ARROW, rows)


def survivors_of(table: pa.Table, sizes: Sizes) -> pa.Table:
    """Of the hashes of a slot, those of two documents, for each part that has them."""
    forget()
    parts = table.column("part").to_pylist()
    each = [from_six_bytes(b) for b in table.column("hashes").to_pylist()]
    seen = np.frombuffer(b"".join(table.column("seen").to_pylist()), np.uint8)
    values = np.concatenate(each)
    order = np.argsort(values, kind="stable")
    first = groups(values[order])
    counts = np.diff(np.r_[first, len(values)])
    twice = (counts > 1) | (np.maximum.reduceat(seen[order], first) >= 128)
    hot = np.add.reduceat((seen[order] & 127).astype(np.int64), first) >= sizes.hot
    kept, hot_ones = np.empty(len(values), bool), np.empty(len(values), bool)
    kept[order], hot_ones[order] = np.repeat(twice, counts), np.repeat(hot, counts)
    rows, at = [], 0
    for part, mine in zip(parts, each):
        own = kept[at : at + len(mine)]
        if own.any():
            rows.append((part, six_bytes(mine[own]), hot_ones[at : at + len(mine)][own].astype(np.uint8).tobytes()))
        at += len(mine)
    give_back()
    return table_of(SURVIVORS_ARROW, rows)


# sorted runs


RUNS = "kind string, span int, part int, count int, first int, a binary, b binary, c binary, d binary, e binary"
RUNS_ARROW = pa.schema(
    [("kind", pa.string()), ("span", pa.int32()), ("part", pa.int32()), ("count", pa.int32()), ("first", pa.int32())]
    + [(c, pa.binary()) for c in "abcde"]
)


def suffixes(text: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rows of bytes: the suffix, what stands before it read backwards, and the places; bytes that no window has are 0."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), text, np.zeros(LEAST, np.uint8)])
    both = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + LEAST)[place]
    made = np.empty((len(place), WIDTH), np.uint8)
    made[:, :LEAST] = both[:, BEFORE:] * (np.arange(LEAST) < (LEAST - least)[:, None])
    made[:, LEAST:-2] = both[:, BEFORE - 1 :: -1] * (np.arange(BEFORE) < most[:, None])
    made[:, -2], made[:, -1] = least, most
    return made


def as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before; 0 for the first."""
    found = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        found[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return found


def runs_of_part(left: pa.Table, right: pa.Table, spans: int, sizes: Sizes) -> pa.Table:
    """Front-coded runs of distinct suffixes, one per range, and where in the part each suffix stands."""
    forget()
    if not right.num_rows or not left.num_rows:
        return table_of(RUNS_ARROW, [])
    part = Part(left)
    values = np.concatenate([from_six_bytes(b) for b in right.column("hashes").to_pylist()])
    hot = np.frombuffer(b"".join(right.column("hot").to_pylist()), np.uint8)
    order = np.argsort(values, kind="stable")
    values, hot = values[order], hot[order].astype(bool)
    held: list[tuple[np.ndarray, ...]] = []
    for place, full, least, most, document in part.anchors(sizes.block):
        hashes = short(full)
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        kept = values[at] == hashes
        place, hashes, least, most, document, at = (c[kept] for c in (place, hashes, least, most, document, at))
        often = hot[at]
        if often.any():
            # every window of a hot beginning by itself
            each = (most - least + 1)[often]
            back = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(least[often], each)
            starts, owners = np.repeat(place[often], each) - back, np.repeat(document[often], each)
            none = np.zeros(len(starts), np.int64)
            rows = suffixes(part.text, starts, none, none)
            own = window_hashes(rows)
            held.append((rows, own, starts, owners, none, none))
        some = ~often
        if some.any():
            rows = suffixes(part.text, place[some], least[some], most[some])
            held.append((rows, hashes[some], place[some], document[some], least[some], most[some]))
    if not held:
        return table_of(RUNS_ARROW, [])
    rows, hashes, place, document, least, most = (np.concatenate(c) for c in zip(*held))
    held.clear()
    _, kind, of = np.unique(as_strings(rows), return_index=True, return_inverse=True)
    span = dealt(hashes[kind], spans)
    order = np.argsort(span, kind="stable")  # runs by range, each sorted
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    entry, kind, span = number[of], kind[order], span[order]
    least_key = np.full(len(kind), np.iinfo(np.int64).max)
    np.minimum.at(least_key, entry, part.keys[document])

    name, made, bounds = left.column("part")[0].as_py(), [], np.r_[groups(span), len(span)]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        mine = rows[kind[a:z]]
        common = shared_prefixes(mine)
        rest = mine[np.arange(WIDTH) >= common[:, None]]
        codes = (squeezed(common.astype(np.uint8)), squeezed(rest), squeezed(least_key[a:z]), b"", b"")
        made.append(("run", int(span[a]), name, z - a, a, *codes))
    order = np.argsort(place, kind="stable")
    later = part.keys[document] > least_key[entry]
    columns = (entry.astype("<u4"), np.diff(place[order], prepend=0).astype("<i8"), least.astype(np.uint8), most.astype(np.uint8), later)
    cells = [squeezed(c if i == 1 else c[order]) for i, c in enumerate(columns)]
    made.append(("place", -1, name, len(order), 0, *cells))
    give_back()
    return table_of(RUNS_ARROW, made)


def window_hashes(rows: np.ndarray) -> np.ndarray:
    """48 bits of all bytes of a suffix."""
    made = np.zeros(len(rows), np.uint64)
    for column in range(LEAST):
        made = (made ^ rows[:, column]) * np.uint64(0x100000001B3)
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return short(made ^ (made >> np.uint64(29)))


# merging


def decoded(common: np.ndarray, rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    found, before, at = [], b"", 0
    for shared in common.tolist():
        upto = at + WIDTH - shared
        before = before[:shared] + rest[at:upto]
        found.append(before)
        at = upto
    return found


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """The run of each suffix in sorted order, and how many bytes it shares with the one before.

    ``runs`` are sorted suffixes and the lengths of the prefixes each shares
    with the one before in its run. A loser tree: each inner node holds the run
    that lost there and how much its head shares with the suffix that won, so
    the head that shares more with what came out last is the smaller one, and
    only heads that share equally much are compared, from there on. Runs that
    are at their end share -1 and lose always.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [texts[0] if texts else b"" for texts, _ in runs] + [b""] * (size - len(runs))
    shares = [0 if texts else -1 for texts, _ in runs] + [-1] * (size - len(runs))
    nexts = [1] * size
    losers = [0] * size

    def played(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser, whose share becomes that with the winner."""
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y, at = heads[a], heads[b], shares[a]
        if at < 0:
            return a, b
        if x == y:
            shares[b] = WIDTH
            return a, b
        while x[at] == y[at]:
            at += 1
        if x[at] < y[at]:
            shares[b] = at
            return a, b
        shares[a] = at
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        pairs = [played(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        for i, (_, lost) in enumerate(pairs):
            losers[level + i] = lost
        winners = [won for won, _ in pairs]
    winner = winners[0]

    order, common = [], []
    while shares[winner] >= 0:
        order.append(winner)
        common.append(shares[winner])
        texts, shared = runs[winner]
        at = nexts[winner]
        if at < len(texts):
            heads[winner], shares[winner] = texts[at], shared[at]
            nexts[winner] = at + 1
        else:
            shares[winner] = -1
        node = (size + winner) // 2
        while node:
            other = losers[node]
            mine, its = shares[winner], shares[other]
            if its > mine:
                losers[node], winner = winner, other
            elif its == mine and mine >= 0:
                winner, losers[node] = played(winner, other)
            node //= 2
    return order, common


# shared windows


ANSWERS = "kind string, part int, count int, a binary, b binary, c binary"
ANSWERS_ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("count", pa.int32())] + [(c, pa.binary()) for c in "abc"]
)


def known_earlier(rows: np.ndarray, common: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For sorted suffixes: which of their windows occur under a smaller key. One column per place of a window.

    A window that begins ``t`` bytes before two suffixes is the same in both if
    they share ``LEAST - t`` bytes, and ``t`` bytes before.
    """
    found = np.zeros((len(rows), BEFORE + 1), bool)
    first = np.flatnonzero(common < WIDTH)  # equal suffixes count once
    counts = np.diff(np.r_[first, len(rows)])
    least_key = np.minimum.reduceat(key, first)
    low, high = rows[first, -2], rows[first, -1]
    shared = common[first]
    back = as_strings(rows[first, LEAST:-2])
    order = np.argsort(back, kind="stable")
    back_shared = shared_prefixes(rows[first][order, LEAST:-2])
    for t in range(BEFORE + 1):
        block = np.cumsum(shared < LEAST - t)
        mine = np.flatnonzero((low <= t) & (t <= high))
        several = np.bincount(block[mine])[block[mine]] > 1 if len(mine) else mine
        least = least_key.copy()
        mine = mine[several]
        if len(mine):
            same_back = np.empty(len(first), np.int64)
            same_back[order] = np.cumsum(back_shared < t)
            both = block[mine] * (same_back.max() + 1) + same_back[mine]
            ordered = np.argsort(both, kind="stable")
            starts = groups(both[ordered])
            lowest = np.minimum.reduceat(least_key[mine][ordered], starts)
            least[mine[ordered]] = np.repeat(lowest, np.diff(np.r_[starts, len(mine)]))
        stands = np.repeat((low <= t) & (t <= high), counts)
        found[:, t] = stands & (np.repeat(least, counts) < key)
    return found


def merged_span(table: pa.Table) -> pa.Table:
    """Merges the runs of a range and tells each part which windows of its suffixes are known from before."""
    forget()
    cells = table.sort_by("part").to_pydict()
    runs, keys = [], []
    for count, shared, rest, key in zip(cells["count"], cells["a"], cells["b"], cells["c"]):
        common = spread(shared, count, "u1")
        tails = pa.decompress(rest, int(count * WIDTH - common.sum(dtype=np.int64)), codec="zstd", asbytes=True)
        runs.append((decoded(common, tails), common.tolist()))
        keys.append(spread(key, count, "<i8"))
    order, common = merged(runs)
    run = np.array(order, np.int64)
    by_run = np.argsort(run, kind="stable")  # the k-th of a run is its k-th suffix
    place = np.empty(len(run), np.int64)
    first = np.cumsum([0, *cells["count"]])
    place[by_run] = np.arange(len(run)) - np.repeat(first[:-1], cells["count"])
    raw = [texts for texts, _ in runs]
    rows = np.frombuffer(b"".join(raw[r][k] for r, k in zip(order, place.tolist())), np.uint8).reshape(-1, WIDTH)
    del raw, runs
    key = np.concatenate(keys)[first[run] + place]
    known = known_earlier(rows, np.array(common, np.int64), key)
    edges = np.diff(known, axis=1, prepend=False, append=False)  # where a stretch of places begins and ends
    who, at = np.nonzero(edges)
    who, low, high = who[::2], at[::2], at[1::2] - 1
    of = run[who]
    by_run = np.argsort(of, kind="stable")
    of, low, high, entry = of[by_run], low[by_run], high[by_run], place[who][by_run]
    made, bounds = [], np.r_[groups(of), len(of)]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        r = int(of[a])
        number = (entry[a:z] + cells["first"][r]).astype("<u4")
        codes = (squeezed(number), squeezed(low[a:z].astype(np.uint8)), squeezed(high[a:z].astype(np.uint8)))
        made.append(("known", cells["part"][r], z - a, *codes))
    give_back()
    return table_of(ANSWERS_ARROW, made)


# removing


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
RESULT_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string())])


def removed_spans(part: Part, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, begin, upto`` of the maximal stretches to remove, places counted in the whole part."""
    cells = right.to_pydict()
    kinds = np.array(cells["kind"])
    known = [i for i in range(len(kinds)) if kinds[i] == "known"]
    entry = np.concatenate([spread(cells["a"][i], cells["count"][i], "<u4") for i in known] or [np.zeros(0, "<u4")])
    low = np.concatenate([spread(cells["b"][i], cells["count"][i], "u1") for i in known] or [np.zeros(0, "u1")]).astype(np.int64)
    high = np.concatenate([spread(cells["c"][i], cells["count"][i], "u1") for i in known] or [np.zeros(0, "u1")]).astype(np.int64)
    order = np.argsort(entry, kind="stable")
    entry, low, high = entry[order], low[order], high[order]
    begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(kinds == "place").tolist():
        count = cells["count"][i]
        own = spread(cells["a"][i], count, "<u4")
        place = np.cumsum(spread(cells["b"][i], count, "<i8"))
        least, most = (spread(cells[c][i], count, "u1").astype(np.int64) for c in "cd")
        later = spread(cells["e"][i], count, "?")
        # in the part itself: all windows of the suffix occur in an earlier document
        begins.append((place - most)[later])
        ends.append((place - least)[later] + LEAST)
        place, own = place[~later], own[~later]
        a, z = np.searchsorted(entry, own, "left"), np.searchsorted(entry, own, "right")
        which = np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange((z - a).sum())
        place = np.repeat(place, z - a)
        begins.append(place - high[which])
        ends.append(place - low[which] + LEAST)
    begin, upto = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], upto[order]
    if not len(begin):
        return begin, begin, upto
    document = np.searchsorted(part.ends, begin, "right")
    reached = np.maximum.accumulate(upto)
    new = np.flatnonzero(np.r_[True, (begin[1:] > reached[:-1]) | (document[1:] != document[:-1])])
    return document[new], begin[new], np.maximum.reduceat(upto, new)


def kept_of(left: pa.Table, right: pa.Table) -> pa.Table:
    forget()
    if not left.num_rows:
        return table_of(RESULT_ARROW, [])
    part = Part(left)
    document, begin, upto = removed_spans(part, right)
    bounds = np.searchsorted(document, np.arange(len(part.ids) + 1))
    raw, rows = memoryview(part.raw), []
    for i, (doc_id, start, length) in enumerate(zip(part.ids, part.starts.tolist(), part.lengths.tolist())):
        digest, at, gone = hashlib.sha256(), start, 0
        for b, u in zip(begin[bounds[i] : bounds[i + 1]].tolist(), upto[bounds[i] : bounds[i + 1]].tolist()):
            digest.update(raw[at:b])
            gone += u - b
            at = u
        digest.update(raw[at : start + length])
        rows.append((doc_id, length, gone, int(bounds[i + 1] - bounds[i]), digest.hexdigest()))
    give_back()
    return table_of(RESULT_ARROW, rows)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A byte goes if it is covered by fifty bytes that also begin in a document
    with a smaller id; texts are UTF-8, and judged as they came. A null text is
    empty. Rows with equal ids do not take from each other, and rows without an
    id neither lose anything nor take anything from others. An empty table
    gives no rows. Other columns are not looked at.

    The texts are shuffled once, compressed, into a table bucketed by part.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets, slots, spans = (total // size + 1 for size in (sizes.part, sizes.bucket, sizes.slot, sizes.span))
    packed = numbered(rows, parts).mapInArrow(lambda batches: packs(batches, sizes.pack), PACKS)
    with in_parts(packed, buckets) as (table, _):
        texts = table.groupBy("part")
        hashes = texts.applyInArrow(lambda table: hashes_of(table, slots, sizes), HASHES)
        survivors = hashes.groupBy("slot").applyInArrow(lambda table: survivors_of(table, sizes), SURVIVORS)
        runs = texts.cogroup(survivors.groupBy("part")).applyInArrow(lambda a, b: runs_of_part(a, b, spans, sizes), RUNS)
        path = scratch_path(spark, "runs")
        runs.write.partitionBy("kind").parquet(path)
        stored = spark.read.schema(RUNS).parquet(path)
        sent = stored.where("kind = 'run'").select("span", "part", "count", "first", "a", "b", "c")
        known = sent.groupBy("span").applyInArrow(merged_span, ANSWERS)
        places = stored.where("kind = 'place'").select("kind", "part", "count", "a", "b", "c", "d", "e")
        small = known.withColumns({"d": F.lit(None).cast("binary"), "e": F.lit(None).cast("binary")}).unionByName(places)
        kept = texts.cogroup(small.groupBy("part")).applyInArrow(kept_of, RESULT)
        path = scratch_path(spark, "kept")
        kept.write.parquet(path)
    return spark.read.schema(RESULT).parquet(path)
