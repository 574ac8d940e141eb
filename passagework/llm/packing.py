"""Packing documents into fixed windows by non-negative least squares.

Texts become ids once, in the tasks that read them. What moves afterwards is
one small row per piece. A document gives whole windows and one rest; the
histogram of lengths, at most 2,048 numbers however many documents there are,
is all the driver sees. It enumerates combinations of up to three lengths that
fill a window, solves how often to repeat each, and rounds down. The pieces
left over are laid end to end and cut at window ends.

Which piece goes where follows from its rank among pieces of its length, and
that from counts per task: no sort and no group of all pieces of one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import per_worker, runs_of
from passagework.llm.tokens import WordIds
from passagework.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
UNIT = 8  # pieces may be cut at multiples of this many ids, where a running checksum is kept
SHORTEST = 128  # shorter pieces fill the rest, where rounding up costs nothing
DEPTH = 3
RUN_BYTES = 1 << 22  # of text that is encoded at once

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# checksums of parts: removing the front of a sequence needs no ids


def _zero_bytes(values: np.ndarray, count: int) -> np.ndarray:
    """CRC registers after ``count`` zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    for _ in range(count):
        values = table[values & np.uint32(0xFF)] ^ (values >> np.uint32(8))
    return values


class Checksums:
    """CRC-32 of the rest of a sequence, from those of the whole and of its front."""

    def __init__(self, most_ids: int):
        images = [np.uint32(1) << np.arange(32, dtype=np.uint32)]
        for _ in range(most_ids):
            images.append(_zero_bytes(images[-1], 4))
        self.images = images

    def rest(self, whole: int, front: int, rest_ids: int) -> int:
        bits = self.images[rest_ids][[i for i in range(32) if front >> i & 1]]
        return whole ^ int(np.bitwise_xor.reduce(bits, initial=0))


# pieces


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per whole window and per rest, with its rank among equally long ones of its task."""
    end = np.array([end_id], "<u4").tobytes()

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
        """Rows whose texts are about ``RUN_BYTES`` together, so that a batch of long texts is not encoded at once."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
        for rows in runs_of(list(range(len(sizes))), lambda i: int(sizes[i]), RUN_BYTES):
            part = batch.slice(rows[0], len(rows))
            yield part.column(0).to_pylist(), part.column(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("word ids", path), lambda: WordIds(path))
        task = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for named, batch in chain.from_iterable(map(runs, batches)):
            rows: list[tuple] = []
            found, bounds = words.of_batch(batch)
            raw = memoryview(found).cast("B")
            for doc, a, z in zip(named, bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = bytes(raw[4 * a : 4 * z]) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    running, crc = [], 0
                    for at in range(0, len(part) if length < window else 0, 4 * UNIT):
                        running.append(crc)
                        crc = zlib.crc32(part[at : at + 4 * UNIT], crc)
                    crc = crc if length < window else zlib.crc32(part)
                    rows.append((doc, start, length, crc, total, np.array(running, "<u4").tobytes(), task, seen[length]))
                    seen[length] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{PIECE}, running binary, task int, rank bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [*[pa.int64()] * 5, pa.binary(), pa.int32(), pa.int64()]
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


# the plan


def fillings(bins: list[int], total: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to reach ``total`` with at most ``depth`` of the given sizes, largest first."""
    have, found = set(bins), []

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if left in have and left <= (chosen[-1] if chosen else left):
            found.append((*chosen, left))
        if len(chosen) + 1 < depth:
            for size in bins:
                if size < left and size <= (chosen[-1] if chosen else size):
                    grow((*chosen, size), left - size)

    grow((), total)
    return found


def non_negative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The active-set method: the least ``|matrix x - target|`` with no negative ``x``.

    Stops after three rounds per row of the matrix at the latest; every ``x``
    on the way is a valid one.
    """
    rows, columns = matrix.shape
    x, active = np.zeros(columns), np.zeros(columns, bool)
    slack = 1e-9 * max(1.0, float(target.max(initial=0)))
    for _ in range(3 * rows):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        best = int(gain.argmax()) if columns else 0
        if not columns or gain[best] <= slack:
            break
        active[best] = True
        while True:
            used = np.flatnonzero(active)
            fit = np.linalg.lstsq(matrix[:, used], target, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[used] = fit
                break
            below = fit <= 0
            old = x[used]
            step = min(1.0, float((old[below] / np.maximum(old[below] - fit[below], 1e-300)).min()))
            x[used] = old + step * (fit - old)
            dropped = used[(x[used] <= slack) & below]
            dropped = dropped if len(dropped) else used[below]
            active[dropped] = False
            x[dropped] = 0
            if not active.any():
                break
    return x


@dataclass
class Plan:
    """Where the k-th piece of each length goes; a few thousand numbers at most."""

    window: int
    first_rank: np.ndarray  # by length: pieces of its bin that are shorter
    used: np.ndarray  # by bin: pieces placed by the combinations
    slots: list[np.ndarray]  # by bin: rows of (first rank, first sequence, place in it)
    sequences: int
    rest_first: np.ndarray  # by length: the first rank in the bin that is left over
    rest_start: np.ndarray  # by length: where its leftovers begin, laid end to end


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, shortest: int = SHORTEST) -> Plan:
    counts = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        counts[length] = count
    bin_of = -(-np.arange(window + 1) // unit)
    in_bin = np.bincount(bin_of, counts, minlength=window // unit + 1).astype(np.int64)
    before = np.cumsum(counts) - counts
    first_rank = before - before[np.maximum((bin_of - 1) * unit + 1, 0)]

    bins = [int(b) for b in np.flatnonzero(in_bin) if b * unit >= shortest]
    ways = fillings(bins, window // unit)
    row = {b: i for i, b in enumerate(bins)}
    matrix = np.zeros((len(bins), len(ways)))
    for column, way in enumerate(ways):
        for b in way:
            matrix[row[b], column] += 1
    wanted = non_negative_least_squares(matrix, in_bin[bins].astype(float)) if ways else np.zeros(0)
    used = np.zeros_like(in_bin)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in in_bin]
    sequences = 0
    for column in np.argsort(-wanted, kind="stable"):
        way = ways[column]
        times = min(round(wanted[column]), *(int((in_bin[b] - used[b]) // way.count(b)) for b in way))
        if times <= 0:
            continue
        for place, b in enumerate(way):
            slots[b].append((int(used[b]), sequences, place))
            used[b] += times
        sequences += times

    rest_first = np.maximum(first_rank, used[bin_of])
    left = np.clip(first_rank + counts - rest_first, 0, None)
    tokens = left * np.arange(window + 1)
    return Plan(
        window,
        first_rank,
        used,
        [np.array(s, np.int64).reshape(-1, 3) for s in slots],
        sequences,
        rest_first,
        np.cumsum(tokens) - tokens,
    )


def cut(length: int, start: int, stride: int, unit: int = UNIT) -> list[tuple[int, int, int]]:
    """``from, to, sequence`` of a piece laid at ``start``, cut near every multiple of ``stride``.

    A cut is moved forward in the piece to a multiple of ``unit``, so a sequence
    holds less than ``unit`` more than its stride.
    """
    number, at, found = start // stride, 0, []
    while at < length:
        upto = ((number + 1) * stride - start) // unit * unit
        upto = length if (number + 1) * stride >= start + length else upto
        if upto > at:
            found.append((at, upto, number))
            at = upto
        number += 1
    return found


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Every id of every document, with the closing id, is in exactly one piece;
    pieces of a sequence follow each other from offset 0 and fill at most
    ``window`` ids. A null text is an empty one and has the closing id only.
    Rows with the same or no ``doc_id`` are documents of their own. An empty
    table has no pieces. ``window`` is a multiple of 8 from 128 on.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    where = scratch_path(spark, "pieces")
    pieces(docs, id_col, text_col, path, window=window).write.parquet(where)
    stored = spark.read.schema(f"{PIECE}, running binary, task int, rank bigint").parquet(where)
    counts = stored.groupBy("length", "task").agg((F.max("rank") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = stored.join(offsets, ["length", "task"])
    shared = spark.sparkContext.broadcast(vars(plan(histogram, window)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = Plan(**shared.value)
        sums = per_worker(("checksums", window), lambda: Checksums(window))
        stride = window - UNIT + 1
        for batch in batches:
            rows: list[tuple] = []
            cells = [batch.column(c).to_pylist() for c in (*names, "running", "rank", "earlier")]
            for doc, start, length, crc, total, running, rank, before in zip(*cells):
                b = -(-length // UNIT)
                place = int(todo.first_rank[length]) + before + rank
                if place < todo.used[b]:
                    slots = todo.slots[b]
                    first, sequence, order = slots[np.searchsorted(slots[:, 0], place, "right") - 1].tolist()
                    rows.append((doc, start, length, crc, total, sequence + place - first, order))
                    continue
                laid = int(todo.rest_start[length]) + (place - int(todo.rest_first[length])) * length
                fronts = np.frombuffer(running, "<u4")
                for a, z, number in cut(length, laid, stride):
                    own = crc if z == length else int(fronts[z // UNIT])
                    if a:
                        own = sums.rest(own, int(fronts[a // UNIT]), z - a)
                    rows.append((doc, start + a, z - a, own, total, todo.sequences + number, laid + a))
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*names, "sequence_id", "place"])

    kinds = ", ".join(f"{n} bigint" for n in (*names, "sequence_id", "place"))
    inputs = ranked.select(*names, "running", "rank", "earlier")
    placed = inputs.mapInArrow(run, kinds)
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.withColumn("offset", offset).drop("place")
