"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a value in common that is at most
half of r away from either. So every fingerprint gives all variants within
half the radius, and equal variants are collisions. Variants are shuffled by
their first 16 bits: the variants of one fingerprint share 137 such prefixes
at radius 4, so 137 rows travel instead of 2,081, and the task of a prefix
makes its variants itself. A prefix with very many fingerprints is split by
the next bits of its variants, over tasks and then inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import computed, forget, fresh, quoted
from passagework.llm.components import components
from passagework.session import scratch_path

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
PREFIX_BITS = 16
SPLIT_BITS = 12
SPLIT_ROWS = 1 << 18
MADE_ROWS = 1 << 22  # rows a task makes, and rows a task reads, about
READ_ROWS = 1 << 19
TASK_VARIANTS = 1 << 20
BLOCK_WORDS = 1 << 16


# fingerprints


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64 bits of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    size = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    total, digest = len(words) - size + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK_WORDS):
        upto = min(at + BLOCK_WORDS, total)
        spans = zip(starts[at:upto], ends[at + size - 1 : upto + size - 1])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, upto - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint as a signed long. A null text is an empty one."""

    def setup():
        forget()

        def work(batch: pa.Array) -> list[pa.Array]:
            raw = batch.cast(pa.large_binary()).to_pylist()
            made = np.array([fingerprint(t or b"", shingle_words) for t in raw], np.uint64)
            return [pa.array(made.view(np.int64), pa.int64())]

        return work

    (holder,) = fresh(docs, "made")
    made = docs.withColumn(holder, computed("value: bigint", setup)(F.col(text_col)))
    return made.withColumn(name, F.col(f"{holder}.value")).drop(holder)


# links


@lru_cache
def masks(width: int, flips: int, shift: int = 0) -> np.ndarray:
    """All values of ``width`` bits with at most ``flips`` ones, moved up by ``shift``."""
    found = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]
    return np.array(found, np.uint64) << np.uint64(shift)


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def _deeper(region: np.ndarray, fps: np.ndarray, fixed: int, width: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Split variant regions, given by their first ``fixed`` bits, by the next ``width`` bits."""
    low = 64 - fixed - width
    keep = np.uint64((1 << fixed) - 1) << np.uint64(64 - fixed)
    left = half - _ones((region ^ fps) & keep)
    field = np.uint64((1 << width) - 1) << np.uint64(low)
    regions, owners = [], []
    for budget in range(half + 1):
        mine = fps[left == budget]
        flips = masks(width, budget, low)
        regions.append(((region[left == budget] & keep)[:, None] | ((mine & field)[:, None] ^ flips)).ravel())
        owners.append(np.repeat(mine, len(flips)))
    return np.concatenate(regions), np.concatenate(owners)


def _variants(region: np.ndarray, fps: np.ndarray, fixed: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants inside the regions, and whose they are."""
    return _deeper(region, fps, fixed, 64 - fixed, half)


class _Forest:
    """Union-find over the fingerprints of one run of regions."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def _collide(forest: _Forest, region: np.ndarray, fps: np.ndarray, fixed: int, max_bits: int) -> None:
    """Link the fingerprints that share a variant in these regions, and are near enough."""
    half = max_bits - max_bits // 2
    variants, owners = _variants(region, fps, fixed, half)
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    place = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[place] == variants
    place, owners, variants = place[hit], owners[hit], variants[hit]
    # the centre of a star is within the lesser half, so all members are near enough to it
    away = _ones(variants ^ owners)
    order = np.lexsort((owners, away, place))
    place, owners, away = place[order], owners[order], away[order]
    first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
    centre = np.repeat(first, np.diff(np.r_[first, len(place)]))
    near = (_ones(owners ^ owners[centre]) <= max_bits) & (away[centre] <= max_bits // 2) & (owners != owners[centre])
    pairs = np.unique(np.stack([owners[near], owners[centre][near]], axis=1), axis=0)
    for a, b in pairs.tolist():
        forest.join(a, b)


def _size(region: np.ndarray, fps: np.ndarray, fixed: int, half: int) -> np.ndarray:
    """How many variants each row has inside its region."""
    rest = 64 - fixed
    keep = np.uint64((1 << fixed) - 1) << np.uint64(rest)
    each = np.array([len(masks(rest, b)) for b in range(half + 1)])
    return each[half - _ones((region ^ fps) & keep)]


def _link_runs(forest: _Forest, region: np.ndarray, fps: np.ndarray, fixed: int, max_bits: int) -> None:
    """Whole regions at a time, at most ``TASK_VARIANTS`` variants or one region; a larger one is split first."""
    half = max_bits - max_bits // 2
    sizes = _size(region, fps, fixed, half)
    starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
    totals = np.add.reduceat(sizes, starts)
    bounds = np.r_[starts, len(region)]
    at = 0
    while at < len(starts):
        upto, held = at + 1, totals[at]
        while upto < len(starts) and held + totals[upto] <= TASK_VARIANTS:
            held += totals[upto]
            upto += 1
        part = slice(bounds[at], bounds[upto])
        if held > TASK_VARIANTS and fixed < 64 - SPLIT_BITS and part.stop - part.start > 1:
            split, owners = _deeper(region[part], fps[part], fixed, SPLIT_BITS, half)
            order = np.argsort(split, kind="stable")
            _link_runs(forest, split[order], owners[order], fixed + SPLIT_BITS, max_bits)
        elif part.stop - part.start > 1:
            _collide(forest, region[part], fps[part], fixed, max_bits)
        at = upto


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges ``u, v`` that connect what is at most ``max_bits`` apart, from distinct ``fp`` rows.

    Fingerprints with a common variant are near each other, so each variant
    gives a star, and each run of regions a forest: fewer edges than
    fingerprints there, and every connection is kept.
    """
    half = max_bits - max_bits // 2
    prefix = F.shiftrightunsigned("fp", 64 - PREFIX_BITS).cast("int")
    flips = [int(m) for m in masks(PREFIX_BITS, half)]
    # rows of a region: the fingerprints whose prefix is near; a table of 65,536 numbers at most
    counts = np.zeros(1 << PREFIX_BITS, np.int64)
    found = fingerprints.groupBy(prefix.alias("prefix")).count().toArrow()
    counts[np.asarray(found["prefix"])] = np.asarray(found["count"])
    every = np.arange(len(counts))
    rows = sum(counts[every ^ m] for m in flips)
    large = [(int(k),) for k in np.flatnonzero(rows > split_rows)]

    spark = fingerprints.sparkSession
    total = int(counts.sum()) * len(flips)  # the rows that travel
    dealt = fingerprints.repartition(-(-total // MADE_ROWS) or 1, "fp")
    keyed = dealt.select("fp", F.explode(F.array(*[F.lit(m) for m in flips])).alias("flip"))
    keyed = keyed.select("fp", prefix.bitwiseXOR(F.col("flip")).alias("prefix"))
    first = F.shiftleft(F.col("prefix").cast("bigint"), 64 - PREFIX_BITS)
    small = keyed.select("fp", first.alias("region"), F.lit(PREFIX_BITS).alias("fixed"))
    if large:
        hot = F.broadcast(spark.createDataFrame(large, "prefix int"))
        small = keyed.join(hot, "prefix", "left_anti").select("fp", first.alias("region"), F.lit(PREFIX_BITS).alias("fixed"))
        low = 64 - PREFIX_BITS - SPLIT_BITS
        nexts = F.array(*[F.lit(int(m)) for m in masks(SPLIT_BITS, half, low)])
        field = ((1 << SPLIT_BITS) - 1) << low
        split = keyed.join(hot, "prefix").select("fp", first.alias("first"), F.explode(nexts).alias("flip"))
        region = F.col("first").bitwiseOR(F.col("fp").bitwiseAND(F.lit(field)).bitwiseXOR(F.col("flip")))
        spent = F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(region), low))
        split = split.where(spent <= half).select("fp", region.alias("region"), F.lit(PREFIX_BITS + SPLIT_BITS).alias("fixed"))
        small = small.unionByName(split)
    placed = small.repartition(-(-total // READ_ROWS) or 1, "region").sortWithinPartitions("fixed", "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        forest = _Forest()

        def work(held: list[np.ndarray]) -> None:
            region, fps, fixed = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.uint64)
            for depth in np.unique(fixed).tolist():
                mine = fixed == depth
                _link_runs(forest, region[mine], fps[mine], int(depth), max_bits)

        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            fp, region = (np.asarray(batch.column(c), np.int64).view(np.uint64) for c in ("fp", "region"))
            held.append(np.stack([region, fp, np.asarray(batch.column("fixed"), np.int64).astype(np.uint64)]))
            waiting += len(fp)
            if waiting >= split_rows:  # the last region may go on in the next batch
                whole = np.concatenate(held, axis=1)
                last = (whole[0] == whole[0, -1]) & (whole[2] == whole[2, -1])
                work([whole[:, ~last]])
                held, waiting = [whole[:, last]], int(last.sum()) if not last.all() else 0
        work(held)
        found = np.array(forest.edges(), np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return placed.mapInArrow(run, "u bigint, v bigint")


# classes


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row of ``docs``.

    ``root`` names the class, ``component_id`` is its least id. A null text is
    empty; texts without words have fingerprint 0 and are linked like others. A
    null id takes part, but is never the least; a class of null ids only has a
    null component. Repeated rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    with_fingerprint(rows, "fp", shingle_words=shingle_words).drop("text").write.parquet(path)
    stored = spark.read.parquet(path)
    distinct = stored.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    classed = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored.join(classed.select("fp", "root").join(least, "root"), "fp")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of the least id of every class, with all its columns.

    Of several such rows, as when rows are repeated or ids are null, one stays.
    """
    classes = near_duplicates(docs, id_col, text_col, **options)
    path = scratch_path(docs.sparkSession, "classes")
    spark = docs.sparkSession
    rows = classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")
    best = rows.groupBy("root").agg(F.min(first).alias("best"))
    best.select("best.doc_id", "best.text_hash", "best.n").write.parquet(path)
    winners = spark.read.schema("doc_id bigint, text_hash bigint, n bigint").parquet(path)
    hash_col, own_id, own_hash, n = fresh(docs, "text_hash", "winner_id", "winner_hash", "winner_rows")
    hashed = docs.withColumn(hash_col, F.xxhash64(F.col(text_col)))
    winners = winners.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("n").alias(n))
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(hash_col) == F.col(own_hash))
    kept = hashed.join(winners.where(F.col(n) == 1), on).select(*quoted(*docs.columns))
    repeated = winners.where(F.col(n) > 1)
    if not repeated.isEmpty():
        one = hashed.join(repeated, on).dropDuplicates([own_id, own_hash])
        kept = kept.unionByName(one.select(*quoted(*docs.columns)))
    return kept
