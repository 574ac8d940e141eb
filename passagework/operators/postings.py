"""Exact search over inverted lists, for vectors that are mostly zeros and nowhere negative.

The corpus is numbered in the order of its keys and stored by bucket: for a
bucket and four thousand rows one block, of the rows that have a weight there,
the weights, and the largest. A question reads the buckets it has a weight in.
Rows are scored in shards, of all blocks of some sixty thousand rows: the most a
shard, and then a row, can still get follows from the largest weights, and what
cannot reach the last of the results is left out, blocks unopened. A bucket
that nearly all rows have is as many blocks as any other has rows, in as many
tasks as there are shards.

Rows that share no bucket with a question score zero and rank by their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators import search as se
from passagework.operators.ranking import dense_rows
from passagework.session import scratch_path

BLOCK_ROWS = 1 << 12
SHARD_BLOCKS = 16
FIRST_SHARDS = 8  # one shard in so many is scored first, for a bar that the others must reach

BLOCKS = "block int, bucket int, entries int, most float, rows binary, weights binary"
BLOCKS_ARROW = pa.schema(
    [("block", pa.int32()), ("bucket", pa.int32()), ("entries", pa.int32()), ("most", pa.float32())]
    + [("rows", pa.binary()), ("weights", pa.binary())]
)
FOUND = "qid bigint, number bigint, score double, opened bigint"
FOUND_ARROW = pa.schema([("qid", pa.int64()), ("number", pa.int64()), ("score", pa.float64()), ("opened", pa.int64())])
NO_QUERY = -(1 << 63)  # rows that only say how many entries were opened


@dataclass
class PostingsIndex:
    rows: DataFrame  # number and keys; numbers follow the keys
    blocks: DataFrame
    keys: list[str]
    count: int
    entries: int


@dataclass(frozen=True)
class Opened:
    """Entries of inverted lists that were read, of those in the buckets of the questions."""

    entries: int
    possible: int


# building


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``number`` from 0 in the order of ``keys``, by a range sort."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.withColumn("task", F.spark_partition_id()).withColumn("at", at)
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    counts = placed.groupBy("task").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the sort
    offsets = counts.select("task", "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    joined = placed.join(offsets, "task")
    return joined.withColumn("number", F.col("before") + F.col("at") - F.col("first")).drop("task", "at", "before", "first")


def blocks_of(table: pa.Table, dim: int) -> pa.Table:
    """The blocks of up to ``BLOCK_ROWS`` rows, one for each bucket that some of them have."""
    table = table.sort_by("number")
    number = np.asarray(table["number"])
    vectors = dense_rows(table["vector"].combine_chunks(), dim)
    if not (vectors >= 0).all():
        raise ValueError("inverted lists are for vectors without negative numbers")
    bucket, row = np.nonzero(vectors.T)
    weights = vectors.T[bucket, row]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    local = (number[row] % BLOCK_ROWS).astype("<u2")
    made, block = [], int(number[0] // BLOCK_ROWS) if len(number) else 0
    for a, z in zip(first, [*first[1:], len(bucket)]):
        made.append((block, int(bucket[a]), int(z - a), float(weights[a:z].max()), local[a:z].tobytes(), weights[a:z].astype("<f4").tobytes()))
    columns = zip(*made) if made else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BLOCKS_ARROW)], schema=BLOCKS_ARROW)


def build(corpus: DataFrame, root: str, keys: list[str], vector_col: str = "embedding", dim: int = DEFAULT_DIM) -> PostingsIndex:
    """Store the inverted lists of ``corpus`` under ``root``. A null vector has no entry; a negative number is an error."""
    spark = corpus.sparkSession
    path = scratch_path(spark, "rows")
    numbered(corpus.select(*keys, F.col(vector_col).cast("array<float>").alias("vector")), keys).write.parquet(path)
    stored = spark.read.parquet(path)
    stored.select("number", *keys).write.parquet(f"{root}/rows")
    grouped = stored.select("number", "vector", F.floor(F.col("number") / BLOCK_ROWS).alias("block")).groupBy("block")
    made = grouped.applyInArrow(lambda table: blocks_of(table, dim), BLOCKS)
    made.repartitionByRange("bucket", "block").sortWithinPartitions("bucket", "block").write.parquet(f"{root}/blocks")
    return load(spark, root, keys)


def load(spark: SparkSession, root: str, keys: list[str]) -> PostingsIndex:
    rows, blocks = spark.read.parquet(f"{root}/rows"), spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    return PostingsIndex(rows, blocks, keys, rows.count(), blocks.agg(F.sum("entries")).first()[0] or 0)


# scoring


class Shard:
    """The blocks of one shard, opened when they are needed."""

    def __init__(self, table: pa.Table):
        cells = table.select(["block", "bucket", "entries", "most", "rows", "weights"]).to_pydict()
        self.first = min(cells["block"])
        self.size = (max(cells["block"]) - self.first + 1) * BLOCK_ROWS
        self.cells, self.by_bucket = cells, {}
        for i, bucket in enumerate(cells["bucket"]):
            self.by_bucket.setdefault(bucket, []).append(i)
        self.most = {b: max(cells["most"][i] for i in held) for b, held in self.by_bucket.items()}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def entries(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            at = (self.cells["block"][i] - self.first) * BLOCK_ROWS
            rows = np.frombuffer(self.cells["rows"][i], "<u2").astype(np.int64) + at
            self.open[i] = rows, np.frombuffer(self.cells["weights"][i], "<f4").astype(np.float64)
            self.opened += len(rows)
        return self.open[i]

    def best(self, buckets: np.ndarray, weights: np.ndarray, count: int, bar: float, rounding: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the best ``count`` with ``bar`` to reach, and their scores."""
        known = [(w * self.most[b] * (1 + 1e-12), b, w) for b, w in zip(buckets.tolist(), weights.tolist()) if b in self.most]
        known.sort(reverse=True)
        rest = np.r_[np.cumsum([u for u, _, _ in known][::-1])[::-1], 0.0] if known else np.zeros(1)
        none = np.zeros(0, np.int64), np.zeros(0)
        if not known or rest[0] + rounding < bar:
            return none
        scores, rows = np.zeros(self.size), None
        for place, (_, bucket, weight) in enumerate(known):
            if rows is None and place:
                # scores only grow, so the last of the best so far is a bar as well
                if self.size > count and rest[place] < scores.max():
                    bar = max(bar, float(np.partition(scores, -count)[-count]) - rounding)
                if rest[place] + rounding < bar:  # a row without a score cannot reach it any more
                    rows = np.flatnonzero(scores + rest[place] + rounding >= bar)
            for i in self.by_bucket[bucket]:
                if rows is not None:
                    at = (self.cells["block"][i] - self.first) * BLOCK_ROWS
                    a, z = np.searchsorted(rows, [at, at + BLOCK_ROWS])
                    if a == z:
                        continue  # no row of the block matters
                own, w = self.entries(i)
                scores[own] += weight * w
            if rows is not None:
                rows = rows[scores[rows] + rest[place + 1] + rounding >= bar]
                if not len(rows):
                    return none
        rows = np.flatnonzero(scores > 0) if rows is None else rows[scores[rows] > 0]
        if len(rows) > count:
            bar = max(bar, float(np.partition(scores[rows], -count)[-count]) - rounding)
            rows = rows[scores[rows] >= bar]
        return rows, scores[rows]


def _shard_hits(table: pa.Table, asked: dict) -> pa.Table:
    shard, rounding, digits = Shard(table), asked["rounding"], asked["digits"]
    columns: list[list[np.ndarray]] = [[], [], []]
    for slot, (buckets, weights) in enumerate(asked["terms"]):
        count = int(asked["limits"][slot])
        rows, scores = shard.best(buckets, weights, count, float(asked["bar"][slot]), rounding)
        if digits is not None:
            scores = np.round(scores, digits) + 0.0
        order = np.lexsort((rows, -scores))[:count]
        columns[0].append(np.full(len(order), slot))
        columns[1].append(rows[order] + shard.first * BLOCK_ROWS)
        columns[2].append(scores[order])
    slots, numbers, scores = (np.concatenate([*c, np.zeros(0, t)]) for c, t in zip(columns, (np.int64, np.int64, np.float64)))
    cells = [np.r_[slots, NO_QUERY], np.r_[numbers, 0], np.r_[scores, 0.0], np.r_[np.zeros(len(slots), np.int64), shard.opened]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, FOUND_ARROW)], schema=FOUND_ARROW)


def _scorer(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _shard_hits(table, shared.value)


def _rounds(index: PostingsIndex, asked: dict) -> Iterator[pa.Table]:
    """The hits of some shards first, then of the others with the bar these have set."""
    spark = index.blocks.sparkSession
    buckets = sorted({int(b) for own, _ in asked["terms"] for b in own})
    shard = F.floor(F.col("block") / SHARD_BLOCKS)
    part = F.pmod(F.xxhash64(shard), F.lit(FIRST_SHARDS)) == 0
    read = index.blocks.where(F.col("bucket").isin(buckets))
    for some in (part, ~part):
        shared = spark.sparkContext.broadcast(asked)
        found = read.where(some).groupBy(shard.alias("shard")).applyInArrow(_scorer(shared), FOUND)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "number")
        ranked = found.withColumn("rank", F.row_number().over(order))
        most = int(asked["limits"].max())
        table = ranked.where((F.col("rank") <= most) | (F.col("qid") == NO_QUERY)).drop("rank").toArrow()
        shared.destroy()
        yield table


def search_postings(
    index: PostingsIndex,
    queries: DataFrame,
    dim: int = DEFAULT_DIM,
    n_results: int = se.DEFAULT_RESULTS,
    digits: int | None = None,
    max_query_bytes: int = se.MAX_QUERY_BYTES,
) -> tuple[DataFrame, Opened]:
    """The same rows as ``search.search`` over the corpus of the index, and how much of it was opened.

    ``queries`` has ``qid``, ``query_vector`` without negative numbers, and optionally ``n_results``.
    """
    spark, keys = index.rows.sparkSession, index.keys
    if "document_name" in queries.columns:
        raise ValueError("an index is of one corpus: ask without document_name")
    wanted = se.with_request_defaults(queries, n_results).select(
        F.col("qid").cast("bigint"), F.col("query_vector").cast("array<float>"), "n_results"
    )
    schema = "qid bigint, rank int, number bigint, score double"
    hits, opened, possible = se.Hits(spark, schema), 0, 0
    for block in se.query_blocks(wanted.where(F.col("n_results") > 0), dim, max_query_bytes):
        if not (block.slot_vectors >= 0).all():
            raise ValueError("inverted lists are for questions without negative numbers")
        terms = [(np.flatnonzero(v), v[np.flatnonzero(v)].astype(np.float64)) for v in block.slot_vectors]
        slots = len(terms)
        asked = {
            "terms": terms, "limits": block.slot_limits, "bar": np.zeros(slots), "digits": digits,
            "rounding": 1e-9 if digits is None else 10.0**-digits,
        }
        best: list[list[tuple[float, int]]] = [[] for _ in range(slots)]
        for table in _rounds(index, asked):
            opened += int(np.asarray(table["opened"]).sum())
            for slot, number, score in zip(*(table[c].to_pylist() for c in ("qid", "number", "score"))):
                if slot != NO_QUERY:
                    best[slot].append((-score, number))
            for slot, limit in enumerate(block.slot_limits.tolist()):
                best[slot] = sorted(best[slot])[:limit]
                if len(best[slot]) == limit:
                    asked["bar"][slot] = -best[slot][-1][0] - asked["rounding"]
        buckets = {int(b) for own, _ in terms for b in own}
        possible += index.blocks.where(F.col("bucket").isin(sorted(buckets))).agg(F.sum("entries")).first()[0] or 0
        rows = []
        for qid, slot, limit in zip(block.ids.tolist(), block.slots.tolist(), block.limits.tolist()):
            own = [(number, -score) for score, number in best[slot][:limit] if score < 0]
            if len(own) < limit:  # the first rows that share nothing with the question
                taken = {number for number, _ in own}
                free = (n for n in range(min(index.count, limit + len(own))) if n not in taken)
                own += [(n, 0.0) for n, _ in zip(free, range(limit - len(own)))]
            rows += [(qid, rank, number, score) for rank, (number, score) in enumerate(own, 1)]
        hits.add(spark.createDataFrame(rows, schema))
    found = hits.read().join(index.rows, "number").select("qid", "rank", *keys, "score")
    return found, Opened(opened, possible)
