"""Exact dot-product search: score, top-k per query, payload lookup.

A block of queries is a matrix that every task holds; the corpus is scanned
once for each block and never shuffled. Each task multiplies its rows with the
matrix and keeps only the best k rows per query, so what is shuffled is k rows
per query and task, not one row per query and chunk. No pair of query and
chunk ever becomes a row.

A search runs when it is called: the batch of queries is stored by blocks,
scored block by block, and the hits are stored. Blocks have a bounded size and
one of them is in memory at a time, whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators.ranking import TILE_SCORES, BestRows, dense_rows, distinct, ranges, row_bytes
from passagework.session import scratch_path

# Fixed value: results per query when a request does not say.
DEFAULT_RESULTS = 5

# Memory only, no effect on results: bytes of a block of queries with room for
# their results, and rows that are scored together, more for few queries.
MAX_QUERY_BYTES = 64 << 20
RESULT_BYTES = 128
TILE_ROWS = 1 << 12

# Speed only: of so many queries each row is scored for long, so the files of a
# corpus are read in more tasks than Spark would make of them.
MANY_QUERIES = 1 << 12
SHARES = 4

# Speed only: one row in so many is scored first for as many queries, so that
# each task knows from its first row on which scores are of no use.
EARLY_ROWS = 32

# files that a lookup of winners is narrowed to in the plan; with more, the join alone finds them
LISTED_FILES = 1024


@dataclass
class QueryBlock:
    """Queries of one pass, about ``MAX_QUERY_BYTES`` with their results.

    Queries that are the same for the corpus share a slot and are scored once.
    """

    ids: np.ndarray
    limits: np.ndarray
    slots: np.ndarray
    slot_vectors: np.ndarray
    slot_limits: np.ndarray
    slot_names: list[str | None] | None

    @staticmethod
    def of(queries: pa.Table, dim: int) -> QueryBlock:
        vectors = dense_rows(queries["query_vector"].combine_chunks(), dim)
        limits = np.asarray(queries["n_results"], dtype=np.int64)
        routed = "document_name" in queries.column_names
        names = queries["document_name"].to_pylist() if routed else [None] * len(limits)
        firsts, slots = distinct(names, row_bytes(vectors))
        slot_limits = np.zeros(len(firsts), dtype=np.int64)
        np.maximum.at(slot_limits, slots, limits)
        return QueryBlock(
            ids=np.asarray(queries["qid"], dtype=np.int64),
            limits=limits,
            slots=slots,
            slot_vectors=vectors[firsts],
            slot_limits=slot_limits,
            slot_names=[names[i] for i in firsts] if routed else None,
        )

    def by_name(self) -> dict[str | None, list[int]] | None:
        """The slots of every corpus name; None if all see all rows."""
        if self.slot_names is None:
            return None
        slots: dict[str | None, list[int]] = {}
        for slot, name in enumerate(self.slot_names):
            slots.setdefault(name, []).append(slot)
        return slots


def partial_top_k(
    scan: DataFrame,
    shared: Broadcast,
    keys: list[str],
    vector_col: str,
    digits: int | None = None,
    by: str | None = None,
) -> DataFrame:
    """The best rows of every task for every query.

    ``shared`` holds the arrays of a block, for each value of the column ``by``
    the slots that its rows are scored for (all rows for all slots without
    one), and for each slot a score that is of no use any more, if there is one.
    """
    fields = {f.name: f.dataType.simpleString() for f in scan.schema.fields}
    schema = ", ".join(["qid bigint, n_results int", *(f"`{k}` {fields[k]}" for k in keys), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, wanted, floor = shared.value
        queries = QueryBlock(**arrays)
        count, dim = queries.slot_vectors.shape
        if not count:
            return
        best = BestRows(queries.slot_vectors, queries.slot_limits, keys, digits, floor, TILE_SCORES)
        step = max(TILE_ROWS, TILE_SCORES // count)
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for start in range(0, len(whole), step):
                tile = whole.slice(start, step)
                vectors = dense_rows(tile[vector_col].combine_chunks(), dim)
                rows = tile.select(keys)
                if by is None:
                    best.add(vectors, rows, np.arange(count))
                    continue
                for name in pc.unique(tile[by]).to_pylist():
                    if name is not None and name in wanted:
                        mine = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(tile[by], name), False)))
                        best.add(vectors[mine], rows.take(pa.array(mine)), np.asarray(wanted[name]))
        best.settle()
        if best.table is None:
            return
        # hand every query the rows of its slot
        slot = np.asarray(best.table["query"])
        first = np.searchsorted(slot, np.arange(count), side="left")
        found = np.searchsorted(slot, np.arange(count), side="right") - first
        mine = np.minimum(found[queries.slots], queries.limits)
        table = best.table.take(pa.array(ranges(first[queries.slots], mine)))
        made = [pa.array(np.repeat(queries.ids, mine)), pa.array(np.repeat(queries.limits, mine).astype(np.int32))]
        made += [table[name].combine_chunks() for name in (*keys, "score")]
        yield pa.RecordBatch.from_arrays(made, names=["qid", "n_results", *keys, "score"])

    read = dict.fromkeys([*keys, *([by] if by else []), vector_col])
    return scan.select(*read).mapInArrow(run, schema)


def query_blocks(queries: DataFrame, dim: int, max_bytes: int) -> Iterator[QueryBlock]:
    """The queries in blocks of about ``max_bytes``, by a hash of ``qid``. Each is a folder, read when its turn comes."""
    spark = queries.sparkSession
    path = scratch_path(spark, "queries")
    rows, results = queries.agg(F.count("*"), F.sum("n_results")).first()
    blocks = -(-(rows * 4 * dim + (results or 0) * RESULT_BYTES) // max_bytes)
    if not blocks:
        return
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    queries.withColumn("block", block).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    stored = spark.read.schema(StructType([*queries.schema.fields, StructField("block", IntegerType())])).parquet(path)
    for number in range(blocks):
        part = stored.where(F.col("block") == number).drop("block").toArrow()
        ids = part["qid"]
        if ids.null_count or len(pc.unique(ids)) != len(ids):
            raise ValueError("qid must be given and unique")
        if len(part):
            yield QueryBlock.of(part, dim)


def last_scores(found: DataFrame, block: QueryBlock) -> np.ndarray:
    """For every slot the score of the last of its results in ``found``; it has none if there are fewer."""
    last = found.groupBy("qid").agg(F.count("*").alias("results"), F.min("score").alias("score")).toArrow()
    order = np.argsort(block.ids)
    slot = block.slots[order[np.searchsorted(block.ids, np.asarray(last["qid"], np.int64), sorter=order)]]
    full = np.asarray(last["results"], np.int64) == block.slot_limits[slot]
    floor = np.full(len(block.slot_limits), -np.inf)
    floor[slot[full]] = np.asarray(last["score"], np.float64)[full]
    return floor


def in_shares(table: DataFrame, count: int) -> DataFrame:
    """The same rows in up to ``count`` times the tasks.

    Spark packs files into about as many tasks as there are cores, the largest
    files together. Here each share of the files, by a hash of their paths, is
    packed by itself. The path is a constant metadata column, so a share opens
    its own files only.
    """
    share = F.pmod(F.xxhash64("file_path"), F.lit(count))
    return reduce(DataFrame.unionAll, [table.where(share == number) for number in range(count)])


def with_request_defaults(requests: DataFrame, n_results: int = DEFAULT_RESULTS) -> DataFrame:
    """Fill in ``n_results``: the request's own value, else the default."""
    given = F.col("n_results") if "n_results" in requests.columns else F.lit(None)
    return requests.withColumn("n_results", F.coalesce(given, F.lit(n_results)).cast("int"))


def search(
    corpus: DataFrame,
    queries: DataFrame,
    keys: list[str],
    vector_col: str = "embedding",
    dim: int = DEFAULT_DIM,
    n_results: int = DEFAULT_RESULTS,
    digits: int | None = None,
    scored: Observation | None = None,
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """The best chunks of every query: ``qid, rank, <keys>, score``.

    ``queries`` has ``qid``, ``query_vector``, and optionally ``n_results`` and
    ``document_name``; with the latter a query sees its own corpus only. A
    ``qid`` that is missing or repeated is an error. Ties go to the lowest
    keys. A large block of queries is scored against one row in ``EARLY_ROWS``
    first, and the others are held against the last result found there; hits
    are taken from all. ``digits`` rounds scores before ranking. ``scored`` observes how many
    rows the first block was scored against.
    """
    spark = corpus.sparkSession
    name = ["document_name"] if "document_name" in queries.columns else []
    wanted = with_request_defaults(queries, n_results).select(
        F.col("qid").cast("bigint"),
        F.col("query_vector").cast("array<float>"),
        "n_results",
        *name,
    )
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    hits = Hits(spark, ", ".join(["qid bigint, rank int", *(f"`{k}` {fields[k]}" for k in keys), "score double"]))
    for block in query_blocks(wanted.where(F.col("n_results") > 0), dim, max_query_bytes):
        scan, by, slots = corpus, None, block.by_name()
        if slots is not None:
            by = "document_name"
            scan = corpus.where(F.col(by).isin(sorted(set(slots) - {None})))  # a block bounds them
        many = len(block.slot_limits) >= MANY_QUERIES
        deepest, floor, early = int(block.limits.max()), None, []
        if many and scored is None and "row_index" in corpus.columns:
            first = F.col("row_index") % EARLY_ROWS == 0
            # plain arrays, as broadcast values are unpickled without this package's code
            shared = spark.sparkContext.broadcast((vars(block), slots, None))
            partial = partial_top_k(scan.where(first), shared, keys, vector_col, digits, by)
            found, path = _ranked(partial, keys, deepest).drop("rank"), scratch_path(spark, "early")
            found.write.parquet(path)
            shared.destroy()
            early = [spark.read.schema(found.schema).parquet(path)]
            floor, scan = last_scores(early[0], block), scan.where(~first)
        if many and "file_path" in corpus.columns:
            scan = in_shares(scan, SHARES)
        if scored is not None:
            scan = scan.observe(scored, F.count(F.lit(1)).alias("rows_scored"))
            scored = None
        shared = spark.sparkContext.broadcast((vars(block), slots, floor))
        partial = partial_top_k(scan, shared, keys, vector_col, digits, by)
        hits.add(best_per_query(reduce(DataFrame.unionByName, [partial, *early]), keys, deepest))
        shared.destroy()
    return hits.read()


class Hits:
    """The results of one search, stored block by block."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, schema, None

    def add(self, rows: DataFrame) -> None:
        self.path = self.path or scratch_path(self.spark, "hits")
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


def best_per_query(candidates: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """Final ranking. ``deepest`` is the largest ``n_results`` of the batch.

    The constant limit lets Spark drop rows before the shuffle already, so a
    query has no more rows there than it has results from every task.
    """
    return _ranked(candidates, keys, deepest).select("qid", "rank", *keys, "score")


def _ranked(candidates: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= deepest) & (F.col("rank") <= F.col("n_results")))


def attach_payload(hits: DataFrame, corpus: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Look stored hits up in the corpus again, for the columns search left behind.

    ``on`` must identify a corpus row. Where the winners lie in few files, the
    plan names these, and no other is opened; else the join finds them, within
    the partitions of their names where ``on`` has the partition column. No
    more than ``LISTED_FILES`` paths ever come to the driver. Spark chooses the
    join.
    """
    source = corpus.select(*on, *columns)
    if "file_path" in on:
        # a constant metadata column: the filter removes files before they are opened
        paths = hits.select("file_path").distinct().limit(LISTED_FILES + 1).toArrow()["file_path"].to_pylist()
        if len(paths) <= LISTED_FILES:
            source = source.where(F.col("file_path").isin(paths))
    return source.join(hits, on)


def score_against(vector_col: str, query_vector: list[float]) -> Column:
    """Dot product of every row with one query vector, as a column."""
    weights = np.asarray(query_vector, dtype=np.float64)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        return pa.array(dense_rows(vectors, len(weights)).astype(np.float64) @ weights)

    return score(F.col(vector_col))


def top_k(scored: DataFrame, keys: list[str], k: int = DEFAULT_RESULTS) -> DataFrame:
    """The ``k`` best rows for one query; fewer if there are no more."""
    return scored.orderBy(F.desc("score"), *keys).limit(k)
