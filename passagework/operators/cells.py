"""Exact search that leaves out parts of a corpus: cells with a centre and a radius.

The rows of a corpus are stored by cell, the nearest of some centres. No row of
a cell can score more than the centre does and the radius adds, by the triangle
inequality. So a query visits the cells in the order of that bound, few at
first, then more, and stops where the bound is below the last of the results it
has. Nothing that could be a result, ties included, is left out; a corpus that
has no clusters is read as a whole.

Centres are fitted on a bounded sample of rows; every row is stored, and the
radius is that of all rows of the cell. A cell with many rows is written and
read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators import search as se
from passagework.operators.ranking import dense_rows, ranges

CELLS = 256
SAMPLE_ROWS = 8192  # the bound on what the centres are fitted on
STEPS = 6  # of moving the centres
PLACED_ROWS = 1024  # whose distances a task holds at a time
FIRST_CELLS, MORE_CELLS = 2, 4  # a query visits so many cells first, and so many times as many in every further round


@dataclass
class CellIndex:
    """A corpus by cells: ``cell`` is a partition column of ``rows``; the rest is as long as there are cells."""

    rows: DataFrame
    keys: list[str]
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray


@dataclass(frozen=True)
class Visits:
    """What a search did: pairs of query and row that were scored, of so many, and rows read, in so many rounds."""

    scored: int
    pairs: int
    rows_read: int
    rounds: int


def centres_of(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Centres far from each other at first, then moved to the middle of their rows."""
    rows = np.unique(np.nan_to_num(sample.astype(np.float64), posinf=0.0, neginf=0.0), axis=0)
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.einsum("ij,ij->i", rows, rows).argmax())]
    away = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(rows)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    centres = rows[chosen]
    for _ in range(steps):
        own = nearest(rows, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, and how far away it is at most; endless where that is no number."""
    rows = rows.astype(np.float64)
    own = np.einsum("ij,ij->i", rows, rows)
    away = own[:, None] + np.einsum("ij,ij->i", centres, centres) - 2 * (rows @ centres.T)
    cell = np.where(np.isnan(away), np.inf, away).argmin(axis=1)
    distance = np.sqrt(((rows - centres[cell]) ** 2).sum(axis=1))
    return cell, np.nan_to_num(distance * (1 + 1e-9), nan=np.inf, posinf=np.inf)


def build(
    corpus: DataFrame, root: str, keys: list[str], vector_col: str = "embedding", dim: int = DEFAULT_DIM,
    cells: int = CELLS, sample_rows: int = SAMPLE_ROWS,
) -> CellIndex:
    """Store the keys and vectors of ``corpus`` by cell under ``root``. A null vector is one of zeros."""
    spark = corpus.sparkSession
    source = corpus.select(*keys, F.col(vector_col).alias("vector"))
    sample = source.orderBy(F.xxhash64(*keys)).limit(sample_rows).select("vector").toArrow()
    centres = centres_of(dense_rows(sample["vector"].combine_chunks(), dim), cells)
    shared = spark.sparkContext.broadcast(centres)
    made = StructType([*source.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PLACED_ROWS):
                part = batch.slice(start, PLACED_ROWS)
                cell, away = nearest(dense_rows(part.column("vector"), dim), shared.value)
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "cell", "away"])

    # a rebalance cuts a cell that holds much over tasks
    source.mapInArrow(run, made).hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{root}/rows")
    shared.destroy()
    stored = spark.read.schema(made).parquet(f"{root}/rows")
    stats = stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows"))
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    listed.join(stats, "cell", "left").coalesce(1).write.parquet(f"{root}/cells")
    return load(spark, root, keys, made)


def load(spark: SparkSession, root: str, keys: list[str], schema: StructType | None = None) -> CellIndex:
    """An index that was built before. Without its ``schema`` one row at least must be in it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    cells = sorted(spark.read.parquet(f"{root}/cells").collect(), key=lambda r: r["cell"])
    return CellIndex(
        reader.parquet(f"{root}/rows").drop("away"),
        keys,
        np.array([c["centre"] for c in cells], np.float64),
        np.array([c["radius"] or 0.0 for c in cells], np.float64),
        np.array([c["rows"] or 0 for c in cells], np.int64),
    )


def bounds(vectors: np.ndarray, index: CellIndex) -> np.ndarray:
    """The most that a row of each cell can score for each vector, with room for what rounding adds."""
    wide = vectors.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    reach = np.sqrt(np.einsum("ij,ij->i", index.centres, index.centres)) + index.radius
    with np.errstate(invalid="ignore"):
        most = wide @ index.centres.T + norm * index.radius + 1e-9 * (1 + norm * reach)
    return np.where(np.isnan(most), np.inf, most)


def search_cells(
    index: CellIndex,
    queries: DataFrame,
    dim: int = DEFAULT_DIM,
    n_results: int = se.DEFAULT_RESULTS,
    digits: int | None = None,
    max_query_bytes: int = se.MAX_QUERY_BYTES,
) -> tuple[DataFrame, Visits]:
    """The same rows as ``search.search`` over the corpus of the index, and what it took.

    ``queries`` has ``qid``, ``query_vector`` and optionally ``n_results``.
    """
    spark, keys = index.rows.sparkSession, index.keys
    if "document_name" in queries.columns:
        raise ValueError("an index is of one corpus: ask without document_name")
    wanted = se.with_request_defaults(queries, n_results).select(
        F.col("qid").cast("bigint"), F.col("query_vector").cast("array<float>"), "n_results"
    )
    fields = {f.name: f.dataType.simpleString() for f in index.rows.schema.fields}
    schema = ", ".join(["qid bigint, rank int", *(f"`{k}` {fields[k]}" for k in keys), "score double"])
    hits, scored, pairs, rows_read, rounds = se.Hits(spark, schema), 0, 0, 0, 0
    for block in se.query_blocks(wanted.where(F.col("n_results") > 0), dim, max_query_bytes):
        found, visits = _search_block(index, block, digits)
        pairs += len(block.slot_limits) * int(index.counts.sum())
        scored, rows_read, rounds = scored + visits[0], rows_read + visits[1], max(rounds, visits[2])
        hits.add(_for_queries(spark, found, block, keys, schema))
    return hits.read(), Visits(scored, pairs, rows_read, rounds)


def _search_block(index: CellIndex, block: se.QueryBlock, digits: int | None) -> tuple[pa.Table | None, tuple[int, int, int]]:
    """The best rows of every slot, as ``qid`` with its ``rank``: rounds over cells, best bounds first."""
    spark, slots = index.rows.sparkSession, len(block.slot_limits)
    asked = {**vars(block), "ids": np.arange(slots), "limits": block.slot_limits, "slots": np.arange(slots)}
    rounding = 0.0 if digits is None else 10.0**-digits
    most = bounds(block.slot_vectors, index)
    order = np.argsort(-most, axis=1, kind="stable")
    left = np.repeat(index.counts[None] > 0, slots, axis=0)
    floor = np.full(slots, -np.inf)
    best: pa.Table | None = None
    width, scored, rows_read, rounds = FIRST_CELLS, 0, 0, 0
    while True:
        left &= most + rounding >= floor[:, None]
        ordered = np.take_along_axis(left, order, axis=1)
        chosen = np.zeros_like(left)
        np.put_along_axis(chosen, order, ordered & (np.cumsum(ordered, axis=1) <= width), axis=1)
        cells = np.flatnonzero(chosen.any(axis=0))
        if not len(cells):
            return best, (scored, rows_read, rounds)
        left &= ~chosen
        scored += int((chosen * index.counts).sum())
        rows_read += int(index.counts[cells].sum())
        rounds, width = rounds + 1, width * MORE_CELLS
        visiting = {int(c): np.flatnonzero(chosen[:, c]) for c in cells}
        shared = spark.sparkContext.broadcast((asked, visiting, floor))
        scan = index.rows.where(F.col("cell").isin(cells.tolist()))
        partial = se.partial_top_k(scan, shared, index.keys, "vector", digits, "cell")
        # as many rows as the block has results, and no more
        found = se.best_per_query(partial, index.keys, int(block.slot_limits.max())).drop("rank").toArrow()
        shared.destroy()
        best = _best(found if best is None else pa.concat_tables([best.drop(["rank"]), found]), index.keys, block.slot_limits)
        slot, rank = np.asarray(best["qid"]), np.asarray(best["rank"])
        last = rank == block.slot_limits[slot]
        floor[slot[last]] = np.asarray(best["score"])[last]


def _best(table: pa.Table, keys: list[str], limits: np.ndarray) -> pa.Table:
    order = [("qid", "ascending"), ("score", "descending"), *((k, "ascending") for k in keys)]
    table = table.sort_by(order)
    slot = np.asarray(table["qid"])
    rank = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left") + 1
    kept = rank <= limits[slot]
    return table.append_column("rank", pa.array(rank.astype(np.int32))).filter(pa.array(kept))


def _for_queries(spark: SparkSession, found: pa.Table | None, block: se.QueryBlock, keys: list[str], schema: str) -> DataFrame:
    """Every query gets the rows of its slot."""
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    slot = np.asarray(found["qid"])
    first = np.searchsorted(slot, block.slots, side="left")
    mine = np.minimum(np.searchsorted(slot, block.slots, side="right") - first, block.limits)
    table = found.take(pa.array(ranges(first, mine)))
    table = table.set_column(table.schema.get_field_index("qid"), "qid", pa.array(np.repeat(block.ids, mine)))
    return spark.createDataFrame(table.select(["qid", "rank", *keys, "score"]), schema)
