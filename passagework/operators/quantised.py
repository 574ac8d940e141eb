"""Exact search that scans bytes in place of floats: codes with a scale and a proven error per row.

A row is stored as one signed byte per dimension, the scale these are counted
in, and the length of what rounding took away. A question's score with the code
is off by no more than that length times its own, so every row has a least and
a greatest score. A row whose greatest score is below the k-th of the least
scores cannot be a result. The others are scored again from their float32
vectors, which are read for them alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators import search as se
from passagework.operators.ranking import dense_rows, exact_scores

STEPS = 127
TILE_SCORES = 1 << 21
NOT_A_NUMBER = -1.0  # the error of a row whose score may be anything


@dataclass
class CodeIndex:
    codes: DataFrame  # keys, code, scale, error, same; read by every search
    rows: DataFrame  # keys and vector, with the place of each row; read for candidates only
    keys: list[str]
    dim: int


@dataclass(frozen=True)
class Candidates:
    """Rows that were scored again, of so many pairs of question and row."""

    rescored: int


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, and how far each row is from its code at most."""
    wide = vectors.astype(np.float64)
    with np.errstate(invalid="ignore"):
        largest = np.abs(wide).max(axis=1, initial=0.0)
        usable = np.isfinite(largest)
        scale = np.where(usable & (largest > 0), largest / STEPS, 1.0)
        codes = np.where(usable[:, None], np.rint(wide / scale[:, None]), 0.0).astype(np.int8)
        away = np.sqrt(((wide - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12 * scale
    return codes, scale, np.where(usable, away, NOT_A_NUMBER)


def build(corpus: DataFrame, root: str, keys: list[str], vector_col: str = "embedding", dim: int = DEFAULT_DIM) -> CodeIndex:
    """Store codes and float32 rows of ``corpus`` under ``root``. A null vector is one of zeros."""
    spark = corpus.sparkSession
    rows = corpus.select(*keys, F.col(vector_col).cast("array<float>").alias("vector"))
    rows.write.parquet(f"{root}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    kept = [f for f in rows.schema.fields if f.name in keys]
    made = [("code", BinaryType()), ("scale", DoubleType()), ("error", DoubleType()), ("same", LongType())]
    schema = StructType([*kept, *(StructField(n, t) for n, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scale, error = encoded(dense_rows(batch.column("vector"), dim))
            raw = pa.py_buffer(np.ascontiguousarray(codes))
            offsets = pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * dim)
            code = pa.Array.from_buffers(pa.binary(), len(codes), [None, offsets, raw])
            columns = [*(batch.column(k) for k in keys), code, pa.array(scale), pa.array(error), batch.column("same")]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *(n for n, _ in made)])

    # equal vectors have an equal number, so of copies only as many as can be results become candidates
    source = stored.select(*keys, "vector", F.xxhash64("vector").alias("same"))
    source.mapInArrow(run, schema).write.parquet(f"{root}/codes")
    return load(spark, root, keys, dim, schema, rows.schema)


def load(
    spark: SparkSession, root: str, keys: list[str], dim: int = DEFAULT_DIM,
    code_schema: StructType | None = None, row_schema: StructType | None = None,
) -> CodeIndex:
    def table(name: str, schema: StructType | None) -> DataFrame:
        return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{name}")

    rows = table("rows", row_schema)
    return CodeIndex(table("codes", code_schema), rows.select("*", F.col("_metadata.file_path").alias("file_path")), keys, dim)


class Between:
    """Which rows can be among the best of each slot, from their least and greatest scores."""

    def __init__(self, vectors: np.ndarray, limits: np.ndarray, rounding: float):
        self.vectors = vectors
        self.wide = vectors.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.wide, self.wide))
        self.limits, self.rounding = limits, rounding
        self.floor = np.full(len(limits), -np.inf)
        self.held: list[pa.Table] = []

    def add(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, rows: pa.Table) -> None:
        rough = (codes.astype(np.float32) @ self.vectors.T).astype(np.float64) * scale[:, None]
        # float32 products of whole numbers up to 127: off by a share of the lengths of both
        length = np.sqrt(np.einsum("ij,ij->i", codes.astype(np.float32), codes.astype(np.float32), dtype=np.float64)) * scale
        noise = codes.shape[1] * 2.0**-22 * length
        with np.errstate(invalid="ignore"):
            slack = (error + noise)[:, None] * self.norm + 1e-12
        unsure = (error == NOT_A_NUMBER)[:, None] | ~np.isfinite(rough) | ~np.isfinite(slack)
        least = np.where(unsure, -np.inf, rough - slack)
        most = np.where(unsure, np.inf, rough + slack)
        keep = min(int(self.limits.max(initial=1)), len(least))
        for slot in np.flatnonzero(self.limits <= len(least)):
            kth = np.partition(least[:, slot], -int(self.limits[slot]))[-int(self.limits[slot])]
            self.floor[slot] = max(self.floor[slot], kth)
        at, slot = np.nonzero(most + self.rounding >= self.floor)
        if keep and len(at):
            found = rows.take(pa.array(at)).append_column("slot", pa.array(slot))
            found = found.append_column("least", pa.array(least[at, slot])).append_column("most", pa.array(most[at, slot]))
            self.held.append(found)
            if sum(map(len, self.held)) > 1 << 18:
                self.settle()

    def settle(self) -> pa.Table | None:
        """What is still possible; of equal rows those with the lowest keys."""
        if not self.held:
            return None
        table = pa.concat_tables(self.held)
        keys = [n for n in table.column_names if n not in ("slot", "least", "most", "same")]
        table = table.sort_by([(n, "ascending") for n in ("slot", "same", *keys)])
        slot, same, most = (np.asarray(table[n]) for n in ("slot", "same", "most"))
        new = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (same[1:] != same[:-1])])
        place = np.arange(len(slot)) - np.repeat(new, np.diff(np.r_[new, len(slot)]))
        table = table.filter(pa.array((place < self.limits[slot]) & (most + self.rounding >= self.floor[slot])))
        self.held = [table]
        return table


def search_codes(
    index: CodeIndex,
    queries: DataFrame,
    n_results: int = se.DEFAULT_RESULTS,
    digits: int | None = None,
    max_query_bytes: int = se.MAX_QUERY_BYTES,
) -> tuple[DataFrame, Candidates]:
    """The same rows as ``search.search`` over the corpus of the index, and how many had to be scored again.

    ``queries`` has ``qid``, ``query_vector`` and optionally ``n_results``.
    """
    spark, keys, dim = index.rows.sparkSession, index.keys, index.dim
    if "document_name" in queries.columns:
        raise ValueError("an index is of one corpus: ask without document_name")
    wanted = se.with_request_defaults(queries, n_results).select(
        F.col("qid").cast("bigint"), F.col("query_vector").cast("array<float>"), "n_results"
    )
    kinds = {f.name: f.dataType.simpleString() for f in index.rows.schema.fields}
    columns = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    hits, rescored = se.Hits(spark, f"qid bigint, rank int, {columns}, score double"), 0
    for block in se.query_blocks(wanted.where(F.col("n_results") > 0), dim, max_query_bytes):
        shared = spark.sparkContext.broadcast(vars(block))
        rounding = 0.0 if digits is None else 10.0**-digits

        def select(batches: Iterator[pa.RecordBatch], shared=shared, rounding=rounding) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            between = Between(asked["slot_vectors"], asked["slot_limits"], rounding)
            step = max(1, TILE_SCORES // max(1, len(asked["slot_limits"])))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    tile = pa.Table.from_batches([batch.slice(start, step)])
                    codes = np.frombuffer(b"".join(tile["code"].to_pylist()), np.int8).reshape(-1, dim)
                    between.add(codes, np.asarray(tile["scale"]), np.asarray(tile["error"]), tile.select([*keys, "same"]))
            if (table := between.settle()) is not None:
                yield from table.select([*keys, "slot", "least", "most"]).combine_chunks().to_batches()

        found = index.codes.mapInArrow(select, f"{columns}, slot bigint, least double, most double")
        # the bar of all tasks together: the k-th of the least scores of a slot
        limits = spark.createDataFrame([(i, int(n)) for i, n in enumerate(block.slot_limits)], "slot bigint, deepest int")
        order = Window.partitionBy("slot").orderBy(F.desc("least"))
        ranked = found.join(limits, "slot").withColumn("place", F.row_number().over(order))
        bar = F.max(F.when(F.col("place") == F.col("deepest"), F.col("least"))).over(Window.partitionBy("slot"))
        possible = ranked.withColumn("bar", bar).where("bar is null or most + {r} >= bar".format(r=repr(rounding)))
        path = se.scratch_path(spark, "candidates")
        # rows with equal keys are looked up together, so a pair is asked for once
        possible.select("slot", *keys).distinct().write.parquet(path)
        stored = spark.read.parquet(path)
        rescored += stored.count()

        def rescore(batches: Iterator[pa.RecordBatch], shared=shared, digits=digits) -> Iterator[pa.RecordBatch]:
            vectors = shared.value["slot_vectors"]
            for batch in batches:
                scores = exact_scores(dense_rows(batch.column("vector"), dim), np.arange(batch.num_rows), vectors, np.asarray(batch.column("slot")))
                scores = scores if digits is None else np.round(scores, digits) + 0.0
                columns = [*(batch.column(k) for k in keys), batch.column("slot"), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "slot", "score"])

        on = [index.rows[k].eqNullSafe(stored[k]) for k in keys]
        pairs = index.rows.join(stored, on).select(*[index.rows[k] for k in keys], "slot", "vector")
        scored = pairs.mapInArrow(rescore, f"{columns}, slot bigint, score double")
        owners = spark.createDataFrame(
            list(zip(block.ids.tolist(), block.slots.tolist(), block.limits.tolist())), "qid bigint, slot bigint, n_results int"
        )
        best = se.best_per_query(scored.join(owners, "slot").drop("slot"), keys, int(block.limits.max()))
        hits.add(best)
        shared.destroy()
    return hits.read(), Candidates(rescored)
