"""A table cut into parts of bounded size, that later steps meet again without another shuffle of its texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import scratch_path


def numbered(rows: DataFrame, parts: int, part: str = "part", number: str = "number") -> DataFrame:
    """``rows`` with a ``number`` each and the ``part`` it goes to, whatever its values are."""
    named = rows.withColumn(number, F.monotonically_increasing_id())
    return named.withColumn(part, F.pmod(F.xxhash64(number), F.lit(parts)).cast("int"))


@contextmanager
def in_parts(rows: DataFrame, buckets: int, part: str = "part") -> Iterator[tuple[DataFrame, str]]:
    """``rows`` bucketed by ``part``, and the path they are stored at.

    The rows are shuffled once. Groups and cogroups by part need no further
    shuffle of them while the context lasts; it holds a table of the session's
    catalog, which is dropped at its end. The files stay until the application
    ends.
    """
    spark = rows.sparkSession
    name, path = f"parts_{uuid.uuid4().hex}", scratch_path(spark, "parts")
    writer = rows.repartition(buckets, part).write.bucketBy(buckets, part).option("path", path)
    writer.option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name), path
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


LEVEL = 6  # what is sent costs more than the time to make it small


def squeezed(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(np.ascontiguousarray(values).tobytes(), asbytes=True) if values.size else b""


def spread(raw: bytes, count: int, kind: str) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b"", kind)


def planes(values: np.ndarray) -> bytes:
    """Whole numbers by bytes of one weight, so that leading zeros cost nothing."""
    return squeezed(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def from_planes(raw: bytes, count: int) -> np.ndarray:
    return np.ascontiguousarray(spread(raw, 8 * count, "u1").reshape(8, -1).T).view("<u8").ravel()


def groups(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
