"""Text encoders and the Arrow function that applies one to a column.

An encoder is any object with ``dim`` and ``encode(list[str]) -> [n, dim]``.
It is passed as a factory: a model is loaded in the Python worker, once, and
never shipped with the plan. A sentence-transformer model plugs in as
``lambda: MyModelEncoder("/models/name")``.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.vectors import DEFAULT_DIM

# Fixed value: texts handed to the model in one call.
DEFAULT_BATCH_SIZE = 32

REASON_CHARS = 200

# Memory only, no effect on results: rows whose vectors a worker holds and hands over at a time.
OUTCOME_ROWS = 1024


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


EncoderFactory = Callable[[], Encoder]


class _Buckets(dict):
    """Bucket of every short word seen lately; forgets all when it grows too large, so a worker stays small."""

    LIMIT = 1 << 16
    LONGEST = 64

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        bucket = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % self.dim
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = bucket
        return bucket


class HashingEncoder:
    """Deterministic bag of words: md5 bucket counts, scaled to unit length.

    A stand-in that needs no model files. Words that share a bucket collide;
    a text without words becomes the zero vector.
    """

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self.buckets = _Buckets(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        buckets = self.buckets
        found = [[buckets[word] for word in text.lower().split(" ") if word] for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        cell = row * self.dim + np.fromiter(chain.from_iterable(found), np.int64, len(row))
        counts = np.bincount(cell, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        norms[norms == 0] = 1
        return (counts / norms[:, None]).astype(np.float32)


class AsciiHashingEncoder(HashingEncoder):
    """A hashing encoder that refuses text outside ASCII, as some models do."""

    def encode(self, texts: list[str]) -> np.ndarray:
        for text in texts:
            text.encode("ascii")
        return super().encode(texts)


def _worker_encoder(key: str, factory: EncoderFactory) -> Encoder:
    """The encoder of this Python worker, built by the first task that needs it."""
    loaded = sys.__dict__.setdefault("_passagework_encoder", {})
    if key not in loaded:
        loaded.clear()  # one model in memory at a time
        loaded[key] = factory()
    return loaded[key]


def _encode_rows(encoder: Encoder, texts: list[str], out: np.ndarray, rows: list[int], errors: list[str | None]) -> None:
    """Encode a batch into ``out``; if it fails, row by row, so only the bad rows are lost. A lost row keeps its reason."""
    try:
        made = np.asarray(encoder.encode([texts[i] for i in rows]), dtype=np.float32)
    except Exception as failure:
        if len(rows) == 1:
            errors[rows[0]] = f"{type(failure).__name__}: {failure}"[:REASON_CHARS]
            return
        for i in rows:
            _encode_rows(encoder, texts, out, [i], errors)
        return
    if made.shape != (len(rows), encoder.dim):
        raise ValueError(f"the encoder must return vectors of {encoder.dim} numbers")
    out[rows] = made


def _to_arrow(vectors: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    values = pa.array((vectors[~missing] if missing.any() else vectors).ravel())
    offsets = np.concatenate([[0], np.cumsum(np.where(missing, 0, vectors.shape[1]))]).astype(np.int32)
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def length_batches(lengths: np.ndarray, most_rows: int, waste: float, most_chars: int | None = None) -> list[np.ndarray]:
    """Rows in batches of like length, for a model that pads each text to the longest of its batch.

    The padded length of a batch is at most ``1 + waste`` times that of its
    texts, and ``most_chars``, unless one text alone is longer.
    """
    order = np.argsort(lengths, kind="stable")
    batches, start, held = [], 0, 0
    for end, length in enumerate(lengths[order].tolist()):
        rows = end - start + 1
        padded = rows * length
        if rows > 1 and (rows > most_rows or padded > (1 + waste) * (held + length) or (most_chars and padded > most_chars)):
            batches.append(order[start:end])
            start, held = end, 0
        held += length
    return [*batches, order[start:]] if len(order) else []


def encode_outcome(
    text: Column,
    factory: EncoderFactory = HashingEncoder,
    batch_size: int = DEFAULT_BATCH_SIZE,
    pad_waste: float | None = None,
    batch_chars: int | None = None,
) -> Column:
    """``embedding`` and ``error`` in a struct; the vector is NULL where the encoder failed, and the error says why.

    A NULL text has neither. With ``pad_waste`` the texts that a task holds are
    cut into batches of like length (``length_batches``) and not in their order;
    vectors come back in the order of the rows. ``batch_chars`` bounds the padded
    characters of such a batch.
    """
    key = hashlib.md5(cloudpickle.dumps(factory)).hexdigest()
    step = max(1, OUTCOME_ROWS // batch_size) * batch_size

    @F.arrow_udf("struct<embedding: array<float>, error: string>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _worker_encoder(key, factory)
        for batch in batches:
            size = step if pad_waste is None else max(1, len(batch))
            for start in range(0, len(batch), size):
                yield from outcomes(encoder, batch.slice(start, size))
            if not len(batch):
                yield from outcomes(encoder, batch)

    def outcomes(encoder: Encoder, batch: pa.Array) -> Iterator[pa.Array]:
        texts = batch.to_pylist()
        vectors = np.zeros((len(texts), encoder.dim), np.float32)
        errors: list[str | None] = [None] * len(texts)
        rows = [i for i, t in enumerate(texts) if t is not None]
        if pad_waste is None:
            parts = [rows[start : start + batch_size] for start in range(0, len(rows), batch_size)]
        else:
            lengths = np.array([len(texts[i]) for i in rows], np.int64)
            parts = [[rows[k] for k in part] for part in length_batches(lengths, batch_size, pad_waste, batch_chars)]
        for part in parts:
            _encode_rows(encoder, texts, vectors, part, errors)
        missing = np.array([t is None or e is not None for t, e in zip(texts, errors)], dtype=bool)
        for start in range(0, max(1, len(texts)), OUTCOME_ROWS):
            own = slice(start, start + OUTCOME_ROWS)
            made = [_to_arrow(vectors[own], missing[own]), pa.array(errors[own], pa.string())]
            yield pa.StructArray.from_arrays(made, names=["embedding", "error"])

    # not to be run again for a filter on its result, as Spark would when it pushes one below
    embed = embed.asNondeterministic()
    return embed(text)


def encode(text: Column, factory: EncoderFactory = HashingEncoder, batch_size: int = DEFAULT_BATCH_SIZE, **batches: float) -> Column:
    """``array<float>`` column of embeddings; NULL where the encoder failed."""
    return encode_outcome(text, factory, batch_size, **batches)["embedding"]
