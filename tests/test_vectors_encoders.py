import hashlib
from functools import partial

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagework.functions import encoders as enc
from passagework.functions import vectors as vx
from passagework.functions.encoders import AsciiHashingEncoder, HashingEncoder, encode


def parsed(spark, *cells, lenient=False):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.orderBy("i").select(vx.parse_vector(F.col("c"), lenient).alias("v")).collect()]


def test_parse(spark):
    assert parsed(spark, "", "[]", None, "0.1 -0.2", "[0.1 -0.2 3e-2]", "[ 1  2 ]", "  7 ") == [
        [], [], [], [0.1, -0.2], [0.1, -0.2, 0.03], [1.0, 2.0], [7.0],
    ]


def test_parse_junk(spark):
    with pytest.raises(PySparkException):
        parsed(spark, "1 two 3")
    assert parsed(spark, "1 two 3", lenient=True) == [[1.0, None, 3.0]]


@pytest.mark.parametrize("length", [0, 1, 3, 4, 5, 9])
def test_fit_dimension(spark, length):
    vector = [float(i + 1) for i in range(length)]
    df = spark.createDataFrame([(vector,)], "v array<double>")
    assert df.select(vx.fit_dimension(F.col("v"), 4)).first()[0] == (vector + [0.0] * 4)[:4]


def test_fit_dimension_of_null_and_of_floats(spark):
    df = spark.createDataFrame([(None,), ([1.5],)], "v array<float>")
    assert [r[0] for r in df.select(vx.fit_dimension(F.col("v"), 2)).collect()] == [[0.0, 0.0], [1.5, 0.0]]


def test_pad_then_truncate_is_identity(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    back = vx.as_float32(vx.fit_dimension(vx.fit_dimension(F.col("embedding"), 96), 64))
    assert df.where(back != F.col("embedding")).isEmpty()


def test_text_form_keeps_every_bit(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    back = vx.as_float32(vx.parse_vector(vx.format_vector(F.col("embedding"))))
    assert df.where(back != F.col("embedding")).isEmpty()


def test_dot_product_of_unit_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = vx.dot_product(F.col("embedding"), F.col("embedding"))
    assert df.where(F.abs(own - 1) > 1e-5).isEmpty()


def test_hashing_encoder():
    encoder = HashingEncoder(16)
    got = encoder.encode(["b a  B", "", "c"])
    want = np.zeros(16)
    for word in ("b", "a", "b"):
        want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
    assert got.dtype == np.float32 and got.shape == (3, 16)
    np.testing.assert_array_equal(got[0], (want / np.linalg.norm(want)).astype(np.float32))
    assert not got[1].any()


def embedded(spark, texts, factory, batch_size=32):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.withColumn("v", encode(F.col("t"), factory, batch_size)).orderBy("i").collect()
    return [r.v for r in rows]


def test_encode_column_equals_encoder(spark):
    texts = [f"word{i} and word{i % 7}" for i in range(100)]
    want = HashingEncoder(32).encode(texts).tolist()
    for batch_size in (1, 7, 32, 1000):
        assert embedded(spark, texts, partial(HashingEncoder, 32), batch_size) == want


def test_failing_rows_become_null(spark):
    texts = ["ok", "schön", None, "fine", "naïve"]
    got = embedded(spark, texts, partial(AsciiHashingEncoder, 8))
    assert [v is None for v in got] == [False, True, True, False, True]
    assert got[3] == HashingEncoder(8).encode(["fine"])[0].tolist()


def test_all_rows_fail(spark):
    assert embedded(spark, ["é", "ü"], partial(AsciiHashingEncoder, 8)) == [None, None]


class WrongSize:
    dim = 4

    def encode(self, texts):
        return np.zeros((len(texts), 5), dtype=np.float32)


def test_wrong_vector_size_is_an_error(spark):
    with pytest.raises(PySparkException, match="vectors of 4"):
        embedded(spark, ["x"], WrongSize)


class CountingEncoder:
    dim = 2

    def __init__(self):
        self.calls = 0

    def encode(self, texts):
        self.calls += 1
        return np.array([[self.calls, len(texts)] for _ in texts], dtype=np.float32)


def test_texts_reach_the_encoder_in_batches(spark):
    got = embedded(spark, [str(i) for i in range(10)], CountingEncoder, batch_size=4)
    assert [v[1] for v in got] == [4, 4, 4, 4, 4, 4, 4, 4, 2, 2]


# batches by length


class PaddingEncoder:
    """Counts what it pads; a text's vector does not depend on its batch."""

    dim = 2
    seen: list = []

    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return np.array([[len(t), t.count("a")] for t in texts], np.float32)


def test_batches_have_like_lengths():
    dice = np.random.default_rng(1)
    lengths = np.minimum(dice.pareto(0.8, 5000) * 40, 200_000).astype(np.int64)
    lengths[17] = 3_000_000
    batches = enc.length_batches(lengths, 32, 0.1, 1 << 16)
    assert sorted(np.concatenate(batches).tolist()) == list(range(5000))
    padded = [len(b) * int(lengths[b].max()) for b in batches]
    assert sum(padded) <= 1.1 * lengths.sum()
    assert all(len(b) <= 32 and (len(b) == 1 or p <= 1 << 16) for b, p in zip(batches, padded))
    in_order = sum(32 * int(lengths[i : i + 32].max()) for i in range(0, 5000, 32))
    assert sum(padded) < in_order / 3
    assert enc.length_batches(np.zeros(0, np.int64), 32, 0.1) == []


def test_vectors_do_not_depend_on_batches(spark):
    dice = np.random.default_rng(2)
    rows = [(i, "a" * int(dice.integers(0, 400)) + "b" * int(dice.integers(0, 9))) for i in range(500)]
    rows += [(500, None), (501, ""), (502, "bad one"), (503, "a" * 300_000)]
    table = spark.createDataFrame(rows, "id int, text string").repartition(3)
    plain = table.select("id", enc.encode_outcome(F.col("text"), PaddingEncoder, 16).alias("o"))
    sorted_ones = table.select("id", enc.encode_outcome(F.col("text"), PaddingEncoder, 16, 0.1, 1 << 12).alias("o"))
    got = {r["id"]: tuple(r["o"]) for r in sorted_ones.collect()}
    assert got == {r["id"]: tuple(r["o"]) for r in plain.collect()}
    assert got[502][1].startswith("ValueError") and got[500] == (None, None) and got[503][0] == [300_000, 300_000]
