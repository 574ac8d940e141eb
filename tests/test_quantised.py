"""Codes of one byte give the results of float32 vectors, near ties included."""

from pathlib import Path

import numpy as np
import pytest

from passagework.operators import quantised as qu
from passagework.operators import search as se

DIM = 24
SCHEMA = "doc_id bigint, chunk bigint, embedding array<float>"
KEYS = ["doc_id", "chunk"]


def both(spark, tmp_path, rows, asked, **options):
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = spark.createDataFrame(asked, "qid bigint, query_vector array<float>, n_results int")
    index = qu.build(corpus, str(tmp_path / "index"), KEYS, dim=DIM)
    hits, candidates = qu.search_codes(index, queries, **options)
    whole = se.search(corpus, queries, KEYS, dim=DIM, **options)
    assert hits.columns == whole.columns
    got, want = (sorted(map(tuple, r.collect())) for r in (hits, whole))
    assert got == want
    return got, candidates


@pytest.mark.parametrize("digits", [None, 4])
def test_equal_to_search(spark, tmp_path, digits):
    dice = np.random.default_rng(1)
    rows = [(i, i % 2, dice.normal(size=DIM).tolist()) for i in range(800)]
    asked = [(q, dice.normal(size=DIM).tolist(), 1 + q % 8) for q in range(30)]
    got, candidates = both(spark, tmp_path, rows, asked, digits=digits)
    assert len(got) == sum(1 + q % 8 for q in range(30))
    assert candidates.rescored < 30 * 800 / 10


def test_near_ties_are_told_apart(spark, tmp_path):
    """Rows that differ by less than a step of their codes."""
    dice = np.random.default_rng(2)
    base = dice.normal(size=DIM)
    rows = [(i, 0, (base + 1e-4 * dice.normal(size=DIM)).tolist()) for i in range(300)]
    rows += [(1000 + i, 0, (base * (1 + i * 1e-6)).tolist()) for i in range(50)]
    got, candidates = both(spark, tmp_path, rows, [(1, base.tolist(), 10), (2, (-base).tolist(), 10), (3, rows[7][2], 3)])
    assert len(got) == 23 and candidates.rescored > 300


def test_copies_zeros_and_odd_vectors(spark, tmp_path):
    dice = np.random.default_rng(3)
    rows = [(i, 0, dice.normal(size=DIM).tolist()) for i in range(60)]
    rows += [(900 - i, i % 2, rows[0][2]) for i in range(300)]  # most rows are one vector
    rows += [(2000, 0, None), (2001, 0, []), (2002, 0, [0.0] * DIM), (2003, 0, [1e30] * DIM), (2004, 0, [float("nan")] + [0.0] * 23)]
    rows += [(2005, 0, [1e-30] * DIM), (5, 0, rows[5][2])]
    asked = [(1, rows[0][2], 7), (2, [0.0] * DIM, 9), (3, rows[5][2], 4), (4, [], 3), (5, rows[9][2], 0)]
    _, candidates = both(spark, tmp_path, rows, asked, digits=5)
    assert candidates.rescored < 5 * len(rows)


def test_blocks_and_empty_tables(spark, tmp_path):
    dice = np.random.default_rng(4)
    rows = [(i, 0, dice.normal(size=DIM).tolist()) for i in range(100)]
    both(spark, tmp_path / "a", rows, [(q, rows[q][2], 3) for q in range(40)], max_query_bytes=4 * DIM * 50)
    assert both(spark, tmp_path / "b", rows, [])[0] == []
    assert both(spark, tmp_path / "c", [], [(1, [1.0] * DIM, 3)])[0] == []


def test_errors_bound_every_score():
    dice = np.random.default_rng(5)
    rows = (dice.normal(size=(400, DIM)) * 10.0 ** dice.integers(-6, 6, (400, 1))).astype(np.float32)
    codes, scale, error = qu.encoded(rows)
    asked = dice.normal(size=(50, DIM)).astype(np.float32)
    true = rows.astype(np.float64) @ asked.T.astype(np.float64)
    rough = (codes * scale[:, None]) @ asked.T.astype(np.float64)
    assert (np.abs(true - rough) <= error[:, None] * np.linalg.norm(asked.astype(np.float64), axis=1) * (1 + 1e-9) + 1e-12).all()


def test_codes_take_a_quarter_of_the_bytes(spark, tmp_path):
    dice = np.random.default_rng(6)
    rows = [(i, 0, dice.normal(size=768).tolist()) for i in range(400)]
    qu.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "i"), KEYS, dim=768)

    def size(name):
        return sum(p.stat().st_size for p in Path(tmp_path / "i" / name).rglob("*.parquet"))

    assert size("codes") < 0.3 * size("rows")
