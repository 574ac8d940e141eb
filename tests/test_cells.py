"""A corpus by cells gives the same results as the whole corpus, and scores less of it."""

import numpy as np
import pytest

from passagework.operators import cells as ce
from passagework.operators import search as se

DIM = 8
SCHEMA = "doc_id bigint, chunk bigint, embedding array<float>"
KEYS = ["doc_id", "chunk"]


def clustered(seed, clusters=30, each=40, noise=0.03):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(clusters, DIM))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return [(i, i % 3, v.tolist()) for i, v in enumerate(np.repeat(centres, each, axis=0) + noise * dice.normal(size=(clusters * each, DIM)))]


def unclustered(seed, rows=600):
    return [(i, 0, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(rows, DIM)))]


def both(spark, tmp_path, rows, asked, cells=24, schema="qid bigint, query_vector array<float>, n_results int", **options):
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(5)
    queries = spark.createDataFrame(asked, schema)
    index = ce.build(corpus, str(tmp_path / "index"), KEYS, dim=DIM, cells=cells, sample_rows=400)
    hits, visits = ce.search_cells(index, queries, dim=DIM, **options)
    whole = se.search(corpus, queries, KEYS, dim=DIM, **options)
    assert hits.columns == whole.columns
    got, want = (sorted(map(tuple, r.collect())) for r in (hits, whole))
    assert got == want
    return got, visits


@pytest.mark.parametrize("digits", [None, 5])
def test_clustered_corpus_scores_a_part_of_it(spark, tmp_path, digits):
    rows = clustered(1)
    got, visits = both(spark, tmp_path, rows, [(q, rows[q * 31][2], 1 + q % 9) for q in range(36)], digits=digits)
    assert len(got) == sum(1 + q % 9 for q in range(36))
    assert visits.pairs == 36 * len(rows) and visits.scored < visits.pairs / 4
    assert visits.rounds < 4


def test_corpus_without_clusters_is_exact(spark, tmp_path):
    rows = unclustered(2)
    dice = np.random.default_rng(3)
    _, visits = both(spark, tmp_path, rows, [(q, dice.normal(size=DIM).tolist(), 7) for q in range(20)])
    assert visits.scored <= visits.pairs


def test_ties_zeros_and_odd_vectors(spark, tmp_path):
    rows = clustered(4, clusters=5, each=20)
    # a third of all rows are copies of one vector; some have none, or no number in it
    rows += [(1000 - i, i, rows[0][2]) for i in range(60)]
    rows += [(2000, 0, None), (2001, 0, []), (2002, 0, [1.0]), (2003, 0, [float("nan")] * DIM), (2004, 0, [float("inf")] + [0.0] * 7)]
    asked = [(1, rows[0][2], 30), (2, [0.0] * DIM, 12), (3, [], 4), (4, rows[50][2], 1000), (5, rows[0][2], 2), (6, rows[9][2], 0)]
    got, _ = both(spark, tmp_path, rows, asked, digits=4)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5} and sum(r[0] == 4 for r in got) == len(rows)


def test_many_blocks_and_empty_tables(spark, tmp_path):
    rows = clustered(5, clusters=8, each=15)
    asked = [(q, rows[q][2], 3) for q in range(60)]
    both(spark, tmp_path, rows, asked, max_query_bytes=4 * DIM * 200)
    assert both(spark, tmp_path / "none", rows, [])[0] == []
    assert both(spark, tmp_path / "empty", [], [(1, [1.0] * DIM, 3)])[0] == []


def test_an_index_can_be_read_again_and_has_no_names(spark, tmp_path):
    rows = clustered(6, clusters=4, each=10)
    corpus = spark.createDataFrame(rows, SCHEMA)
    root = str(tmp_path / "index")
    made = ce.build(corpus, root, KEYS, dim=DIM, cells=4)
    again = ce.load(spark, root, KEYS)
    assert (made.centres == again.centres).all() and (made.radius == again.radius).all() and again.counts.sum() == 40
    named = spark.createDataFrame([(1, [1.0] * DIM, "a")], "qid bigint, query_vector array<float>, document_name string")
    with pytest.raises(ValueError):
        ce.search_cells(again, named, dim=DIM)


def test_bounds_hold_for_every_row():
    dice = np.random.default_rng(7)
    rows = dice.normal(size=(500, DIM))
    centres = ce.centres_of(rows[:100].astype(np.float32), 12)
    cell, away = ce.nearest(rows, centres)
    radius = np.zeros(len(centres))
    np.maximum.at(radius, cell, away)
    index = ce.CellIndex(None, KEYS, centres, radius, np.bincount(cell, minlength=len(centres)))
    asked = dice.normal(size=(50, DIM))
    most = ce.bounds(asked, index)
    assert (asked @ rows.T <= most[:, cell]).all()


def test_only_visited_cells_are_read(spark, tmp_path):
    rows = clustered(8)
    corpus = spark.createDataFrame(rows, SCHEMA)
    index = ce.build(corpus, str(tmp_path / "index"), KEYS, dim=DIM, cells=30)
    _, visits = ce.search_cells(index, spark.createDataFrame([(1, rows[0][2])], "qid bigint, query_vector array<float>"), dim=DIM)
    assert visits.rows_read == visits.scored < len(rows) / 3
    plan = index.rows.where("cell in (3, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
