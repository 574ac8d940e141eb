import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from passagework.operators import ranking
from passagework.operators import search as se
from passagework.session import scratch_path

SCHEMA = "id bigint, document_name string, embedding array<float>"


def brute(rows, queries, k=5, digits=None):
    """Every score, in double precision, sorted."""
    out = []
    for qid, vector, *rest in queries:
        limit = rest[0] if rest and rest[0] is not None else k
        name = rest[1] if len(rest) > 1 else None
        dim = len(vector)
        scored = []
        for key, own, embedding in rows:
            if name is not None and own != name:
                continue
            fitted = (list(embedding or []) + [0.0] * dim)[:dim]
            score = float(np.dot(np.array(fitted, np.float32).astype(float), np.array(vector, np.float32).astype(float)))
            scored.append((-(score if digits is None else round(score, digits)), key))
        out += [(qid, rank, key) for rank, (_, key) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


def ranked(result):
    return sorted((r.qid, r.rank, r.id) for r in result.collect())


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    rows = [(i, f"n{i % 3}", rng.standard_normal(12).astype(np.float32).tolist()) for i in range(700)]
    asked = [(q, rng.standard_normal(12).astype(np.float32).tolist()) for q in range(40)]
    return rows, asked


def run(spark, rows, asked, schema="qid bigint, query_vector array<float>", parts=4, **options):
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return se.search(corpus, spark.createDataFrame(asked, schema), ["id"], dim=12, **options)


@pytest.mark.parametrize("digits", [None, 5, 1])
def test_against_brute_force(spark, numbers, digits):
    rows, asked = numbers
    result = run(spark, rows, asked, digits=digits)
    assert ranked(result) == brute(rows, asked, digits=digits)


def test_small_tiles_and_batches(spark, numbers, monkeypatch):
    rows, asked = numbers
    monkeypatch.setattr(se, "TILE_SCORES", 200)
    result = run(spark, rows, asked, parts=2, digits=2)
    assert ranked(result) == brute(rows, asked, digits=2)


def test_batch_beyond_the_broadcast_bound(spark, numbers):
    rows, asked = numbers
    result = run(spark, rows, asked, max_query_bytes=4 * 12 * 15)
    assert ranked(result) == brute(rows, asked)


@pytest.mark.parametrize("max_bytes", [4 * 12 * 5, se.MAX_QUERY_BYTES])
@pytest.mark.parametrize("qids", [[1] * 40, [None, *range(39)], [*range(39), 38]])
def test_repeated_or_missing_qid_is_an_error(spark, numbers, qids, max_bytes):
    rows, asked = numbers
    with pytest.raises(ValueError, match="unique"):
        run(spark, rows, [(q, v) for q, (_, v) in zip(qids, asked)], max_query_bytes=max_bytes)


def test_blocks_are_bounded(spark, numbers):
    _, asked = numbers
    queries = spark.createDataFrame([(q, v, 5) for q, v in asked], "qid bigint, query_vector array<float>, n_results int")
    each = 4 * 12 + 5 * se.RESULT_BYTES
    blocks = list(se.query_blocks(queries, 12, 4 * each))
    assert sorted(q for b in blocks for q in b.ids.tolist()) == sorted(q for q, _ in asked)
    assert len(blocks) >= 8 and max(len(b.ids) for b in blocks) <= 12
    deep = list(se.query_blocks(queries.withColumn("n_results", F.lit(500)), 12, 40 * each))
    assert len(deep) > 8


def test_one_broadcast_at_a_time(spark, numbers, monkeypatch):
    """A block's arrays are released before the next block is read."""
    from pyspark import Broadcast

    alive, most, destroy, blocks = [0], [0], Broadcast.destroy, se.query_blocks

    def counted(*args):
        for block in blocks(*args):
            assert alive[0] == 0
            alive[0] += 1
            most[0] += 1
            yield block

    def destroyed(self, *args):
        alive[0] -= 1
        return destroy(self, *args)

    monkeypatch.setattr(se, "query_blocks", counted)
    monkeypatch.setattr(Broadcast, "destroy", destroyed)
    rows, asked = numbers
    assert ranked(run(spark, rows, asked, max_query_bytes=4 * 12 * 150)) == brute(rows, asked) and most[0] > 3


def test_more_than_a_thousand_corpora(spark):
    rows = [(i, f"n{i}", [float(i % 7), 1.0] + [0.0] * 10) for i in range(1500)]
    asked = [(i, [1.0] * 12, 2, f"n{i}") for i in range(1200)]
    schema = "qid bigint, query_vector array<float>, n_results int, document_name string"
    assert ranked(run(spark, rows, asked, schema)) == [(i, 1, i) for i in range(1200)]


def test_scores_do_not_increase(spark, numbers):
    rows, asked = numbers
    result = run(spark, rows, asked)
    scores = {}
    for r in result.orderBy("qid", "rank").collect():
        assert r.score <= scores.get(r.qid, np.inf)
        scores[r.qid] = r.score


def test_own_number_of_results(spark, numbers):
    rows, asked = numbers
    requests = [(q, v, n) for (q, v), n in zip(asked, [1, 7, None, 0, 2000])]
    result = run(spark, rows, requests, "qid bigint, query_vector array<float>, n_results int")
    assert ranked(result) == brute(rows, requests)


def test_queries_see_their_own_corpus(spark, numbers):
    rows, asked = numbers
    names = ["n0", "n1", "n2", "nowhere"]
    requests = [(q, v, 3, names[i % 4]) for i, (q, v) in enumerate(asked)]
    schema = "qid bigint, query_vector array<float>, n_results int, document_name string"
    result = run(spark, rows, requests, schema)
    assert ranked(result) == brute(rows, requests)


def test_ties_go_to_the_lowest_key(spark):
    rows = [(i, "n", [1.0] * 12) for i in range(300)]
    result = run(spark, rows, [(1, [0.0] * 12), (2, [1.0] * 12)], parts=5)
    assert ranked(result) == [(q, k + 1, k) for q in (1, 2) for k in range(5)]


def test_hot_tie_on_a_third_of_the_rows(spark, numbers):
    rows, asked = numbers
    hot = [(i, n, rows[0][2] if i % 3 == 0 else v) for i, n, v in rows]
    result = run(spark, hot, asked)
    assert ranked(result) == brute(hot, asked)


@pytest.mark.parametrize("digits", [None, 5, 0])
def test_crowded_candidates(numbers, monkeypatch, digits):
    """Few distinct vectors, so whole crowds of rows tie; in one task, with small limits."""
    monkeypatch.setattr(ranking, "CROWDED", 10)
    monkeypatch.setattr(ranking, "RESCORE_PAIRS", 7)
    rows, asked = numbers
    copies = [(i, n, rows[i % 4][2]) for i, n, _ in rows]
    vectors = np.array([v for _, v in asked], np.float32)
    limits = np.array([1 + i % 9 for i in range(len(asked))])
    best = ranking.BestRows(vectors, limits, ["id"], digits)
    for start in range(0, len(copies), 150):
        part = copies[start : start + 150][::-1]
        keys = pa.table({"id": [i for i, _, _ in part]})
        best.add(np.array([v for _, _, v in part], np.float32), keys, np.arange(len(asked)))
    best.settle()
    got = {}
    for query, key in zip(best.table["query"].to_pylist(), best.table["id"].to_pylist()):
        got.setdefault(query, []).append(key)
    want = brute(copies, [(q, v, int(n)) for (q, v), n in zip(asked, limits)], digits=digits)
    assert sorted((q, r, k) for q, keys in got.items() for r, k in enumerate(keys, 1)) == want


def test_repeated_queries_are_scored_once(spark, numbers):
    rows, asked = numbers
    same = [(q, asked[q % 2][1], 1 + q) for q in range(20)]
    result = run(spark, rows, same, "qid bigint, query_vector array<float>, n_results int")
    assert ranked(result) == brute(rows, same)
    block = se.QueryBlock.of(pa.table({"qid": [1, 2], "query_vector": [[1.0], [1.0]], "n_results": [3, 9]}), 1)
    assert block.slot_vectors.shape == (1, 1) and block.slot_limits.tolist() == [9]


def test_missing_short_and_long_vectors(spark, numbers):
    rows, asked = numbers
    odd = [(1000, "n", None), (1001, "n", []), (1002, "n", [9.0] * 3), (1003, "n", [0.1] * 20)]
    result = run(spark, rows[:20] + odd, asked, n_results=24)
    assert ranked(result) == brute(rows[:20] + odd, asked, k=24)


def test_zero_vector_outranks_negative_scores(spark):
    rows = [(1, "n", [-1.0] * 12), (2, "n", None)]
    result = run(spark, rows, [(1, [1.0] * 12)])
    assert [(r.id, r.score) for r in result.orderBy("rank").collect()] == [(2, 0.0), (1, -12.0)]


def test_not_a_number_ranks_last(spark):
    rows = [(1, "n", [float("nan")] * 12), (2, "n", [-5.0] * 12), (3, "n", [1.0] * 12)]
    result = run(spark, rows, [(1, [1.0] * 12)], n_results=2)
    assert ranked(result) == [(1, 1, 3), (1, 2, 2)]


def test_close_scores_are_told_apart(spark):
    """Differences far below float32 resolution still decide the order."""
    base = np.float32(1.0)
    tiny = np.nextafter(np.float32(1e-4), np.float32(1))
    rows = [(i, "n", [float(base)] * 11 + [float(np.float32(1e-4) if i % 2 else tiny)]) for i in range(100)]
    asked = [(1, [1000.0] * 11 + [1e-3])]
    result = run(spark, rows, asked, n_results=60)
    assert ranked(result) == brute(rows, asked, k=60)


def test_one_row_and_empty_corpus(spark):
    result = run(spark, [(1, "n", [1.0] * 12)], [(1, [1.0] * 12)])
    assert ranked(result) == [(1, 1, 1)]
    result = run(spark, [], [(1, [1.0] * 12)])
    assert ranked(result) == []


def test_no_queries(spark, numbers):
    result = run(spark, numbers[0], [])
    assert ranked(result) == []


def test_unit_vector_finds_itself(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    result = se.search(corpus, asked, ["vec_id"], dim=64, n_results=1, digits=5)
    assert result.count() == corpus.count()
    assert result.where((F.col("score") != 1.0) | (F.col("qid") != F.col("vec_id"))).count() == 0


def test_scored_rows_are_counted(spark, numbers):
    rows, asked = numbers
    scored = Observation()
    run(spark, rows, asked, scored=scored)
    assert scored.get["rows_scored"] == 700


def test_single_query_top_k(spark, numbers):
    rows, asked = numbers
    corpus = spark.createDataFrame(rows, SCHEMA)
    scored = corpus.select("id", se.score_against("embedding", asked[0][1]).alias("score"))
    assert scored.count() == 700
    got = [r.id for r in se.top_k(scored, ["id"]).collect()]
    assert got == [key for _, _, key in brute(rows, asked[:1])]
    assert se.top_k(scored, ["id"], 9999).count() == 700


def test_scores_are_held_by_the_tile():
    """A task holds the scores of some queries at a time, not of all of a block."""
    rng = np.random.default_rng(3)
    rows, asked = (rng.standard_normal((n, 8)).astype(np.float32) for n in (4096, 4000))
    best = ranking.BestRows(asked, np.full(len(asked), 5), ["id"], 5)
    tracemalloc.start()
    best.add(rows, pa.table({"id": np.arange(len(rows))}), np.arange(len(asked)))
    best.settle()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * rows.shape[0] * asked.shape[0]
    scores = np.round(rows.astype(np.float64) @ asked.astype(np.float64).T, 5)
    want = np.lexsort((np.broadcast_to(np.arange(len(rows))[:, None], scores.shape), -scores), axis=0)[:5].T
    assert np.array_equal(np.asarray(best.table["id"]).reshape(-1, 5), want)


@pytest.mark.parametrize("limit", [1, 3, 40, 400])
def test_segments_of_any_length(numbers, monkeypatch, limit):
    """Few or many segments for the results asked for, a last one that is short, scores that are no numbers, all equal or infinite."""
    monkeypatch.setattr(ranking, "SEGMENT_ROWS", 16)
    rows, asked = numbers
    odd = {3: [np.nan] * 12, 17: [np.inf] + [0.0] * 11, 205: [-np.inf] + [1.0] * 11, 206: [3e38] * 12, 300: [0.0] * 12}
    vectors = np.array([odd.get(i, rows[i // 2][2] if 100 < i < 200 else rows[i][2]) for i in range(333)], np.float32)
    queries = np.array([v for _, v in asked] + [[0.0] * 12], np.float32)
    with np.errstate(all="ignore"):
        scores = np.einsum("id,jd->ji", vectors.astype(np.float64), queries.astype(np.float64))
        best = ranking.BestRows(queries, np.full(len(queries), limit), ["id"], 3, tile=1000)
        for start, stop in [(0, 5), (5, 150), (150, 333)]:
            best.add(vectors[start:stop], pa.table({"id": np.arange(start, stop)}), np.arange(len(queries)))
        best.settle()
    scores = np.round(np.where(np.isnan(scores), -np.inf, scores), 3)
    want = [sorted(range(333), key=lambda i: (-own[i], i))[:limit] for own in scores]
    assert np.asarray(best.table["id"]).reshape(len(queries), -1).tolist() == want


def stored_rows(spark, rows):
    path = scratch_path(spark, "stored")
    spark.createDataFrame(rows, SCHEMA).repartition(24).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def test_shares_open_every_file_once(spark, numbers):
    stored = stored_rows(spark, numbers[0])
    shares = se.in_shares(stored, 3)
    assert sorted(r.id for r in shares.collect()) == [key for key, _, _ in numbers[0]]
    assert shares.rdd.getNumPartitions() > stored.rdd.getNumPartitions()
    plan = shares.select("id", "file_path")._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    opened = [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())]
    assert len(opened) == 3 and sum(opened) == len(stored.inputFiles())


def test_many_queries_read_the_corpus_in_shares(spark, numbers, monkeypatch):
    rows, asked = numbers
    monkeypatch.setattr(se, "MANY_QUERIES", 40)
    shares, made = se.in_shares, []
    monkeypatch.setattr(se, "in_shares", lambda *args: made.append(args) or shares(*args))
    scored = Observation()
    queries = spark.createDataFrame(asked, "qid bigint, query_vector array<float>")
    result = se.search(stored_rows(spark, rows), queries, ["id"], dim=12, digits=5, scored=scored)
    assert ranked(result) == brute(rows, asked, digits=5) and scored.get["rows_scored"] == 700 and len(made) == 1
    few = se.search(stored_rows(spark, rows), queries.limit(39), ["id"], dim=12, digits=5)
    assert few.count() == 39 * 5 and len(made) == 1


def mostly_zeros(rng, count, dim, share=0.08):
    made = rng.standard_normal((count, dim)) * (rng.random((count, dim)) < share)
    return made.astype(np.float32)


def test_outlines_are_never_below_the_product():
    rng = np.random.default_rng(5)
    queries, rows = mostly_zeros(rng, 60, 100), mostly_zeros(rng, 80, 100, 0.3)
    rows[0], rows[1], rows[2, 5] = 1e-30, 3e38, np.nan
    outline = ranking.Outline(queries)
    with np.errstate(all="ignore"):
        short = outline.of(queries).astype(np.float64) @ outline.of(rows).astype(np.float64).T
        full = queries.astype(np.float64) @ rows.astype(np.float64).T
    assert outline.of(rows).shape[1] < 50
    assert (~(short < full - 1e-9 * np.abs(full))).all()


@pytest.mark.parametrize("zeros", [True, False])
def test_rows_are_told_apart_by_outlines(monkeypatch, zeros):
    """Few full products where vectors are mostly zeros; where they are not, no more tries than a few. The same rows."""
    monkeypatch.setattr(ranking, "OUTLINED_QUERIES", 64)
    monkeypatch.setattr(ranking, "OPEN_SHARE", 0.15)
    full, left_open = [], []
    for name, calls in (("_candidates", full), ("_left_open", left_open)):
        old = getattr(ranking.BestRows, name)
        monkeypatch.setattr(ranking.BestRows, name, lambda *a, old=old, calls=calls: (calls.append(1), old(*a))[1])
    rng = np.random.default_rng(6)
    rows = mostly_zeros(rng, 6000, 256, 0.03) if zeros else rng.standard_normal((6000, 256)).astype(np.float32)
    queries = np.concatenate([rows[::100][:60], np.zeros((1, 256), np.float32), rows[40:44]])
    rows[3000:3050], rows[5000, 7], rows[5001, 9] = rows[2999], np.nan, np.inf
    best = ranking.BestRows(queries, np.full(len(queries), 5), ["id"], 5)
    with np.errstate(all="ignore"):
        for start in range(0, len(rows), 500):
            best.add(rows[start : start + 500], pa.table({"id": np.arange(start, start + 500)}), np.arange(len(queries)))
            best.settle()
        scores = rows.astype(np.float64) @ queries.astype(np.float64).T
    scores = np.round(np.where(np.isnan(scores), -np.inf, scores), 5)
    want = np.lexsort((np.broadcast_to(np.arange(len(rows))[:, None], scores.shape), -scores), axis=0)[:5].T
    assert np.array_equal(np.asarray(best.table["id"]).reshape(-1, 5), want)
    assert len(left_open) == 12
    assert len(full) <= 4 if zeros else len(full) >= 11


@pytest.mark.parametrize("routed", [True, False])
def test_a_large_block_knows_its_bars_before_most_rows(spark, monkeypatch, routed):
    """Some rows are scored first; what they reach bounds the others, and hits are taken from all."""
    monkeypatch.setattr(se, "MANY_QUERIES", 40)
    monkeypatch.setattr(ranking, "OUTLINED_QUERIES", 40)
    rng = np.random.default_rng(7)
    vectors = mostly_zeros(rng, 1500, 256)
    vectors[700:720] = vectors[3]
    rows = [(i, f"c{i % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    path, schema = scratch_path(spark, "placed"), "id bigint, document_name string, embedding array<float>"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "row_index")]
    stored = spark.read.schema(schema).parquet(path).select("*", *place)
    limits = [int(rng.choice([1, 4, 30, 400])) for _ in range(60)]
    asked = [(i, f"c{i % 3}", rows[(i * 11) % 1500 if i else 3][2], limits[i]) for i in range(60)]
    asked += [(60, "c1", [0.0] * 256, 7), (61, "c1", asked[1][2], 2), (62, "c9", asked[1][2], 2)]
    queries = spark.createDataFrame(asked, "qid bigint, document_name string, query_vector array<float>, n_results int")
    known, old = [], se.last_scores
    monkeypatch.setattr(se, "last_scores", lambda *a: (known.append(old(*a)), known[-1])[1])
    queries = queries if routed else queries.drop("document_name")
    result = se.search(stored, queries, ["id"], dim=256, digits=5)
    found = {}
    for r in result.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.id)
    for qid, name, vector, limit in asked:
        scores = np.round(vectors.astype(np.float64) @ np.asarray(vector, np.float64), 5)
        own = [i for i in range(1500) if not routed or f"c{i % 3}" == name]
        assert found.get(qid, []) == sorted(own, key=lambda i: (-scores[i], i))[:limit]
    assert len(known) == 1 and np.isfinite(known[0]).any() and np.isneginf(known[0]).any()
