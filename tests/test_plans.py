"""The physical plans are the ones meant."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from passagework import catalog as ca
from passagework.operators import chunks as ch
from passagework.operators import search as se
from passagework.plans import ingest as ing
from passagework.sources import corpus as cp


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def simple(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_chunking_has_no_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("source", "document_name")
    assert "Exchange" not in simple(ing.document_chunks(docs))
    assert "Exchange" not in simple(ch.ingest_metrics(docs))
    assert simple(ing.document_chunks(ca.documents(spark, sf_dir))).count("Exchange") == 1  # the small table is dealt out


def test_only_needed_columns_are_scanned(spark, sf_dir):
    text = plan(ing.document_chunks(ca.documents(spark, sf_dir)))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text


def test_length_filter_runs_before_the_encoder_and_text_is_made_once(spark, sf_dir):
    text = simple(ing.embed_chunks(ing.document_chunks(ca.documents(spark, sf_dir))))
    assert text.index("ArrowEvalPython") < text.index("Filter") < text.index("posexplode")
    assert text.count("regexp_replace") == 1
    assert text.count("(?<=[.!?])") == 1


def one_block(spark, corpus, names=("src1",), keys=cp.KEYS):
    schema = "qid bigint, query_vector array<float>, n_results int, document_name string"
    asked = spark.createDataFrame([(i, [0.0] * 768, 5, n) for i, n in enumerate(names)], schema)
    (block,) = se.query_blocks(asked, 768, se.MAX_QUERY_BYTES)
    shared = spark.sparkContext.broadcast((vars(block), block.by_name(), None))
    scan = corpus.where(F.col("document_name").isin(sorted(block.by_name())))
    return se.partial_top_k(scan, shared, keys, "embedding", by="document_name")


def test_search_scans_vectors_not_text(spark, sf_dir):
    corpus = ca.stored_corpus(spark, sf_dir)
    text = plan(one_block(spark, corpus))
    assert "sentence_chunk" not in text and "embedding:array<float>" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert corpus.columns[-2:] == cp.POSITION


def test_search_shuffles_only_the_best_rows(spark, sf_dir):
    partial = one_block(spark, ca.stored_corpus(spark, sf_dir))
    assert "Exchange" not in simple(partial)
    text = simple(se.best_per_query(partial, cp.KEYS, 5))
    assert text.count("Exchange") == 1
    order = [text.index(s) for s in (", Final", "Exchange", ", Partial", "MapInArrow")]
    assert order == sorted(order)


def test_named_corpus_prunes_partitions(spark, sf_dir):
    text = plan(ca.corpus_route(spark, sf_dir))
    assert "PartitionFilters: [isnotnull(document_name" in text and "= src3)]" in text


@pytest.mark.parametrize("more", [0, 1500])
def test_routed_search_prunes_partitions(spark, sf_dir, more):
    corpus = ca.stored_corpus(spark, sf_dir)
    text = plan(one_block(spark, corpus, ["src1", "src2", *(f"other{i}" for i in range(more))]))
    assert "PartitionFilters: [document_name" in text and "src1" in text


def test_opening_a_corpus_runs_no_job(spark, sf_dir):
    ca.stored_corpus(spark, sf_dir)
    root = ca._corpora[(spark.sparkContext.applicationId, sf_dir)]
    jobs = jobs_of(spark, lambda: (cp.open_corpus(spark, root, "src3"), cp.names(spark, root), cp.exists(spark, root, "x")))
    assert jobs == 0


def test_existing_names_are_not_read_from_rows(spark, sf_dir):
    ca.stored_corpus(spark, sf_dir)
    root = ca._corpora[(spark.sparkContext.applicationId, sf_dir)]
    text = plan(cp.only_absent(ca.documents(spark, sf_dir), root))
    assert "documents.parquet" in text and root not in text


def jobs_of(spark, work):
    """How many jobs ``work`` runs."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_preview_and_top_k_do_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in simple(ca.preview(spark, sf_dir))
    assert "TakeOrderedAndProject" in simple(se.top_k(ca.dot_scores(spark, sf_dir), ["vec_id"]))


def test_corpus_is_gathered_before_it_is_encoded(spark, sf_dir):
    chunks = ing.document_chunks(ca.documents(spark, sf_dir)).where(ch.long_enough())
    text = simple(ing.embed_chunks(cp.gather_by_name(chunks)))
    assert text.index("ArrowEvalPython") < text.index("REBALANCE_PARTITIONS_BY_COL")


@pytest.mark.parametrize("name", sorted(ca.queries()))
def test_no_registered_query_pairs_all_rows(spark, sf_dir, name):
    text = simple(ca.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
