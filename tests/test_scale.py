"""Steps whose cost for a row, a file or a task must not grow with the input."""

import glob
import os
import time

import numpy as np
from pyspark.sql import functions as F

from passagework import catalog
from passagework.functions import sentence_model as sm
from passagework.functions import text as tx
from passagework.functions import vectors as vx
from passagework.functions.encoders import HashingEncoder, encode
from passagework.operators import cells as ce
from passagework.operators import pages as pg
from passagework.operators.isolation import IsolatedExtractors, Limits, packed
from passagework.session import scratch_path
from passagework.sources import corpus as cp
from passagework.sources import csv_corpus
from passagework.sources import documents as sd


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_many_files_are_written_by_tasks_and_read_by_few(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = [(f"{i}.txt", f"text {i}") for i in range(64 * cores)] + [("twice.txt", "a"), ("twice.txt", None), (None, "unnamed")]
    inbox = scratch_path(spark, "inbox")
    sd.write_files(spark.createDataFrame(rows, "file string, text string").coalesce(2), inbox)
    assert len([d for d in os.listdir(local(inbox)) if d.startswith("part-")]) <= 2
    monkeypatch.setattr(sd, "FILE_TASKS", 1)
    found = sd.files(spark, inbox, "uploads")
    assert found.rdd.getNumPartitions() <= cores
    held = {r["filename"].removeprefix("file="): bytes(r["content"]) for r in found.collect()}
    assert len(held) == 64 * cores + 2
    assert held["7.txt"] == b"text 7\f" and sorted(held["twice.txt"].split(b"\f")) == [b"", b"", b"a"]
    assert held[sd.UNNAMED_FILE] == b"unnamed\f"


def test_a_filter_on_vectors_does_not_encode_twice(spark):
    texts = spark.createDataFrame([(i, f"word {i}") for i in range(5)], "doc_id bigint, text string")
    found = texts.withColumn("embedding", encode(F.col("text"))).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    plan = found.where("x <> 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_vectors_come_in_parts_and_in_order(spark):
    texts = spark.range(5000).coalesce(1).select("id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("w"), "id")).alias("text"))
    for options in ({}, {"pad_waste": 0.1, "batch_chars": 4096}):
        rows = texts.withColumn("v", encode(F.col("text"), lambda: HashingEncoder(8), **options)).collect()
        expected = HashingEncoder(8).encode([r["text"] or "" for r in rows])
        assert all((r["v"] is None) == (r["id"] % 11 == 0) for r in rows)
        assert all(r["v"] is None or np.array_equal(np.float32(r["v"]), e) for r, e in zip(rows, expected))


def test_a_worker_keeps_few_and_short_words():
    encoder = HashingEncoder(16)
    encoder.encode([" ".join(f"w{i}" for i in range(100_000)), "x" * 100_000])
    assert len(encoder.buckets) <= 1 << 16 and max(map(len, encoder.buckets)) <= 64


def test_float32_rounding_is_that_of_round(spark):
    rng = np.random.default_rng(5)
    numbers = np.concatenate([rng.uniform(-2, 2, 2000), 1 / np.sqrt(np.arange(1, 2000)), np.arange(-300, 300) / 64, [0, 1e-9, 3e8, -1e-7]])
    rows = spark.createDataFrame([(float(np.float32(x)),) for x in numbers] + [(None,)], "x double").select(F.col("x").cast("float"))
    other = rows.where(~vx.round_float32(F.col("x"), 5).eqNullSafe(F.round(F.col("x").cast("double"), 5)))
    assert other.count() == 0


def test_sentence_gaps_are_those_of_the_plain_rule(spark):
    texts = ["A b.  C d!\tE? f", ".  . a", "a.b c .", " x. ", "", "no end", "a.\u00a0b. \x0b c", "!? \n\n?! z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.array_remove(F.split("text", r"(?<=[.!?])\s+", -1), "")
    assert all(a == b for a, b in rows.select(tx.sentences(F.col("text")), plain).collect())


def slow_codec(content):
    def read():
        while content == b"loop":
            time.sleep(0.1)
        if content == b"abort":
            os.abort()
        return f"{os.getppid()} {content.decode()}"

    return [read]


def test_documents_go_on_while_others_hang():
    contents = [b"loop" if i % 3 == 0 else b"abort" if i % 3 == 1 else b"fine" for i in range(12)]
    began = time.monotonic()
    with IsolatedExtractors(packed(slow_codec), Limits(seconds=2, memory_bytes=1 << 30)) as isolated:
        found = dict(isolated.documents(enumerate(contents)))
    assert time.monotonic() - began < 6  # and not 2 seconds for each of four
    errors = {i: pages[0][2] for i, pages in found.items()}
    assert all(errors[i].startswith("no answer in time") for i in range(0, 12, 3))
    assert all(errors[i] == "crashed: SIGABRT" for i in range(1, 12, 3))
    # the codec was loaded once, by the parent of all children
    assert len({found[i][0][1].split()[0] for i in range(2, 12, 3)}) == 1


def test_pages_stay_with_their_documents_when_some_hang(spark):
    rows = [(i, b"loop" if i in (3, 8) else f"text {i}".encode()) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, content binary").coalesce(1)
    made = pg.extract_pages(docs, slow_codec, limits=Limits(seconds=2, memory_bytes=1 << 30)).collect()
    assert sorted(r.doc_id for r in made) == list(range(20))
    assert {r.doc_id for r in made if r.error} == {3, 8}
    assert all(r.text.endswith(f"text {r.doc_id}") for r in made if r.error is None)


def test_rows_are_not_shuffled_by_name_to_find_new_names(spark):
    root = scratch_path(spark, "names")
    spark.createDataFrame([("a", 1)], "document_name string, x int").write.partitionBy("document_name").parquet(root)
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "document_name string, text string")
    new = cp.only_absent(rows, root)
    assert "Exchange hashpartitioning" not in new._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in new.collect()) == ["y", "z"]


def test_a_cell_index_places_few_rows_at_a_time(spark, monkeypatch):
    seen, nearest = spark.sparkContext.accumulator(0), ce.nearest

    def watched(rows, centres):
        seen.add(len(rows) > 1024)
        return nearest(rows, centres)

    monkeypatch.setattr(ce, "nearest", watched)
    rows = spark.range(5000).coalesce(1).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    index = ce.build(rows, scratch_path(spark, "cells"), ["vec_id"], dim=2, cells=4, sample_rows=100)
    assert index.counts.sum() == 5000 and seen.value == 0


def test_a_packed_csv_is_the_same_corpus_in_small_files(spark, monkeypatch):
    monkeypatch.setattr(csv_corpus, "PACKED_ROWS", 10)
    text = F.concat(F.lit('a "quoted"\nline '), F.col("id").cast("string"))
    vector = F.when(F.col("id") % 5 != 0, F.array_repeat(F.lit(0.25), 8).cast("array<float>"))
    columns = {"doc_id": F.col("id"), "page_number": F.lit(1), "chunk_idx": F.lit(0), "sentence_chunk": text, "embedding": vector}
    columns |= {"document_name": F.lit("n"), "filename": F.lit(None).cast("string")}
    columns |= {"chunk_char_count": F.lit(1), "chunk_word_count": F.lit(1), "chunk_token_count": F.lit(1.0)}
    rows = spark.range(45).coalesce(1).select(*(c.alias(n) for n, c in columns.items()))
    plain, packed_path = scratch_path(spark, "plain"), scratch_path(spark, "packed")
    csv_corpus.write(rows, plain)
    csv_corpus.write(rows, packed_path, compression="gzip")
    assert len(glob.glob(f"{local(packed_path)}/*.csv.gz")) == 5
    read = [sorted(map(tuple, csv_corpus.read(spark, p, dim=8).collect()), key=str) for p in (plain, packed_path)]
    assert read[0] == read[1] and len(read[0]) == 45


def test_a_text_in_many_rows_is_written_once(spark):
    """The cells of a CSV corpus come in tasks with few texts each, which Parquet keeps in a dictionary."""
    folder = scratch_path(spark, "texts")
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string"))))
    text = F.concat(F.array_join(words, " "), F.lit("."))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(f"{folder}/documents.parquet")
    out, before = scratch_path(spark, "cells"), spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # all files in one task, as Spark packs them where they are small
    try:
        catalog.csv_roundtrip(spark, folder).write.parquet(out)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    place = spark.read.parquet(out).select("doc_id", F.length("sentence_chunk").alias("n"), F.col("_metadata.file_path").alias("file"))
    held = place.distinct().groupBy("file").agg(F.sum("n").alias("n")).collect()
    assert place.select("doc_id").distinct().count() == 300 and len(held) > 3
    assert max(r["n"] for r in held) < 1 << 20
    assert sum(os.path.getsize(f) for f in glob.glob(f"{local(out)}/*.parquet")) < 2 * sum(r["n"] for r in held)


def test_types_are_judged_behind_the_count(spark):
    pages = spark.createDataFrame([("Mr. Fox met Dr. Owl.  They ran! 12. 7 -- a. b. c",), ("",), (None,)], "text string")
    plan = sm.type_counts(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate")
    assert {r["type"]: (r["stopped"], r["total"]) for r in sm.type_counts(pages).collect()}["mr"] == (1, 1)
    none = spark.createDataFrame([], "type string")
    seen = {r["type"]: r["seen"] for r in sm.followers(pages, none).collect()}
    assert seen == {"fox": 1, "owl": 1, "they": 1, "b": 1, "c": 1}
    known = spark.createDataFrame([("mr",), ("a",)], "type string")
    seen = {r["type"]: r["seen"] for r in sm.followers(pages.union(pages), known).collect()}
    assert seen == {"owl": 2, "they": 2, "c": 2}


def test_fragments_are_those_of_the_plain_rule(spark):
    texts = ["A b.  C d!\tE? f", ".  . a", "a.b c .", " x. ", "", "no end", "!? \n\n?! z...  y.z", "a" * 50_000 + ". b" + ".x" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.filter(F.regexp_extract_all("text", F.lit(r"(?s).*?(?:[.!?]\s+|\z)"), F.lit(0)), lambda part: part != "")
    assert all(a == b for a, b in rows.select(sm.fragments(F.col("text")), plain).collect())
