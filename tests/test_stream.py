import datetime

import pytest
from pyspark.sql import functions as F

from passagework.operators import chunks as ch
from passagework.operators import pages as pg
from passagework.plans.ingest import IngestOptions, document_chunks, embed_chunks, ingest
from passagework.plans.retrieve import retrieve
from passagework.session import scratch_path
from passagework.sources import corpus as cp
from passagework.streaming import ingest as streaming
from passagework.functions.encoders import AsciiHashingEncoder
from passagework.streaming.ingest import corpus_stream, document_stream, ingest_stream, stream_reports
from passagework.streaming.uploads import new_uploads

LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 3
SCHEMA = "doc_id bigint, document_name string, text string"


def kept_chunks(docs):
    return ch.create_chunks(pg.split_pages(docs.select("doc_id", "text"), page_sep="\n")).where(ch.long_enough())


def test_stream_equals_batch_and_runs_once(spark, sf_dir):
    inbox, root, checkpoint = (scratch_path(spark, x) for x in ("inbox", "out", "state"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second = docs.where("lang = 'en'"), docs.where("lang <> 'en'")

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(inbox)
        run()

    def run():
        ingest_stream(document_stream(spark, inbox), kept_chunks, root, checkpoint).awaitTermination()

    arrive(first)
    assert spark.read.parquet(root).count() == kept_chunks(first).count()
    arrive(second)
    want = sorted(tuple(r) for r in kept_chunks(docs).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(root).collect()) == want
    run()
    assert spark.read.parquet(root).count() == len(want)


def test_streamed_corpus_can_be_searched(spark, sf_dir):
    inbox, root, checkpoint = (scratch_path(spark, x) for x in ("inbox", "corpus", "state"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", F.col("source").alias("document_name"), "text")
    docs.repartition(3).write.parquet(inbox)
    arriving = document_stream(spark, inbox, schema=SCHEMA, max_files_per_trigger=1)
    corpus_stream(arriving, root, checkpoint).awaitTermination()
    asked = spark.createDataFrame([(1, "the worthless hand of that"), (2, "le la des")], "qid bigint, text string")
    columns = ["qid", "rank", "doc_id", "chunk_idx", "score", "sentence_chunk"]
    batch = embed_chunks(document_chunks(docs))
    got, want = (
        retrieve(c, asked, digits=5).select(*columns).orderBy("qid", "rank").collect()
        for c in (cp.read(spark, root), batch)
    )
    assert got == want and len(got) == 10


def test_batch_stream_and_batch_share_a_corpus(spark, sf_dir):
    inbox, root, checkpoint = (scratch_path(spark, x) for x in ("inbox", "corpus", "state"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("document_name"), "text")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1"), docs.where("doc_id % 3 = 2")]
    kept = [embed_chunks(document_chunks(p)).count() for p in parts]

    def run():
        corpus_stream(document_stream(spark, inbox, schema=SCHEMA), root, checkpoint).awaitTermination()
        return cp.read(spark, root).count()

    ingest(parts[0], root)
    parts[1].coalesce(1).write.parquet(inbox)
    assert run() == kept[0] + kept[1]
    ingest(parts[2], root)
    assert run() == sum(kept)  # a stream that starts again adds nothing
    missing = spark.createDataFrame([(-1, "en", None), (-2, None, "x")], SCHEMA)
    missing.coalesce(1).write.mode("append").parquet(inbox)
    assert run() == sum(kept) and cp.quarantine(spark, root).count() == 2


@pytest.mark.parametrize("stop_after", ["store_documents", "publish", "none"])
def test_a_batch_that_is_tried_again_adds_nothing(spark, documents, monkeypatch, stop_after):
    root, checkpoint = (scratch_path(spark, x) for x in ("corpus", "state"))
    docs = documents([("a", LONG), ("b", LONG), ("c", None)])

    def cut_short(work):
        def run(*args, **options):
            work(*args, **options)
            raise OSError("lost")

        return run

    if stop_after != "none":
        with monkeypatch.context() as patched:
            patched.setattr(streaming, stop_after, cut_short(getattr(streaming, stop_after)))
            with pytest.raises(OSError, match="lost"):
                streaming.store_batch(docs, 7, root, checkpoint, IngestOptions())
    for _ in range(2):
        streaming.store_batch(docs, 7, root, checkpoint, IngestOptions())
    assert sorted(r.document_name for r in cp.read(spark, root).collect()) == ["a", "b"]
    assert cp.quarantine(spark, root).count() == 1
    streaming.store_batch(docs, 8, root, checkpoint, IngestOptions())
    assert cp.read(spark, root).count() == 4


def test_readers_see_whole_batches_only(spark, documents, monkeypatch):
    """A publish that stops half-way shows nothing; tried again, it shows all."""
    root, checkpoint = (scratch_path(spark, x) for x in ("corpus", "state"))
    names = [(f"n{i}", LONG) for i in range(6)]
    ingest(documents([("old", LONG)]), root)
    streaming.store_batch(documents(names[:2]), 0, root, checkpoint, IngestOptions())
    before = cp.read(spark, root)
    assert {r.document_name for r in before.collect()} == {"old", "n0", "n1"}
    moved, real = [], streaming.files_of

    def stopping(session, name):
        if "/rows" not in name and "document_name=" in name:
            moved.append(name)
            if len(moved) == 3:
                raise OSError("lost")
        return real(session, name)

    with monkeypatch.context() as patched:
        patched.setattr(streaming, "files_of", stopping)
        with pytest.raises(OSError, match="lost"):
            streaming.store_batch(documents(names), 1, root, checkpoint, IngestOptions())
    assert cp.read(spark, root).count() == 3 and cp.open_corpus(spark, root, "old").count() == 1
    streaming.store_batch(documents(names), 1, root, checkpoint, IngestOptions())
    assert cp.read(spark, root).count() == 9
    other = scratch_path(spark, "other-state")
    streaming.store_batch(documents(names[:1]), 0, root, other, IngestOptions())
    assert cp.read(spark, root).count() == 10 and len(cp.announced(spark, root)) == 2
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_streams")
    listed = files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)
    assert len(listed) == 2


def test_a_stream_reports_its_batches(spark, documents):
    inbox, root, checkpoint = (scratch_path(spark, x) for x in ("inbox", "corpus", "state"))
    assert stream_reports(spark, checkpoint).count() == 0
    for texts in ([("a", LONG), ("b", LONG), ("c", None)], [("a", LONG.replace("fox", "f\u00f6x"))]):
        documents(texts).coalesce(1).write.mode("append").parquet(inbox)
        corpus_stream(document_stream(spark, inbox, schema=SCHEMA), root, checkpoint, factory=AsciiHashingEncoder).awaitTermination()
    told = [tuple(r)[:6] for r in stream_reports(spark, checkpoint).orderBy("batch").collect()]
    assert told == [(0, 2, 2, 2, 1, 0), (1, 1, 1, 1, 0, 1)]
    documents([("d", LONG + "\u00e9")]).coalesce(1).write.mode("append").parquet(inbox)
    query = corpus_stream(document_stream(spark, inbox, schema=SCHEMA), root, checkpoint, tolerated=0.5, factory=AsciiHashingEncoder)
    with pytest.raises(Exception, match="embeddings failed"):
        query.awaitTermination()


UPLOADS = "doc_id bigint, document_name string, text string, arrived timestamp"


def test_uploads_that_come_again(spark):
    """Over restarts: a repeat is dropped, a change is marked, and what was not seen for long is new."""
    inbox, out, checkpoint = (scratch_path(spark, x) for x in ("inbox", "out", "state"))

    def at(day):
        return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=day)

    def arrive(*rows):
        spark.createDataFrame([(i, n, t, at(d)) for i, n, t, d in rows], UPLOADS).coalesce(1).write.mode("append").parquet(inbox)
        before = {tuple(r) for r in spark.read.schema(seen).parquet(out).collect()} if done else set()
        found = new_uploads(spark.readStream.schema(UPLOADS).parquet(inbox), delay="1 day", remember_days=10)
        found = found.select("doc_id", "document_name", "text", F.dayofyear("arrived").alias("day"), "change")
        writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        done.append(1)
        return {tuple(r) for r in spark.read.schema(seen).parquet(out).collect()} - before

    seen, done = "doc_id bigint, document_name string, text string, day int, change string", []
    first = arrive((1, "a", "x", 0), (1, "b", "x", 0), (2, "a", None, 0), (3, "a", "", 0), (3, "a", "", 0))
    assert {(r[0], r[1], r[4]) for r in first} == {(1, "a", "new"), (1, "b", "new"), (2, "a", "new"), (3, "a", "new")}
    again = arrive((1, "a", "x", 1), (1, "b", "y", 1), (2, "a", "", 1), (3, "a", "", 2))
    assert {(r[0], r[1], r[2], r[4]) for r in again} == {(1, "b", "y", "changed"), (2, "a", "", "changed")}
    assert arrive((1, "a", "x", 9), (9, "a", "later", 9)) == {(9, "a", "later", 10, "new")}  # seen again in time
    assert arrive((3, "a", "", 2), (9, "a", "later", 9)) == set()  # too late to be looked at, and a repeat
    assert {(r[0], r[1], r[4]) for r in arrive((1, "b", "y", 30), (1, "a", "z", 31))} == {(1, "b", "new"), (1, "a", "new")}
    assert {(r[0], r[4]) for r in arrive((3, "a", "", 32), (3, "a", "w", 33))} == {(3, "new"), (3, "changed")}
