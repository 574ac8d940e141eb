import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.functions.encoders import AsciiHashingEncoder, HashingEncoder
from passagework.plans.ingest import EmbeddingsFailed, document_chunks, embed_chunks, ingest
from passagework.plans.retrieve import answer, retrieve
from passagework.plans.store import DocumentStore
from passagework.session import scratch_path
from passagework.sources import corpus as cp
from passagework.sources import csv_corpus
from passagework.sources import documents as src

LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 3


@pytest.fixture
def root(spark):
    return scratch_path(spark, "test-corpus")


def names(spark, root):
    return {r.document_name: r["count"] for r in cp.read(spark, root).groupBy("document_name").count().collect()}


def test_create_leaves_existing_corpora_alone(spark, documents, root):
    store = DocumentStore(spark, root)
    first = store.create(documents([("a", LONG)]))
    assert (first.pages, first.chunks, first.kept) == (1, 1, 1)
    second = store.create(documents([("a", LONG + "changed."), ("b", LONG)]))
    assert second.kept == 1
    assert names(spark, root) == {"a": 1, "b": 1}
    assert "changed" not in store.corpus("a").first().sentence_chunk


def test_extend_appends_and_duplicates(spark, documents, root):
    store = DocumentStore(spark, root)
    for _ in range(2):
        store.extend(documents([("a", LONG), ("b", LONG)]))
    assert names(spark, root) == {"a": 2, "b": 2}


def test_rows_stored_twice_stay_two_results(spark, documents, root):
    store = DocumentStore(spark, root)
    for text in (LONG, LONG, LONG.replace("fox", "cat")):
        store.extend(documents([("a", text)]))
    asked = spark.createDataFrame([(1, "fox")], "qid bigint, text string")
    hits = retrieve(store.corpus("a"), asked).orderBy("rank").collect()
    assert [h.rank for h in hits] == [1, 2, 3]
    assert ["fox" in h.sentence_chunk for h in hits] == [True, True, False]


def test_nothing_survives_the_filter(spark, documents, root):
    report = DocumentStore(spark, root).extend(documents([("a", "short"), ("b", "")]))
    assert (report.pages, report.chunks, report.kept) == (2, 1, 0)
    assert "no chunk was long enough" in report.message
    assert names(spark, root) == {}


def test_no_documents_and_nothing_new(spark, documents, root):
    store = DocumentStore(spark, root)
    none = documents([LONG]).where("doc_id < 0")
    assert store.extend(none).kept == 0
    stored = scratch_path(spark, "docs")
    documents([("a", LONG), ("b", LONG)]).write.parquet(stored)
    docs = spark.read.parquet(stored)
    assert [store.create(docs).kept for _ in range(2)] == [2, 0]
    assert names(spark, root) == {"a": 1, "b": 1}


def test_wide_input_takes_the_rebalanced_path(spark, documents, root):
    rows = [("hot" if i % 3 else f"n{i % 7}", LONG + f"Number {i}.") for i in range(300)]
    narrow, wide = documents(rows).coalesce(1), documents(rows).repartition(32, "doc_id")
    tables = []
    for part, docs in enumerate((narrow, wide)):
        ingest(docs, f"{root}/{part}")
        tables.append(cp.read(spark, f"{root}/{part}").drop(*cp.POSITION).orderBy("doc_id").collect())
    assert tables[0] == tables[1] and len(tables[0]) == 300


def test_missing_corpora(spark, documents, root):
    store = DocumentStore(spark, root)
    with pytest.raises(cp.CorpusNotFound):
        store.ask("x", "a")
    report = store.extend(documents([("a", LONG)]))
    assert report.message == "1 pages processed, 1 embeddings saved"
    with pytest.raises(cp.CorpusNotFound):
        store.ask("x", "b")
    with pytest.raises(ValueError):
        store.ask("x", "")
    with pytest.raises(ValueError):
        store.ask_many(spark.createDataFrame([(1, "x", None)], "qid bigint, text string, document_name string"))


@pytest.mark.parametrize("name", ["2024", "007", "a b/c=d%e", "Ünï", "x'y\"z", "a.b"])
def test_corpus_names_are_plain_strings(spark, documents, root, name):
    store = DocumentStore(spark, root)
    store.extend(documents([(name, LONG), ("other", LONG)]))
    assert names(spark, root) == {name: 1, "other": 1}
    assert [r.document_name for r in store.corpus(name).collect()] == [name]
    row = store.ask("lazy dog", name).first()
    assert row.query == "lazy dog" and "- The quick brown fox" in row.results


def test_one_chunk_corpus_and_more_results_than_chunks(spark, documents, root):
    store = DocumentStore(spark, root)
    store.extend(documents([("a", LONG)]))
    row = store.ask("dog", "a", n_results=50, template="{context}").first()
    assert row.results.count("- ") == 1


def test_ask_many_answers_from_the_named_corpus(spark, documents, root):
    store = DocumentStore(spark, root)
    store.extend(documents([("a", LONG), ("b", LONG.replace("fox", "cat"))]))
    schema = "qid bigint, text string, document_name string"
    requests = spark.createDataFrame([(1, "dog", "a"), (2, "dog", "b")], schema)
    got = {r.qid: r.results for r in store.ask_many(requests, template="{context}").collect()}
    assert "fox" in got[1] and "cat" not in got[1]
    assert "cat" in got[2] and "fox" not in got[2]
    with pytest.raises(cp.CorpusNotFound, match="nowhere"):
        store.ask_many(spark.createDataFrame([(1, "dog", "a"), (3, "dog", "nowhere")], schema))


def test_failed_embeddings_stay_with_score_zero(spark, documents, root):
    store = DocumentStore(spark, root, factory=AsciiHashingEncoder)
    store.extend(documents([("a", LONG), ("a", LONG + "Schön war es.")]))
    asked = spark.createDataFrame([(1, "fox")], "qid bigint, text string")
    hits = retrieve(store.corpus("a"), asked, factory=AsciiHashingEncoder).orderBy("rank").collect()
    assert [(h.doc_id, h.score > 0) for h in hits] == [(1, True), (2, False)]
    assert hits[1].score == 0


def test_same_answers_without_a_stored_table(spark, documents, root):
    docs = documents([("a", LONG + f"Word{i} appears here.") for i in range(30)])
    asked = spark.createDataFrame([(1, "word7 appears"), (2, "word21")], "qid bigint, text string")
    DocumentStore(spark, root).extend(docs)
    in_plan = embed_chunks(document_chunks(docs))
    columns = ["qid", "rank", "doc_id", "sentence_chunk", "score"]
    got = [retrieve(c, asked).select(*columns).orderBy("qid", "rank").collect() for c in (in_plan, cp.read(spark, root))]
    assert got[0] == got[1] and len(got[0]) == 10


def test_winners_are_read_from_their_own_files(spark, documents, root):
    store = DocumentStore(spark, root)
    for i in range(6):
        store.extend(documents([("a", LONG + f"Word{i} appears here.")]))
    asked = spark.createDataFrame([(1, "word3")], "qid bigint, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # to see the plan's metrics
    try:
        hits = retrieve(store.corpus("a"), asked, n_results=1)
        assert "Word3" in hits.collect()[0].sentence_chunk
        leaves = hits._jdf.queryExecution().executedPlan().collectLeaves()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [leaves.apply(i) for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]
    read = [s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles")]
    assert len(read) == 2 and 1 in read and 6 not in read  # of the corpus one of its six files, and the hits


def test_missing_text_and_names_are_set_aside(spark, documents, root):
    docs = documents([("a", LONG), ("a", None), ("", LONG), (None, LONG), ("a", LONG)])
    store = DocumentStore(spark, root)
    for _ in range(2):
        report = store.create(docs)
    assert (report.pages, report.kept, report.set_aside) == (0, 0, 2)
    assert "2 documents or pages set aside" in report.message
    assert names(spark, root) == {"a": 2}
    found = sorted((r.doc_id, r.reason) for r in cp.quarantine(spark, root).collect())
    assert found == [(2, "text is missing"), *[(3, "document name is missing")] * 2, *[(4, "document name is missing")] * 2]


def test_nothing_is_set_aside(spark, documents, root):
    DocumentStore(spark, root).extend(documents([("a", LONG)]))
    assert cp.quarantine(spark, root).count() == 0


class Broken:
    dim = 768

    def encode(self, texts):
        raise OSError("no model here")


def test_a_broken_model_is_reported(spark, documents, root):
    report = DocumentStore(spark, root, factory=Broken).extend(documents([("a", LONG), ("a", LONG)]))
    assert (report.kept, report.saved, report.failed_embeddings) == (2, 0, 2)
    assert report.message == "2 pages processed, 0 embeddings saved, 2 embeddings failed, for one: OSError: no model here"
    with pytest.raises(EmbeddingsFailed, match="no model here"):
        DocumentStore(spark, root, factory=Broken).extend(documents([("a", LONG)]), tolerated=0.5)


def picky_pages(content):
    if content.startswith(b"!"):
        raise OSError("cannot open")
    for page in content.split(b"\f"):
        yield lambda page=page: page.decode("ascii")


def test_files_through_an_extractor(spark, root, tmp_path):
    (tmp_path / "a.txt").write_bytes(LONG.encode() + b"\f\xff\f" + LONG.encode())
    (tmp_path / "b.txt").write_bytes(b"!" + LONG.encode())
    report = DocumentStore(spark, root).extend(src.files(spark, str(tmp_path), "uploads"), extractor=picky_pages)
    assert (report.pages, report.kept, report.set_aside) == (2, 2, 2)
    rows = cp.open_corpus(spark, root, "uploads").collect()
    assert sorted((r.filename, r.page_number) for r in rows) == [("a.txt", 1), ("a.txt", 3)]
    aside = sorted((r.filename, r.page_number or 0, r.reason.split(":")[0]) for r in cp.quarantine(spark, root).collect())
    assert aside == [("a.txt", 2, "UnicodeDecodeError"), ("b.txt", 0, "OSError")]


def test_options_reach_the_chunks(spark, documents, root):
    DocumentStore(spark, root).extend(documents([("a", LONG)]), joiner=" | ", batch_size=1)
    assert " | " in cp.open_corpus(spark, root, "a").first().sentence_chunk


def test_upstream_work_runs_once_and_settings_stay(spark, documents, root):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def touched(text):
        counted.add(1)
        return text

    grouped = documents([(f"n{i % 3}", LONG) for i in range(40)]).groupBy("doc_id", "document_name").agg(F.max("text").alias("text"))
    stored = scratch_path(spark, "docs")
    grouped.write.parquet(stored)
    upstream = spark.read.parquet(stored).groupBy("doc_id", "document_name").agg(F.max("text").alias("text"))
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    ingest(upstream.withColumn("text", touched.asNondeterministic()("text")), root)
    after = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert counted.value == 40 and before == after


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a table, 100%")
    spark.range(1000).coalesce(2).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert src.spread(spark.read.parquet(path), path).rdd.getNumPartitions() == cores
    monkeypatch.setattr(src, "SPREAD_BYTES", 10)
    scan = spark.read.parquet(path)
    assert src.spread(scan, path) is scan
    monkeypatch.undo()
    many = str(tmp_path / "many")
    spark.range(1000).repartition(cores).write.parquet(many)
    scan = spark.read.parquet(many)
    assert src.spread(scan, many) is scan


CELLS = ['say "hi", twice', "a,b", " lead and trail ", "back\\slash \\\"", "'", "line\nbreak", "tab\t", "é😀", "#no", '"']


@pytest.mark.parametrize("zeros", [True, False])
def test_csv_keeps_texts(spark, zeros):
    texts = [*CELLS, "carriage\rreturn", 'ends with a quote"', '"', '"\n"', "\n", "\r\n", "a\r\nb", "tail\r"]
    rows = [("n,m", i, 1, 0, t, len(t), 1, len(t) / 4, [0.5, -1e-7, 0.1], f"f{i}\n.txt") for i, t in enumerate(texts)]
    rows.append(("o", 99, 1, 0, "no vector", 9, 2, 2.25, None, None))
    schema = csv_corpus.CSV_SCHEMA.replace("embedding string", "embedding array<float>")
    path = scratch_path(spark, "csv")
    csv_corpus.write(spark.createDataFrame(rows, schema), path)
    back = csv_corpus.read(spark, path, dim=3, missing_as_zeros=zeros).orderBy("doc_id").collect()
    assert [(r.document_name, r.sentence_chunk, r.filename) for r in back] == [(r[0], r[4], r[9]) for r in rows]
    vector = np.array([0.5, -1e-7, 0.1], np.float32).tolist()
    assert [r.embedding for r in back] == [vector] * len(texts) + [[0.0] * 3 if zeros else None]
    assert csv_corpus.read(spark, path, dim=3).select("doc_id").count() == len(rows)


def test_csv_from_pandas(spark, tmp_path):
    """A bare corpus file, as a data-frame library writes it, without lineage columns."""
    vectors = HashingEncoder(8).encode(["a b", "c"])
    table = pd.DataFrame(
        {
            "page_number": [1, 2, 3],
            "sentence_chunk": ['He said "x, y". Bye.', "plain", "failed"],
            "chunk_char_count": [20, 5, 6],
            "chunk_word_count": [5, 1, 1],
            "chunk_token_count": [5.0, 1.25, 1.5],
            "embedding": [*(" ".join(map(str, v)) for v in vectors), None],
        }
    )
    path = tmp_path / "corpus.csv"
    table.to_csv(path, index=False, encoding="utf-8")
    table.to_csv(path, mode="a", index=False, header=False, encoding="utf-8")
    got = csv_corpus.read(spark, str(path), schema=csv_corpus.BARE_CSV_SCHEMA, dim=8)
    assert got.count() == 6
    rows = got.where("page_number <= 2").orderBy("page_number").collect()
    assert rows[0].sentence_chunk == 'He said "x, y". Bye.'
    assert rows[0].embedding == vectors[0].tolist() and rows[2].embedding == vectors[1].tolist()
    assert got.where("page_number = 3").first().embedding == [0.0] * 8


@pytest.mark.parametrize("bad", [0, 7])
def test_ingest_reads_documents_once(spark, root, bad):
    """Clean documents pass the steps before once; only to set some aside are they read again."""
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = [(i, "a" if i >= bad else None, LONG) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, document_name string, text string").mapInArrow(
        counted, "doc_id bigint, document_name string, text string"
    )
    report = ingest(docs, root)
    assert (report.pages, report.kept, report.set_aside) == (100 - bad, 100 - bad, bad)
    assert passed.value == (200 if bad else 100)
    assert cp.quarantine(spark, root).count() == bad


@pytest.mark.parametrize("most", [1000, 2])
def test_unknown_names_are_found(spark, documents, root, monkeypatch, most):
    monkeypatch.setattr(cp, "LOOKED_UP", most)
    ingest(documents([(n, LONG) for n in ("a", "b", "c/d %", "e")]), root)

    def asked(*names):
        return spark.createDataFrame([(n,) for n in names], "document_name string")

    assert cp.first_unknown(asked("a", "b", "c/d %", "a", "e"), root) is None
    assert cp.first_unknown(asked("a", "z", "b", "x", "e"), root) == "x"
    assert cp.first_unknown(asked("a", None, "x", "e"), root) == ""


def test_preview_is_in_key_order(spark, documents):
    made = document_chunks(documents(["b. c", "a", "d"]), size=1)
    got = cp.preview(made, 3).collect()
    assert [(r.doc_id, r.chunk_idx) for r in got] == [(1, 0), (1, 1), (2, 0)]


def test_hot_name_is_split_over_tasks(spark, documents):
    """A name with nearly all rows must not end up in one task."""
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("document_name"),
        F.sha2(F.col("id").cast("string"), 512).alias("sentence_chunk"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        gathered = cp.gather_by_name(rows.repartition(16, "doc_id"))
        tasks = gathered.select("document_name", "sentence_chunk", F.spark_partition_id().alias("task")).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    hot = tasks[tasks.document_name == "hot"].groupby("task").size()
    assert hot.sum() == 58_800 and len(hot) >= 8
