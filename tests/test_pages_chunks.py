import gzip
import re

import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from passagework.catalog import line_pages
from passagework.operators import chunks as ch
from passagework.operators import pages as pg
from passagework.plans import ingest as ing
from passagework.sources import documents as src


def python_chunks(text, separator, size=10):
    """The rules once more, in plain Python."""
    for number, raw in enumerate(text.split(separator), 1):
        page = raw.replace("\n", " ").strip()
        found = [s for s in re.split(r"(?<=[.!?])\s+", page) if s]
        for idx, start in enumerate(range(0, len(found), size)):
            joined = "".join(found[start : start + size]).replace("  ", " ").strip()
            yield number, idx, re.sub(r"\.([A-Z])", r". \1", joined)


@pytest.mark.parametrize("separator", ["\n", "\f"])
def test_whole_corpus_against_python(spark, sf_dir, separator):
    docs = src.text_table(spark, f"{sf_dir}/documents.parquet")
    made = ing.document_chunks(docs, page_sep=separator)
    got = sorted(tuple(r) for r in made.select("doc_id", "page_number", "chunk_idx", "sentence_chunk").collect())
    want = sorted((r.doc_id, *c) for r in docs.collect() for c in python_chunks(r.text, separator))
    assert got == want


def test_groups_give_back_the_sentences(spark, sf_dir):
    pages = ch.with_sentence_groups(ch.with_sentences(line_pages(spark, sf_dir)))
    assert pages.where(F.flatten("sentence_chunks") != F.col("sentences")).isEmpty()
    total = pages.agg(F.sum("num_chunks")).first()[0]
    assert total == ch.explode_chunks(pages).count()


def test_page_numbers_and_empty_pages(spark, documents):
    pages = pg.split_pages(documents(["a\f\fb. C", ""]), page_sep="\f")
    assert [(r.doc_id, r.page_number, r.text) for r in pages.orderBy("doc_id", "page_number").collect()] == [
        (1, 1, "a"), (1, 2, ""), (1, 3, "b. C"), (2, 1, ""),
    ]
    grouped = ch.with_sentence_groups(ch.with_sentences(pages))
    assert [r.num_chunks for r in grouped.orderBy("doc_id", "page_number").collect()] == [1, 0, 1, 0]
    assert ch.explode_chunks(grouped).count() == 2


@pytest.mark.parametrize("separator", ["|", ".", "--", "[p]", "\f"])
def test_separator_is_literal(spark, documents, separator):
    pages = pg.split_pages(documents([f"a{separator}b{separator}"]), page_sep=separator)
    assert [r.text for r in pages.orderBy("page_number").collect()] == ["a", "b", ""]


def test_length_filter_is_strict(spark, documents):
    kept = ing.document_chunks(documents(["x" * 120, "x" * 121])).where(ch.long_enough())
    assert [r.chunk_char_count for r in kept.collect()] == [121]


def test_plugged_in_splitter(spark, documents):
    @F.pandas_udf("array<string>")
    def by_semicolon(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s for s in t.split(";") if s])

    made = ing.document_chunks(documents(["a;b;c"]), size=2, splitter=by_semicolon)
    assert [r.sentence_chunk for r in made.orderBy("chunk_idx").collect()] == ["ab", "c"]


def test_metrics(spark, documents):
    docs = documents(["One. Two.\f\f" + "x" * 200, ""])
    got = ch.ingest_metrics(docs, size=1).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 3, 3, 3, 1), (2, 1, 0, 0, 0)]


def contents(spark, rows):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows, 1)], "doc_id bigint, content binary")


def test_failing_page_costs_that_page_only(spark):
    got = pg.extract_pages(contents(spark, [b"one \n\xff\n three"]), pg.ascii_pages)
    assert [(r.page_number, r.text) for r in pg.readable(got).orderBy("page_number").collect()] == [
        (1, "one"), (3, "three"),
    ]
    assert [(r.page_number, r.error.split(":")[0]) for r in pg.quarantined(got).collect()] == [(2, "UnicodeDecodeError")]


def picky(content):
    if content.startswith(b"!"):
        raise OSError("cannot open")
    return pg.ascii_pages(content)


def test_document_that_cannot_be_opened(spark):
    docs = contents(spark, [b"fine", b"!bad"])
    with pytest.raises(PythonException, match="cannot open"):
        pg.extract_pages(docs, picky).collect()
    got = pg.extract_pages(docs, picky, on_document_error="quarantine")
    assert [(r.doc_id, r.text) for r in pg.readable(got).collect()] == [(1, "fine")]
    assert [(r.doc_id, r.page_number, r.error) for r in pg.quarantined(got).collect()] == [(2, None, "OSError: cannot open")]
    with pytest.raises(ValueError):
        pg.extract_pages(docs, picky, on_document_error="ignore")


def test_many_pages_of_one_document(spark):
    got = pg.extract_pages(contents(spark, [b"\n".join(b"p%d" % i for i in range(5000))]), pg.ascii_pages)
    assert got.count() == 5000
    assert got.agg(F.max("page_number")).first()[0] == 5000


def test_files_as_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One. Two.\fThree — four.", encoding="utf-8")
    (tmp_path / "in" / "b.md").write_text("skipped")
    docs = src.decode_text(src.files(spark, str(tmp_path / "in"), "notes", glob="*.txt"))
    pages = pg.split_pages(docs).orderBy("page_number").collect()
    assert [(r.filename, r.document_name, r.page_number, r.text) for r in pages] == [
        ("a.txt", "notes", 1, "One. Two."), ("a.txt", "notes", 2, "Three — four."),
    ]


def test_checked_pages(spark):
    docs = spark.createDataFrame([(1, "one\nzwölf\nthree"), (2, "")], "doc_id bigint, text string")
    rows = pg.checked_pages(docs, r"[^\x00-\x7F]", "outside ASCII", page_sep="\n").orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.page_number, r.text, r.error) for r in rows] == [
        (1, 1, "one", None), (1, 2, None, "outside ASCII"), (1, 3, "three", None), (2, 1, "", None),
    ]


def test_missing_text_is_set_aside(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    good, bad = src.quarantine_missing(docs)
    assert [r.doc_id for r in good.collect()] == [1]
    assert [(r.doc_id, r.reason) for r in bad.collect()] == [(2, "text is missing")]


@pytest.mark.parametrize("glob", [None, "*.{txt,gz}", "[!a]*"])
def test_files_are_those_that_spark_reads(spark, tmp_path, glob):
    """Listed by tasks and not by the driver: the same files, paths and bytes, hidden and empty ones left out alike."""
    names = ["a.txt", "b c%41.txt", "deep/er/é=1.txt", "_x.txt", "_y=1.txt", ".z.txt", "_temporary/t.txt", "empty.txt"]
    names += ["deep/w._COPYING_", ".hidden/h.txt", "zip.txt.gz", "deep/_metadata.txt", "_metadata/n.txt", "k=1/l=2/m.txt"]
    inbox = tmp_path / "in box%20"
    for name in names:
        path = inbox / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(b"packed") if name.endswith("gz") else b"" if name == "empty.txt" else name.encode() + b"\xff\r\n")
    (inbox / "no files").mkdir()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    want = sorted((r["path"], bytes(r["content"])) for r in reader.load(str(inbox)).collect())
    found = src.files(spark, str(inbox), "n", glob)
    rows = found.collect()
    assert sorted((r["path"], bytes(r["content"])) for r in rows) == want and len(want) > 4
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["filename"] == r["path"].split("/")[-1] for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "below" in plan
    assert src.files(spark, str(inbox / "no files"), "n").count() == 0
    # a pattern and a single file are read by Spark
    assert src.files(spark, f"{tmp_path}/in box*/*.txt", "n").count() > 0
    assert src.files(spark, str(inbox / "a.txt"), "n").first()["content"] == b"a.txt\xff\r\n"


def test_more_files_than_a_task_reads_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "READ_FILES", 7)
    monkeypatch.setattr(src, "READ_BYTES", 40)
    for i in range(200):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i}.txt").write_text("x" * (1 + i % 50))
    found = src.files(spark, str(tmp_path), "n")
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r["filename"]: len(r["content"]) for r in found.collect()} == {f"{i}.txt": 1 + i % 50 for i in range(200)}
