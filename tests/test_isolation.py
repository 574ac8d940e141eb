"""Codecs that crash, hang or take all memory cost the guilty page and nothing else."""

import os
import time

import pytest

from passagework.operators import pages as pg
from passagework.operators.isolation import IsolatedExtractor, Limits, packed
from passagework.plans.ingest import ingest
from passagework.session import scratch_path
from passagework.sources import corpus as cp

QUICK = Limits(seconds=2, memory_bytes=1 << 30)


def codec(content):
    """A page for each line; what a line says is done."""

    def read(line):
        if line == b"abort":
            os.abort()
        if line == b"exit":
            os._exit(3)
        while line == b"loop":
            time.sleep(0.1)
        if line == b"memory":
            return str(bytearray(1 << 40))
        if line == b"raise":
            raise ValueError("no text")
        if line == b"print":
            print("to the output", flush=True)
        return line.decode()

    for line in content.split(b"\n"):
        if line == b"stop":
            os.abort()  # between two pages
        yield lambda line=line: read(line)


def opened(content):
    if content == b"bad":
        os.abort()
    if content == b"refused":
        raise KeyError("no document")
    return codec(content)


def test_only_the_guilty_page_is_lost():
    content = b"one\nabort\ntwo\nloop\nmemory\nthree\nraise\nexit\nprint\nlast"
    with IsolatedExtractor(packed(codec), QUICK) as isolated:
        pages = list(isolated.pages(content))
        again = list(isolated.pages(b"a\nb"))
    assert [(n, t) for n, t, e in pages if e is None] == [(1, "one"), (3, "two"), (6, "three"), (9, "print"), (10, "last")]
    errors = {n: e for n, _, e in pages if e}
    assert errors[2] == "crashed: SIGABRT" and errors[4].startswith("no answer in time") and errors[8] == "crashed: exit code 3"
    assert errors[5].startswith("MemoryError") and errors[7] == "ValueError: no text"
    assert again == [(1, "a", None), (2, "b", None)]
    assert isolated.started == 4  # the first child, and one behind every crash


def test_a_crash_between_pages_is_one_of_the_document():
    with IsolatedExtractor(packed(codec), QUICK) as isolated:
        assert list(isolated.pages(b"one\ntwo\nstop\nnever")) == [(1, "one", None), (2, "two", None), (None, None, "crashed: SIGABRT")]


def test_documents_that_cannot_be_opened():
    with IsolatedExtractor(packed(opened), QUICK) as isolated:
        assert list(isolated.pages(b"bad")) == [(None, None, "crashed: SIGABRT")]
        assert list(isolated.pages(b"refused")) == [(None, None, "KeyError: 'no document'")]
        assert list(isolated.pages(b"fine")) == [(1, "fine", None)]


def test_large_pages_and_documents_pass():
    with IsolatedExtractor(packed(codec), QUICK) as isolated:
        content = b"\n".join([b"x" * 3_000_000, b"", b"y" * 5])
        assert [len(t) for _, t, _ in isolated.pages(content)] == [3_000_000, 0, 5]


def test_no_child_is_left_behind():
    with IsolatedExtractor(packed(codec), QUICK) as isolated:
        pages = isolated.pages(b"a\nb\nc")
        next(pages)
        child = isolated.child
    assert child.poll() is not None


def test_extract_pages_with_limits_equals_without(spark):
    rows = [(i, f"line {i}\nraise\nlast".encode()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, content binary").repartition(4)
    plain = sorted(map(tuple, pg.extract_pages(docs, codec).collect()), key=str)
    assert sorted(map(tuple, pg.extract_pages(docs, codec, limits=QUICK).collect()), key=str) == plain
    assert len(plain) == 120


def test_extract_pages_keeps_what_is_not_guilty(spark):
    rows = [(i, b"first\n" + (b"abort" if i % 9 == 0 else b"second") + b"\nthird") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, content binary").repartition(3)
    made = pg.extract_pages(docs, codec, limits=QUICK).collect()
    assert len(made) == 120
    assert {(r.doc_id, r.page_number) for r in made if r.error} == {(i, 2) for i in range(0, 40, 9)}
    assert all(r.text is None for r in made if r.error)


def test_documents_that_crash_fail_the_job_or_are_set_aside(spark):
    docs = spark.createDataFrame([(1, b"bad"), (2, b"fine")], "doc_id bigint, content binary")
    with pytest.raises(Exception, match="crashed: SIGABRT"):
        pg.extract_pages(docs, opened, limits=QUICK).collect()
    made = pg.extract_pages(docs, opened, on_document_error="quarantine", limits=QUICK).collect()
    assert {(r.doc_id, r.page_number, r.text, r.error) for r in made} == {(1, None, None, "crashed: SIGABRT"), (2, 1, "fine", None)}


def test_ingest_sets_crashes_aside(spark):
    text = "The quick brown fox jumps over the lazy dog near the river bank. " * 3
    rows = [(1, "a", text.encode()), (2, "a", text.encode() + b"\nabort\n" + text.encode()), (3, "a", b"loop")]
    docs = spark.createDataFrame(rows, "doc_id bigint, document_name string, content binary")
    root = scratch_path(spark, "crashes")
    report = ingest(docs, root, extractor=codec, limits=QUICK)
    assert (report.pages, report.kept, report.set_aside) == (3, 3, 2)
    reasons = {(r.doc_id, r.page_number): r.reason for r in cp.quarantine(spark, root).collect()}
    assert reasons[2, 2] == "crashed: SIGABRT" and reasons[3, 1].startswith("no answer in time")
