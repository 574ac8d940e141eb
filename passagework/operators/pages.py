"""Documents to pages: splitting, page statistics, page-level fault isolation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.operators.isolation import IsolatedExtractors, Limits, Page, packed
from passagework.operators.page_child import reason_of

FORM_FEED = "\f"
REGEX_SPECIAL = r".$|()[]{}^?*+\\"

PageReader = Callable[[], str]
Extractor = Callable[[bytes], Iterable[PageReader]]


def page_texts(text: Column, page_sep: str = FORM_FEED) -> Column:
    # a lone ordinary character splits without the regex engine
    plain = not set(page_sep) & set(REGEX_SPECIAL)
    return F.split(text, page_sep if plain else re.escape(page_sep), -1)


def split_pages(docs: DataFrame, text_col: str = "text", page_sep: str = FORM_FEED) -> DataFrame:
    """One row per page, numbered from 1, text normalised. Other columns stay."""
    kept = [c for c in docs.columns if c != text_col]
    parts = page_texts(F.col(text_col), page_sep)
    return docs.select(*kept, F.posexplode(parts).alias("pos", "page")).select(
        *kept, (F.col("pos") + 1).alias("page_number"), tx.normalize(F.col("page")).alias("text")
    )


def checked_pages(docs: DataFrame, unreadable: str, reason: str, text_col: str = "text", page_sep: str = FORM_FEED) -> DataFrame:
    """Like ``split_pages``; a page with a match of ``unreadable`` has no text but an ``error``.

    For text that is there already; ``extract_pages`` runs a byte codec.
    """
    bad = F.col("text").rlike(unreadable)
    pages = split_pages(docs, text_col, page_sep).withColumn("error", F.when(bad, F.lit(reason)))
    return pages.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def with_page_stats(pages: DataFrame) -> DataFrame:
    text = F.col("text")
    return pages.withColumns(
        {
            "page_char_count": tx.char_count(text),
            "page_word_count": tx.word_count(text),
            "page_sentence_count_raw": tx.raw_sentence_count(text),
            "page_token_count": tx.token_estimate(text),
        }
    )


def ascii_pages(content: bytes) -> Iterator[PageReader]:
    """Pages of plain ASCII bytes, one per line. A page with other bytes fails."""
    for page in content.split(b"\n"):
        yield lambda page=page: page.decode("ascii")


def extract_pages(
    docs: DataFrame,
    extractor: Extractor,
    content_col: str = "content",
    on_document_error: str = "raise",
    limits: Limits | None = None,
) -> DataFrame:
    """Run a byte-level page extractor; a page that fails becomes an error row.

    The extractor returns one reader per page, so a failing page costs that
    page only. A document that cannot be opened fails the job, or becomes one
    error row without a page number if ``on_document_error="quarantine"``.
    Adds ``page_number, text, error`` and drops ``content_col``.

    With ``limits`` the extractor runs in a child process of each task, and a
    page that crashes it, takes too long or too much memory is an error row like
    any other; what cannot be read of a document behind a crash between pages
    is an error of the document.
    """
    if on_document_error not in ("raise", "quarantine"):
        raise ValueError("on_document_error is 'raise' or 'quarantine'")
    kept = [f for f in docs.schema.fields if f.name != content_col]
    names = [f.name for f in kept]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = f"{columns}, page_number int, text string, error string"
    rows_per_batch = 1024
    shipped = packed(extractor) if limits else b""

    def read_document(content: bytes) -> Iterator[Page]:
        try:
            for number, reader in enumerate(extractor(content), start=1):
                try:
                    yield number, reader(), None
                except Exception as failure:
                    yield number, None, reason_of(failure)
        except Exception as failure:
            if on_document_error == "raise":
                raise
            yield None, None, reason_of(failure)

    def as_batch(source: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        origin, numbers, texts, errors = zip(*rows)
        origin = pa.array(origin, pa.int64())
        carried = [source.column(n).take(origin) for n in names]
        made = [pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(carried + made, names=[*names, "page_number", "text", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if limits is None:
            yield from in_batches((batch, i, read_document(content)) for batch, i, content in documents_of(batches))
            return
        with IsolatedExtractors(shipped, limits) as isolated:
            read = isolated.documents(((batch, i), content) for batch, i, content in documents_of(batches))
            yield from in_batches((batch, i, checked(pages)) for (batch, i), pages in read)

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
        for batch in batches:
            contents = batch.column(content_col)
            for i in range(batch.num_rows):
                yield batch, i, contents[i].as_py()

    def checked(pages: list[Page]) -> Iterator[Page]:
        for page in pages:
            if page[0] is None and on_document_error == "raise":
                raise RuntimeError(page[2])
            yield page

    def in_batches(read: Iterator[tuple[pa.RecordBatch, int, Iterator[Page]]]) -> Iterator[pa.RecordBatch]:
        source, rows = None, []
        for batch, i, pages in read:
            if batch is not source and rows:
                yield as_batch(source, rows)
                rows = []
            source = batch
            for page in pages:
                rows.append((i, *page))
                if len(rows) == rows_per_batch:
                    yield as_batch(source, rows)
                    rows = []
        if rows:
            yield as_batch(source, rows)

    extracted = docs.select(*names, content_col).mapInArrow(run, schema)
    return extracted.withColumn("text", tx.normalize(F.col("text")))


def readable(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error").isNull()).drop("error")


def quarantined(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("error").isNotNull()).drop("text")
