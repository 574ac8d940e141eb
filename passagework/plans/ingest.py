"""Documents to a corpus table. What cannot be stored is set aside and counted, never lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.functions.encoders import DEFAULT_BATCH_SIZE, EncoderFactory, HashingEncoder, encode, encode_outcome
from passagework.operators import chunks as ch
from passagework.operators import pages as pg
from passagework.operators.isolation import Limits
from passagework.session import scratch_path
from passagework.sources import corpus
from passagework.sources.documents import missing_reason, quarantine_missing


@dataclass(frozen=True)
class IngestReport:
    """What one ingest did. ``set_aside`` counts documents and pages that are in the quarantine table now."""

    pages: int
    chunks: int
    kept: int
    set_aside: int = 0
    failed_embeddings: int = 0
    reason: str | None = None

    @property
    def saved(self) -> int:
        return self.kept - self.failed_embeddings

    @property
    def message(self) -> str:
        parts = [f"{self.pages} pages processed"]
        parts.append(f"{self.saved} embeddings saved" if self.kept else "no chunk was long enough")
        if self.failed_embeddings:
            parts.append(f"{self.failed_embeddings} embeddings failed, for one: {self.reason}")
        if self.set_aside:
            parts.append(f"{self.set_aside} documents or pages set aside")
        return ", ".join(parts)


class EmbeddingsFailed(RuntimeError):
    """More embeddings failed than the caller puts up with. The rows are stored, without vectors."""

    def __init__(self, report: IngestReport):
        super().__init__(report.message)
        self.report = report


@dataclass(frozen=True)
class IngestOptions:
    """How documents become chunks with vectors.

    With an ``extractor`` documents come as ``content`` bytes, else as
    ``text``, which is cut at ``page_sep``.
    """

    page_sep: str = pg.FORM_FEED
    size: int = ch.SENTENCES_PER_CHUNK
    splitter: tx.Splitter = tx.sentences
    joiner: str = ""
    factory: EncoderFactory = HashingEncoder
    min_tokens: float = ch.MIN_TOKENS
    batch_size: int = DEFAULT_BATCH_SIZE
    pad_waste: float | None = None  # for a model that pads: batches of like length, see functions.encoders
    batch_chars: int | None = None
    extractor: pg.Extractor | None = None
    limits: Limits | None = None  # of the extractor, which runs in a child process then


def document_chunks(
    docs: DataFrame,
    page_sep: str = pg.FORM_FEED,
    size: int = ch.SENTENCES_PER_CHUNK,
    splitter: tx.Splitter = tx.sentences,
    joiner: str = "",
) -> DataFrame:
    """Text documents to chunks with statistics. No shuffle."""
    return ch.create_chunks(pg.split_pages(docs, page_sep=page_sep), size, splitter, joiner)


def embed_chunks(
    chunks: DataFrame,
    factory: EncoderFactory = HashingEncoder,
    min_tokens: float = ch.MIN_TOKENS,
    batch_size: int = DEFAULT_BATCH_SIZE,
    **batches: float,
) -> DataFrame:
    """Drop short chunks, then add one vector per chunk."""
    kept = chunks.where(ch.long_enough(min_tokens))
    return kept.withColumn("embedding", encode(F.col("sentence_chunk"), factory, batch_size, **batches))


def _extracted(docs: DataFrame, extractor: pg.Extractor, limits: Limits | None) -> tuple[DataFrame, DataFrame, int]:
    """Readable pages and failed ones, with the number of these. Written once, as both are read from it."""
    path, failed = scratch_path(docs.sparkSession, "extracted"), Observation()
    pages = pg.extract_pages(docs, extractor, on_document_error="quarantine", limits=limits)
    pages.observe(failed, F.count("error").alias("rows")).write.parquet(path)
    stored = docs.sparkSession.read.schema(pages.schema).parquet(path)
    return pg.readable(stored), pg.quarantined(stored).withColumnRenamed("error", "reason"), failed.get["rows"]


def store_documents(docs: DataFrame, root: str, aside: str, options: IngestOptions, mode: str = "append") -> IngestReport:
    """Store documents under ``root``, what cannot be stored under ``aside``.

    Documents are read once. What is to be set aside is counted on the way,
    and only if there is some is it looked for.
    """
    body = "content" if options.extractor else "text"
    carried = ["doc_id", "document_name", *(["filename"] if "filename" in docs.columns else []), body]
    count = F.count(F.lit(1)).alias("rows")
    asked, lacking = docs.select(*carried), Observation()
    reason = missing_reason(asked, body)
    good = asked.observe(lacking, F.count(reason).alias("rows")).where(reason.isNull())
    failed, failures = None, 0
    if options.extractor:
        pages, failed, failures = _extracted(good, options.extractor, options.limits)
    else:
        pages = pg.split_pages(good, page_sep=options.page_sep)

    seen, made, kept, ended = Observation(), Observation(), Observation(), Observation()
    chunks = ch.create_chunks(pages.observe(seen, count), options.size, options.splitter, options.joiner).observe(made, count)
    gathered = corpus.gather_by_name(chunks.where(ch.long_enough(options.min_tokens)).observe(kept, count))
    outcome = encode_outcome(
        F.col("sentence_chunk"), options.factory, options.batch_size, options.pad_waste, options.batch_chars
    )
    error = F.col("outcome.error")
    encoded = gathered.withColumn("outcome", outcome).observe(ended, F.count(error).alias("failed"), F.min(error).alias("reason"))
    corpus.write(encoded.withColumn("embedding", F.col("outcome.embedding")), root, mode)

    refused = [(lacking.get["rows"], quarantine_missing(asked, body)[1]), (failures, failed)]
    for number, rows in refused:
        if number:
            corpus.set_aside(rows, aside, mode)
            mode = "append"
    set_aside = sum(number for number, _ in refused)
    return IngestReport(
        seen.get["rows"], made.get["rows"], kept.get["rows"], set_aside, ended.get["failed"], ended.get["reason"]
    )


def ingest(docs: DataFrame, root: str, only_new_names: bool = False, tolerated: float = 1.0, **options) -> IngestReport:
    """Chunk, filter, embed and store ``doc_id, document_name[, filename], text`` documents.

    Files go in as ``content`` bytes with an ``extractor``. ``only_new_names``
    leaves existing corpora alone and does no work for them; otherwise rows are
    appended. Documents without name or body, and pages that cannot be read,
    go to ``corpus.quarantine``. A chunk whose embedding fails is stored with a
    NULL vector and counted; a share of them above ``tolerated`` raises
    ``EmbeddingsFailed``. The counts come from the same pass.
    """
    if only_new_names:
        docs = corpus.only_absent(docs, root)
    report = store_documents(docs, root, f"{root}/_quarantine", IngestOptions(**options))
    if report.failed_embeddings > tolerated * report.kept:
        raise EmbeddingsFailed(report)
    return report
