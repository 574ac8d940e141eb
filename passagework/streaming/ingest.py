"""Incremental ingest: new documents only, appended to the corpus exactly once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.plans.ingest import EmbeddingsFailed, IngestOptions, IngestReport, store_documents
from passagework.sources.corpus import announce, batch_prefix, files_of
from passagework.sources.documents import DOCUMENT_SCHEMA

REPORT_SCHEMA = "batch bigint, pages bigint, chunks bigint, kept bigint, set_aside bigint, failed_embeddings bigint, reason string"


def document_stream(
    spark: SparkSession,
    path: str,
    schema: str = DOCUMENT_SCHEMA,
    glob: str = "*.parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def ingest_stream(
    documents: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    partition_by: str | None = None,
) -> StreamingQuery:
    """Run ``transform`` on what arrived since the last run, then stop.

    The transform is row-local, so there is no state and no watermark. File
    sink and checkpoint together make every document count once.
    """
    writer = (
        transform(documents)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", root)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.start()


def publish(spark: SparkSession, staged: str, target: str, prefix: str = "") -> None:
    """Move the files below ``staged`` to the same places below ``target``, with ``prefix`` before their names.

    Every move is atomic, and what is moved is gone here, so a publish that
    was cut short is simply run again.
    """
    source, files = files_of(spark, staged)
    if not files.exists(source):
        return
    base = source.toUri().getPath().rstrip("/")
    listed = files.listFiles(source, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName().startswith(("_", ".")):
            continue
        place = path.toUri().getPath()
        relative = place[len(base) + 1 :]
        folder, _, name = relative.rpartition("/")
        goal, _ = files_of(spark, f"{target}/{folder}/{prefix}{name}" if folder else f"{target}/{prefix}{name}")
        files.mkdirs(goal.getParent())
        if not files.rename(path, goal):
            raise OSError(f"cannot move {path} to {goal}")


def store_batch(batch: DataFrame, number: int, root: str, checkpoint: str, options: IngestOptions) -> None:
    """Add one micro-batch to a corpus, once, however often it is tried.

    The rows are written beside the checkpoint first. When they are complete
    they are moved into the corpus file by file, under names that readers leave
    out until the number of the batch is announced there; so a reader sees all
    of a batch or nothing. A batch that is tried again goes on where it was.
    """
    spark = batch.sparkSession
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    folder = f"{checkpoint}/corpus-batches/{number}"
    (written, files), (done, _) = files_of(spark, f"{folder}/written"), files_of(spark, f"{folder}/done")
    if files.exists(done):
        return
    if not files.exists(written):
        report = store_documents(batch, f"{folder}/rows", f"{folder}/aside", options, mode="overwrite")
        told = (number, report.pages, report.chunks, report.kept, report.set_aside, report.failed_embeddings, report.reason)
        spark.createDataFrame([told], REPORT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/report")
        files.mkdirs(written)
    publish(spark, f"{folder}/aside", f"{root}/_quarantine")
    announce(spark, root, stream, -1)
    publish(spark, f"{folder}/rows", root, batch_prefix(stream, number))
    announce(spark, root, stream, number)
    files.mkdirs(done)


def stream_reports(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What every micro-batch of a corpus stream did, one row each."""
    folder, files = files_of(spark, f"{checkpoint}/corpus-batches")
    if not files.exists(folder):
        return spark.createDataFrame([], REPORT_SCHEMA)
    return spark.read.schema(REPORT_SCHEMA).parquet(f"{checkpoint}/corpus-batches/*/report")


def corpus_stream(documents: DataFrame, root: str, checkpoint: str, tolerated: float = 1.0, **options) -> StreamingQuery:
    """Embed arriving ``doc_id, document_name[, filename], text`` documents into a corpus table, then stop.

    The corpus may be one that batches made, and batches may append to it
    afterwards; every document is added once. Options are those of
    ``IngestOptions``. ``stream_reports`` tells what each batch did; one with a
    larger share of failed embeddings than ``tolerated`` is stored, and ends the
    stream with ``EmbeddingsFailed``.
    """
    chosen = IngestOptions(**options)

    def add(batch: DataFrame, number: int) -> None:
        store_batch(batch, number, root, checkpoint, chosen)
        own = stream_reports(batch.sparkSession, checkpoint).where(F.col("batch") == number).drop("batch").first()
        report = IngestReport(**own.asDict())
        if report.failed_embeddings > tolerated * report.kept:
            raise EmbeddingsFailed(report)

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
