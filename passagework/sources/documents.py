"""Document sources: a table of extracted text, or files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import scratch_path

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# at most so many bytes for each core are dealt out anew, so that every core has work
SPREAD_BYTES = 8 << 20


def spread(scan: DataFrame, path: str) -> DataFrame:
    """Deal a small table in few files out over all cores, before row-heavy work.

    ``scan`` reads the files at ``path``; their number and total size decide,
    as the file system adds them up. No job runs and no file name comes to the
    driver. A larger table, or one in as many files as there are cores, is left
    as it is. Rows are dealt out evenly, whatever their keys.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    return scan.repartition(cores) if held.getFileCount() < cores and held.getLength() <= cores * SPREAD_BYTES else scan


def text_table(spark: SparkSession, path: str, name_col: str = "source") -> DataFrame:
    """``doc_id, document_name, text`` of a parquet table of extracted text."""
    table = spark.read.schema(DOCUMENT_SCHEMA).parquet(path)
    return spread(table.select("doc_id", F.col(name_col).alias("document_name"), "text"), path)


# many small files are read by at most so many tasks for each core, and not by one task for every few
FILE_TASKS = 16

UNNAMED_FILE = "__HIVE_DEFAULT_PARTITION__"  # as partition folders call a value that is missing


def write_files(docs: DataFrame, path: str, line_end: str = "\f") -> None:
    """``file, text`` rows as files ``file=<name>``, in a folder for each task.

    Rows of a task with the same name share a file, each with its ``line_end``.
    The tasks write by Arrow's file systems; a store that Arrow does not know
    is written by Spark, in a folder for each name.
    """
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        docs.select("text", "file").write.partitionBy("file").text(path, lineSep=line_end)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(uri)
        folder, made = f"{base}/part-{TaskContext.get().partitionId():05d}", 0
        store.create_dir(folder, recursive=True)
        rows = ((n, t) for batch in batches for n, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()))
        for name, same in groupby(rows, key=lambda row: row[0]):
            with store.open_output_stream(f"{folder}/file={UNNAMED_FILE if name is None else name}") as out:
                for _, text in same:
                    out.write(((text or "") + line_end).encode())
            made += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    named = docs.select("file", "text").sortWithinPartitions("file")
    named.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


# a task reads so many files or bytes, or more where that would be more tasks than these; it hands over so much at a time
TASK_FILES, TASK_BYTES = 64, 16 << 20
READ_FILES, READ_BYTES = 1024, 4 << 20

LISTED_SCHEMA = "below string, bytes bigint, folder boolean"


def _seen(name: str, folder: bool) -> bool:
    """Whether Spark's readers see a file or folder of that name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _listed(spark: SparkSession, uri: str, pattern: str) -> DataFrame:
    """All files below a folder, as Spark's readers see them: a job for every level, in which tasks list the folders.

    Neither files nor folders come to the driver.
    """
    where, level, most = scratch_path(spark, "listed"), 0, spark.sparkContext.defaultParallelism * FILE_TASKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(uri)
        base = base.rstrip("/")
        for below in (x for batch in batches for x in batch.column("below").to_pylist()):
            found = store.get_file_info(FileSelector(f"{base}{below}" or "/"))
            for start in range(0, len(found), READ_FILES):
                kept = []
                for entry in found[start : start + READ_FILES]:
                    folder = entry.type == FileType.Directory
                    wanted = folder or (entry.type == FileType.File and entry.size > 0 and re.fullmatch(pattern, entry.base_name, re.DOTALL))
                    if wanted and _seen(entry.base_name, folder):
                        kept.append((entry.path[len(base) :], 0 if folder else entry.size, folder))
                columns = [pa.array(c, t) for c, t in zip(zip(*kept), (pa.string(), pa.int64(), pa.bool_()))]
                if kept:
                    yield pa.RecordBatch.from_arrays(columns, names=["below", "bytes", "folder"])

    folders, number = spark.createDataFrame([("",)], "below string"), 1
    while number:
        rows = folders.repartition(min(number, most)).mapInArrow(run, LISTED_SCHEMA)
        rows.write.parquet(f"{where}/level={level}")
        folders = spark.read.schema(LISTED_SCHEMA).parquet(f"{where}/level={level}").where("folder").select("below")
        number, level = folders.count(), level + 1
    return spark.read.schema(f"{LISTED_SCHEMA}, level int").parquet(where).where("not folder").select("below", "bytes")


def _contents(spark: SparkSession, path: str, glob: str | None) -> DataFrame | None:
    """``path, content`` of the files below a folder, listed and read by tasks. None if that is for Spark's reader to do.

    That are paths with a pattern or of a single file, settings to pass over
    files, and stores that Arrow does not know.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    lenient = (spark.conf.get(f"spark.sql.files.ignore{kind}Files") == "true" for kind in ("Missing", "Corrupt"))
    if set(path) & set("{}[]*?\\") or any(lenient) or not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return None
    place = store.makeQualified(place)
    root, uri = place.toString().rstrip("/"), place.toUri().toString()
    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = FileSystem.from_uri(uri)
        base, paths, contents, held = base.rstrip("/"), [], [], 0
        for below in (x for batch in batches for x in batch.column("below").to_pylist()):
            with source.open_input_stream(f"{base}{below}", compression=None) as stream:
                contents.append(stream.read())
            paths.append(root + below)
            held += len(contents[-1])
            if len(paths) >= READ_FILES or held >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern() if glob else ".*"
    found = _listed(spark, uri, pattern)
    number, size = found.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    tasks = min(cores * FILE_TASKS, number, max(cores, number // TASK_FILES, size // TASK_BYTES))
    return found.select("below").repartition(max(1, tasks)).mapInArrow(run, "path string, content binary")


def files(spark: SparkSession, path: str, document_name: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``doc_id, document_name, filename, path, content``.

    ``doc_id`` is a hash of the path, so a file keeps its id between runs. The
    files are listed now, by tasks, and read when the rows are asked for.
    Spark's own reader, which keeps every file in the driver's memory, is used
    where the path is no folder that Arrow's file systems know.
    """
    found = _contents(spark, path, glob)
    if found is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        found = reader.load(path).coalesce(spark.sparkContext.defaultParallelism * FILE_TASKS)
    return found.select(
        F.xxhash64("path").alias("doc_id"),
        F.lit(document_name).alias("document_name"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "path",
        "content",
    )


def decode_text(docs: DataFrame, charset: str = "UTF-8") -> DataFrame:
    return docs.withColumn("text", F.decode("content", charset)).drop("content")


def missing_reason(docs: DataFrame, body: str = "text") -> Column:
    """Why a document cannot be stored; null if it can.

    A corpus is found by its name, so a document without one could be stored
    but never asked for.
    """
    reason = F.when(F.col(body).isNull(), F.lit(f"{body} is missing"))
    if "document_name" in docs.columns:
        unnamed = F.coalesce(F.col("document_name"), F.lit("")) == ""
        reason = F.when(unnamed, F.lit("document name is missing")).otherwise(reason)
    return reason


def quarantine_missing(docs: DataFrame, body: str = "text") -> tuple[DataFrame, DataFrame]:
    """Split into documents that can be stored, and those without name or body, with a reason."""
    reason = missing_reason(docs, body)
    return docs.where(reason.isNull()), docs.where(reason.isNotNull()).withColumn("reason", reason).drop(body)
