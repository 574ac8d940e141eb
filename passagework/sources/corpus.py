"""Corpus tables: chunks with embeddings, parquet, one partition per corpus name."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["doc_id", "page_number", "chunk_idx"]

# where a row is stored: tells rows apart that were appended twice
POSITION = ["file_path", "row_index"]

CORPUS_SCHEMA = (
    "doc_id bigint, page_number int, chunk_idx int, sentence_chunk string, "
    "chunk_char_count bigint, chunk_word_count bigint, chunk_token_count double, "
    "embedding array<float>, filename string, document_name string"
)
CORPUS_COLUMNS = [c.split()[0] for c in CORPUS_SCHEMA.split(", ")]


QUARANTINE_SCHEMA = "doc_id bigint, document_name string, filename string, page_number int, reason string"

# Characters that a partition folder writes as % and two hexadecimal digits.
ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}
UNNAMED_FOLDER = "__HIVE_DEFAULT_PARTITION__"

# Disk only: bytes of text that go to one task, where each text stands in many rows. Parquet writes a
# text once as long as those of a task are below 1 MB, and in every row after that.
TEXT_OF_TASK = 3 << 18

LOOKED_UP = 1000  # names whose folders are looked up one by one


class CorpusNotFound(LookupError):
    pass


def files_of(spark: SparkSession, name: str):
    """A path and the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _path_exists(spark: SparkSession, name: str) -> bool:
    path, files = files_of(spark, name)
    return files.exists(path)


def folder_of(document_name: str) -> str:
    return "document_name=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in document_name)


def names(spark: SparkSession, root: str) -> list[str]:
    """The names that have a corpus: a listing of folders, no file is opened."""
    path, files = files_of(spark, root)
    if not files.exists(path):
        return []
    folders = [status.getPath().getName() for status in files.listStatus(path)]
    escaped = [f.partition("=")[2] for f in folders if f.startswith("document_name=")]
    return [unquote(name) for name in escaped if name != UNNAMED_FOLDER]


def gather_by_name(chunks: DataFrame) -> DataFrame:
    """Bring the rows of one corpus together, so each task writes few files.

    Done on chunk text, before the encoder: no vectors are shuffled, and the
    encoder's work is even. A rebalance, not a plain repartition: at run time a
    name that holds a large share of all rows is split over many tasks, and
    small names share one. A task gets about as many bytes as
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` says; set it lower for
    a slow encoder.
    """
    return chunks.hint("rebalance", F.col("document_name"))


def deal_by_text(chunks: DataFrame, total: int) -> DataFrame:
    """Deal chunks out to tasks that hold few texts each; ``total`` is about the bytes of all texts.

    For rows that are to be multiplied, with their text in each one. What is
    dealt out should be small, so do it before that.
    """
    return chunks.repartition(max(1, -(-total // TEXT_OF_TASK)), *KEYS, "sentence_chunk")


def text_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum(F.octet_length("sentence_chunk"))).first()[0] or 0


def write(chunks: DataFrame, path: str, mode: str = "append") -> None:
    if "filename" not in chunks.columns:
        chunks = chunks.withColumn("filename", F.lit(None).cast("string"))
    # rows of one document lie together, which keeps the key statistics of a file narrow
    ordered = chunks.select(*CORPUS_COLUMNS).sortWithinPartitions("document_name", *KEYS)
    ordered.write.mode(mode).partitionBy("document_name").parquet(path)


def append(chunks: DataFrame, root: str) -> None:
    """Append, or create. Appending the same rows twice stores them twice."""
    write(chunks, root)


def set_aside(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Keep what could not be stored, with the reason."""
    columns = [c.split() for c in QUARANTINE_SCHEMA.split(", ")]
    cells = [(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns]
    rows.select(*cells).write.mode(mode).parquet(path)


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """What ingests into ``root`` set aside so far."""
    path = f"{root}/_quarantine"
    if not _path_exists(spark, path):
        return spark.createDataFrame([], QUARANTINE_SCHEMA)
    return spark.read.schema(QUARANTINE_SCHEMA).parquet(path)


# what streams have added: files of a batch count when the number of the batch, or a later one, is announced


def batch_prefix(stream: str, number: int) -> str:
    return f"stream-{stream}-{number}-"


def announced(spark: SparkSession, root: str) -> dict[str, int]:
    """The last batch of every stream that is whole. One folder per stream, whatever the number of batches."""
    path, files = files_of(spark, f"{root}/_streams")
    if not files.exists(path):
        return {}
    last = {}
    for status in files.listStatus(path):
        numbers = [int(f.getPath().getName()) for f in files.listStatus(status.getPath())]
        last[status.getPath().getName()] = max(numbers, default=-1)
    return last


def announce(spark: SparkSession, root: str, stream: str, number: int) -> None:
    """From now on batches up to ``number`` are read. -1 makes the stream known before its first file is there."""
    path, files = files_of(spark, f"{root}/_streams/{stream}")
    files.mkdirs(files_of(spark, f"{root}/_streams/{stream}/{number}")[0])
    for status in files.listStatus(path):
        if int(status.getPath().getName()) < number:
            files.delete(status.getPath(), True)


def _whole_batches(last: dict[str, int]) -> Column:
    name = r"/stream-([0-9a-f]+)-(\d+)-[^/]*$"
    stream, number = (F.regexp_extract("file_path", name, i) for i in (1, 2))
    found = stream == ""
    for known, upto in last.items():
        found = found | ((stream == known) & (number.try_cast("bigint") <= upto))
    return found


def stored(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame | None:
    """The table of all corpora, or of one folder, with row positions; None if nothing was written yet.

    Batches that a stream is about to add are left out until they are whole.
    """
    path = root if folder is None else f"{root}/{folder}"
    if not _path_exists(spark, path):
        return None
    # a folder's name stands for its characters; a path pattern would read some of them otherwise
    reader = spark.read.schema(CORPUS_SCHEMA).option("basePath", root)
    last = announced(spark, root)
    while True:
        table = reader.parquet(path).select(
            "*",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.row_index").alias("row_index"),
        )
        # files are listed by now: of a stream that was not known before, some may be among them
        now = announced(spark, root)
        if now.keys() == last.keys():
            return table.where(_whole_batches(last)) if last else table
        last = now


def only_absent(rows: DataFrame, root: str) -> DataFrame:
    """Rows whose ``document_name`` has no corpus yet.

    Apply it to documents, before any chunk or vector is made for them. The
    existing names come from the folder listing alone.
    """
    spark = rows.sparkSession
    existing = spark.createDataFrame([(name,) for name in names(spark, root)], "document_name string")
    # a list of names: the rows stay where they are, however many have one name
    return rows.join(F.broadcast(existing), "document_name", "left_anti")


def first_unknown(asked: DataFrame, root: str) -> str | None:
    """The first of the names asked for, in order, that has no corpus; None if all have one.

    Only the folders of these names are looked at, up to ``LOOKED_UP`` names; beyond that all folders are listed.
    """
    spark = asked.sparkSession
    wanted = asked.select(F.coalesce("document_name", F.lit("")).alias("document_name")).distinct()
    few = [r["document_name"] for r in wanted.limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return min((name for name in few if not name or not exists(spark, root, name)), default=None)
    unknown = only_absent(wanted, root).sort("document_name").first()
    return unknown["document_name"] if unknown else None


def create_if_absent(chunks: DataFrame, root: str) -> None:
    """Write only the corpora that do not exist yet; leave the others as they are."""
    write(only_absent(chunks, root), root)


def exists(spark: SparkSession, root: str, document_name: str) -> bool:
    return _path_exists(spark, f"{root}/{folder_of(document_name)}")


def read(spark: SparkSession, root: str, document_name: str | None = None) -> DataFrame:
    """One corpus by name, or all of them. Only the named partition is read."""
    table = stored(spark, root)
    if table is None:
        raise CorpusNotFound(f"no corpus at {root}")
    return table if document_name is None else table.where(F.col("document_name") == document_name)


def open_corpus(spark: SparkSession, root: str, document_name: str) -> DataFrame:
    """One corpus; a missing or empty name is an error. Lists the folder of that name only, and runs no job."""
    if not document_name:
        raise ValueError("a document name is required")
    if not exists(spark, root, document_name):
        raise CorpusNotFound(f"no corpus named {document_name!r} at {root}")
    table = stored(spark, root, folder_of(document_name))
    return table.where(F.col("document_name") == document_name)


def preview(table: DataFrame, rows: int = 5) -> DataFrame:
    return table.orderBy(*[k for k in KEYS if k in table.columns]).limit(rows)
