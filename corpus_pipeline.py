"""The documents of a corpus, cleaned stage by stage and packed for training.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before it kept. All but the last return the columns of the documents as they
came, extra ones included; the last returns the pieces of the packed
sequences. Null texts count as empty, rows with equal or no ids as rows of
their own, and an empty table passes through.

1. quality classifier: documents that the scorer rejects go;
2. near duplicates: of each class of fingerprints one document stays;
3. decontamination: documents that hold a benchmark passage go;
4. secrets: found spans are masked in the text, all documents stay;
5. packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import decontaminate, packing, quality, secrets, simhash
from passagework.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.only_kept(docs, quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.without_leaks(docs, items)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", pack),
]

# tokenizers, hashes and trained scores have no SQL; the tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, start=1):
        made = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = scratch_path(spark, f"stage-{number}")
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
    return made
