"""Pages to sentences to chunks, and the length filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as tx
from passagework.operators.pages import FORM_FEED, page_texts

# Sentences in one chunk, and the token count a chunk must exceed.
SENTENCES_PER_CHUNK = 10
MIN_TOKENS = 30


def with_sentences(pages: DataFrame, splitter: tx.Splitter = tx.sentences) -> DataFrame:
    split = pages.withColumn("sentences", splitter(F.col("text")))
    return split.withColumn("page_sentence_count", F.size("sentences").cast("bigint"))


def with_sentence_groups(pages: DataFrame, size: int = SENTENCES_PER_CHUNK) -> DataFrame:
    """Adds ``sentence_chunks`` and ``num_chunks``; a page without sentences stays, with 0."""
    grouped = pages.withColumn("sentence_chunks", tx.slices(F.col("sentences"), size))
    return grouped.withColumn("num_chunks", F.size("sentence_chunks").cast("bigint"))


def chunk_texts(joiner: str = "") -> Column:
    return F.transform("sentence_chunks", lambda parts: tx.join_sentences(parts, joiner))


def explode_chunks(pages: DataFrame, joiner: str = "") -> DataFrame:
    """One row per sentence group with its text. Pages without sentences vanish.

    Keeps the key columns, not the page text, so a chunk row stays small.
    """
    keys = [c for c in ("doc_id", "document_name", "filename", "page_number") if c in pages.columns]
    # Joining inside the array, and dropping empty pages after the explode, keeps
    # later filters from being pushed below it and splitting or joining again.
    joined = pages.select(*keys, chunk_texts(joiner).alias("texts"))
    exploded = joined.select(*keys, F.posexplode_outer("texts").alias("chunk_idx", "sentence_chunk"))
    return exploded.where(F.col("chunk_idx").isNotNull())


def with_chunk_stats(chunks: DataFrame) -> DataFrame:
    text = F.col("sentence_chunk")
    return chunks.withColumns(
        {
            "chunk_char_count": tx.char_count(text),
            "chunk_word_count": tx.word_count(text),
            "chunk_token_count": tx.token_estimate(text),
        }
    )


def create_chunks(
    pages: DataFrame,
    size: int = SENTENCES_PER_CHUNK,
    splitter: tx.Splitter = tx.sentences,
    joiner: str = "",
) -> DataFrame:
    """Pages to chunks with statistics, in one call."""
    grouped = with_sentence_groups(with_sentences(pages, splitter), size)
    return with_chunk_stats(explode_chunks(grouped, joiner))


def long_enough(min_tokens: float = MIN_TOKENS) -> Column:
    """Strictly more than ``min_tokens``."""
    return F.col("chunk_token_count") > min_tokens


def ingest_metrics(
    docs: DataFrame,
    page_sep: str = FORM_FEED,
    size: int = SENTENCES_PER_CHUNK,
    min_tokens: float = MIN_TOKENS,
    splitter: tx.Splitter = tx.sentences,
) -> DataFrame:
    """Pages, sentences, chunks and kept chunks of every document; a missing text has none.

    A document is one row, so its pages stay an array and nothing is shuffled.
    """
    pages = F.transform(page_texts(F.col("text"), page_sep), lambda page: splitter(tx.normalize(page)))
    counted = docs.select("doc_id", F.coalesce(pages, F.array().cast("array<array<string>>")).alias("pages"))
    groups = F.flatten(F.transform("pages", lambda page: tx.slices(page, size)))
    tokens = F.transform(groups, lambda parts: tx.token_estimate(tx.join_sentences(parts)))
    total = F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, page: n + F.size(page))
    return counted.select("doc_id", F.size("pages").cast("bigint").alias("pages"), total.alias("sentences"), tokens.alias("tokens")).select(
        "doc_id",
        "pages",
        "sentences",
        F.size("tokens").cast("bigint").alias("chunks"),
        F.size(F.filter("tokens", lambda n: n > min_tokens)).cast("bigint").alias("kept_chunks"),
    )
