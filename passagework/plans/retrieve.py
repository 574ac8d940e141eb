"""Questions to ranked chunks and prompts. The search itself runs when it is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passagework.functions.encoders import EncoderFactory, HashingEncoder, encode
from passagework.functions.vectors import DEFAULT_DIM
from passagework.operators import prompt as pr
from passagework.operators import search as se
from passagework.sources import corpus as cp

PAYLOAD = ["sentence_chunk", "chunk_char_count", "chunk_word_count", "chunk_token_count"]


def with_query_vectors(requests: DataFrame, factory: EncoderFactory = HashingEncoder) -> DataFrame:
    return requests.withColumn("query_vector", encode(F.col("text"), factory))


def retrieve(
    corpus: DataFrame,
    requests: DataFrame,
    factory: EncoderFactory = HashingEncoder,
    dim: int = DEFAULT_DIM,
    n_results: int = se.DEFAULT_RESULTS,
    digits: int | None = None,
    payload: list[str] | None = None,
    scored: Observation | None = None,
) -> DataFrame:
    """Ranked chunks with their text for ``qid, text[, n_results][, document_name]``.

    Vectors are scored without reading any text; the text of the winners is
    joined afterwards, by row position if the corpus is a stored table.
    """
    name = ["document_name"] if "document_name" in corpus.columns else []
    position = [c for c in cp.POSITION if c in corpus.columns]
    shown = [*cp.KEYS, *name]
    vectors = with_query_vectors(requests, factory)
    hits = se.search(corpus, vectors, [*shown, *position], dim=dim, n_results=n_results, digits=digits, scored=scored)
    columns = PAYLOAD if payload is None else payload
    if columns:
        row = [*name, *position] if position else shown
        hits = se.attach_payload(hits, corpus, row, columns)
    return hits.select("qid", "rank", *shown, *columns, "score")


def answer(
    corpus: DataFrame,
    requests: DataFrame,
    template: str = pr.DEFAULT_TEMPLATE,
    **options,
) -> DataFrame:
    """``qid, query, results``: the filled prompt of every request."""
    hits = retrieve(corpus, requests, payload=["sentence_chunk"], **options)
    return pr.answer_rows(pr.prompts(requests, hits, template))
