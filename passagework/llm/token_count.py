"""Token counts: map-side lookup in two tiers, no shuffle of pre-tokens.

The table of frequent pre-tokens is the public vocabulary's own word list. It
is broadcast; its size is bounded by the vocabulary and does not depend on the
corpus. What it lacks is encoded once per worker and remembered in a bounded
memo. Every count equals the library's.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import per_worker, texts, with_fields
from passagework.llm.tokens import TokenLengths, frequent_lengths

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def with_token_counts(
    docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit``; columns of these names are replaced.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are
    counted whole. Every row is judged by itself, repeated rows alike; an empty
    table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def setup():
        lengths = per_worker(("token lengths", path), lambda: TokenLengths(path, frequent.value))
        return lambda batch: [pa.array([lengths.count(t) for t in texts(batch)], pa.int64())]

    text = F.col(text_col)
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    counted = with_fields(docs.withColumn("n_bytes", n_bytes), text, "n_tokens: bigint", setup)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
