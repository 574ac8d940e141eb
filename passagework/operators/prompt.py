"""Ranked hits to context blocks, prompts, chat messages and answer rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bullet before a context item and the gap between two items.
BULLET = "- "
ITEM_GAP = "\n- "

DEFAULT_TEMPLATE = (
    "Answer the question using only the passages below.\n\n"
    "Passages:\n{context}\n\n"
    "Question: {query}\n"
    "Answer:"
)

_SLOT = re.compile(r"\{(context|query)\}")


def context_blocks(hits: DataFrame) -> DataFrame:
    """One bulleted block per query, hits in rank order. A group has at most ``n_results`` rows."""
    items = F.expr(f"listagg(sentence_chunk, '{ITEM_GAP}') WITHIN GROUP (ORDER BY rank)")
    return hits.groupBy("qid").agg(F.concat(F.lit(BULLET), items).alias("context"))


def fill_template(template: str, context: Column, query: Column) -> Column:
    """Put the two columns into the ``{context}`` and ``{query}`` slots.

    Braces inside the column values are left alone.
    """
    slots = {"context": context, "query": query}
    parts = _SLOT.split(template)
    return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def prompts(requests: DataFrame, hits: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``qid, query, prompt`` for every request, also those without a hit."""
    joined = requests.select("qid", F.col("text").alias("query")).join(context_blocks(hits), "qid", "left")
    context = F.coalesce(F.col("context"), F.lit(BULLET))
    return joined.select("qid", "query", fill_template(template, context, F.col("query")).alias("prompt"))


def chat_messages(prompted: DataFrame) -> DataFrame:
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    return prompted.select("qid", F.array(message).alias("messages"))


def answer_rows(prompted: DataFrame) -> DataFrame:
    return prompted.select("qid", "query", F.col("prompt").alias("results"))
