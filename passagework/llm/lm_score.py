"""Language-model scores: cross-entropy difference of two matched bigram models.

Target and background model share one vocabulary, all words of both tables, and
the same smoothing; only their counts differ. Every word, context and bigram of
all texts is counted by itself, so what is gathered grows with the corpus.

Counts never meet in one place. Each part of the texts sends the distinct
things it has, with how often, dealt out by their hashes; where equal ones of
all parts meet they are added up, and each part gets the totals of its own back,
in its order, so the things themselves travel one way only. A word that stands
in every text is sent once by each part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import forget, fresh, give_back, quoted
from passagework.llm.parts import from_planes, groups, in_parts, numbered, planes, table_of
from passagework.session import scratch_path

# Parameters of the models.
PRIOR_WORDS = 16.0  # weight of the word model beside the words seen after a word
MARKS = ".,;:!?\"'()[]"

PART_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SLOT_BYTES = 16 << 20  # of text, whose counts are added up in one task

WORD, CONTEXT, BIGRAM = 0, 1, 2
START = np.uint64(0x9E3779B97F4A7C15)


def plain(word: str) -> str:
    """A word as it is counted: lower case, without the marks around it."""
    return word.lower().strip(MARKS) or word


# what is counted


def key(kind: int, first: np.ndarray, second: np.ndarray | int = 0) -> np.ndarray:
    """A 56-bit name of a word, a context or a bigram."""
    made = first * np.uint64(0xD6E8FEB86659FD93) + np.asarray(second, np.uint64) * np.uint64(0xA0761D6478BD642F)
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(29)
    return (made >> np.uint64(8)) & ~np.uint64(3) | np.uint64(kind)


class Tokens:
    """The words of some texts, and the distinct things there are to count in them."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat = split.flatten()
        some = np.asarray(pc.greater(pc.binary_length(flat), 0))
        self.text = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths()))[some]
        self.counts = np.bincount(self.text, minlength=len(texts))
        coded = flat.filter(pa.array(some)).dictionary_encode()
        listed = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        digests = np.fromiter((xxhash.xxh3_64_intdigest(plain(w)) for w in listed), np.uint64, len(listed))
        word = digests[np.asarray(coded.indices)]
        before = np.r_[START, word[:-1]][: len(word)]
        before[groups(self.text)] = START
        made, self.places, at = [], [], 0
        for things in (key(WORD, word), key(CONTEXT, before), key(BIGRAM, before, word)):
            distinct, place, n = np.unique(things, return_inverse=True, return_counts=True)
            made.append((distinct, n))
            self.places.append(place + at)
            at += len(distinct)
        keys, n = (np.concatenate(c) for c in zip(*made))
        order = np.argsort(keys)
        self.keys, self.seen = keys[order], n[order]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.places = [where[p] for p in self.places]


def dealt(keys: np.ndarray, slots: int) -> np.ndarray:
    """Which of ``slots`` equal ranges a key is in."""
    return ((keys >> np.uint64(24)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


COUNTS = "slot int, part int, n int, keys binary, seen binary"
COUNTS_ARROW = pa.schema([(c, pa.int32()) for c in ("slot", "part", "n")] + [(c, pa.binary()) for c in ("keys", "seen")])
TOTALS = "part int, slot int, n int, background binary, target binary, words bigint, background_words bigint, target_words bigint"
TOTALS_ARROW = pa.schema(
    [(c, pa.int32()) for c in ("part", "slot", "n")]
    + [(c, pa.binary()) for c in ("background", "target")]
    + [(c, pa.int64()) for c in ("words", "background_words", "target_words")]
)
TARGET_PART = -1  # counts of target texts: nothing is sent back for them


def counts_of(table: pa.Table, slots: int, target: bool) -> pa.Table:
    forget()
    tokens = Tokens(table.column("text").combine_chunks())
    part = TARGET_PART if target else table.column("part")[0].as_py()
    slot = dealt(tokens.keys, slots)
    bounds, rows = np.r_[groups(slot), len(slot)], []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        rows.append((int(slot[a]), part, z - a, planes(np.diff(tokens.keys[a:z], prepend=np.uint64(0))), planes(tokens.seen[a:z])))
    give_back()
    return table_of(COUNTS_ARROW, rows)


def totals_of(table: pa.Table) -> pa.Table:
    """For each part with things of a slot, how often each of them occurs in either table."""
    forget()
    rows = table.select(["part", "n", "keys", "seen"]).to_pylist()
    keys = np.concatenate([np.cumsum(from_planes(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
    seen = np.concatenate([from_planes(r["seen"], r["n"]) for r in rows]).astype(np.int64)
    target = np.repeat([r["part"] == TARGET_PART for r in rows], [r["n"] for r in rows])
    order = np.argsort(keys, kind="stable")
    first = groups(keys[order])
    sizes = np.diff(np.r_[first, len(keys)])
    sides = []
    words = keys[order][first] & np.uint64(3) == WORD
    held = []
    for side in (~target, target):
        total = np.add.reduceat(np.where(side, seen, 0)[order], first)
        held.append(int(total[words].sum()))
        own = np.empty(len(keys), np.int64)
        own[order] = np.repeat(total, sizes)
        sides.append(own)
    slot, made, at = table.column("slot")[0].as_py(), [], 0
    for row in rows:
        part = slice(at, at + row["n"])
        at += row["n"]
        if row["part"] != TARGET_PART:
            made.append((row["part"], slot, row["n"], planes(sides[0][part]), planes(sides[1][part]), 0, 0, 0))
    made.append((TARGET_PART, slot, 0, b"", b"", int(words.sum()), *held))
    give_back()
    return table_of(TOTALS_ARROW, made)


# the models


@dataclass(frozen=True)
class Sizes:
    """What the models need to know of the whole: distinct words, and words in either table."""

    vocabulary: int
    background: int
    target: int


def losses(tokens: Tokens, totals: np.ndarray, own_words: int, other_words: int, vocabulary: int) -> np.ndarray:
    """Bits per word under one model.

    The larger side is scaled down to as many words as the smaller has, so
    both are smoothed alike and neither looks better for its size alone.
    """
    scale = min(own_words, other_words) / own_words if min(own_words, other_words) else 1 / max(own_words, 1)
    word, context, bigram = (totals[place] * scale for place in tokens.places)
    share = (word + 1) / (own_words * scale + vocabulary)
    return -np.log2((bigram + PRIOR_WORDS * share) / (context + PRIOR_WORDS))


SCORES = "{number} bigint, n_words bigint, target_loss double, background_loss double, difference double"
FIELDS = ["n_words", "target_loss", "background_loss", "difference"]


def scores_of(left: pa.Table, right: pa.Table, sizes: Sizes, number: str) -> pa.Table:
    forget()
    schema = pa.schema([(number, pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in FIELDS[1:])])
    if not left.num_rows:
        return schema.empty_table()
    tokens = Tokens(left.column("text").combine_chunks())
    cells = right.sort_by("slot").to_pylist()
    both = [np.concatenate([np.zeros(0, np.uint64), *(from_planes(c[side], c["n"]) for c in cells)]) for side in ("background", "target")]
    sums = []
    for totals, own, other in zip(both, (sizes.background, sizes.target), (sizes.target, sizes.background)):
        bits = losses(tokens, totals.astype(np.float64), own, other, sizes.vocabulary)
        sums.append(np.bincount(tokens.text, bits, minlength=len(tokens.counts)) / np.maximum(tokens.counts, 1))
    none = tokens.counts == 0
    means = [pa.array(c, pa.float64(), mask=none) for c in (sums[1], sums[0], sums[1] - sums[0])]
    give_back()
    return pa.Table.from_arrays([left.column(number), pa.array(tokens.counts, pa.int64()), *means], schema=schema)


def with_scores(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Adds ``n_words``, ``target_loss``, ``background_loss`` and ``difference`` in bits per word.

    ``docs`` itself is the background. The lower the difference, the more a
    document is like the target. Columns of these names are replaced. A null,
    empty or blank text has 0 words and null scores. Repeated rows count as
    often as they are there. Without target rows the target model is uniform.
    A text is in one part, however long; a task needs some ten times its bytes.
    """
    spark = docs.sparkSession
    number, part, text = fresh(docs, "number", "part", "text")
    kept = [c for c in docs.columns if c.lower() not in FIELDS]
    rows = docs.select(*quoted(*kept)) if text_col in kept else docs.select(*quoted(*kept), F.col(text_col).alias(text))
    source = text_col if text_col in kept else text
    asked = target.select(F.col(target_col).alias("text"))
    total = [t.agg(F.sum(F.octet_length(c))).first()[0] or 0 for t, c in ((rows, F.col(source)), (asked, F.col("text")))]
    parts, buckets = total[0] // part_bytes + 1, total[0] // BUCKET_BYTES + 1
    target_parts = total[1] // part_bytes + 1
    slots = sum(total) // min(SLOT_BYTES, 2 * part_bytes) + 1
    with in_parts(numbered(rows, parts, part, number), buckets, part) as (table, path):
        texts = table.select(F.col(part).alias("part"), F.col(number), F.col(source).alias("text"))
        found = texts.select("part", "text").groupBy("part").applyInArrow(lambda t: counts_of(t, slots, False), COUNTS)
        dealt_out = asked.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(target_parts)))
        wanted = dealt_out.groupBy("part").applyInArrow(lambda t: counts_of(t, slots, True), COUNTS)
        where = scratch_path(spark, "totals")
        found.unionByName(wanted).groupBy("slot").applyInArrow(totals_of, TOTALS).write.parquet(where)
        stored = spark.read.schema(TOTALS).parquet(where)
        known = stored.agg(F.sum("words"), F.sum("background_words"), F.sum("target_words")).first()
        sizes = Sizes(*(n or 0 for n in known))
        back = stored.where(F.col("part") != TARGET_PART).select("part", "slot", "n", "background", "target")
        scored = texts.groupBy("part").cogroup(back.groupBy("part"))
        where = scratch_path(spark, "scores")
        schema = SCORES.format(number=f"`{number}`")
        scored.applyInArrow(lambda a, b: scores_of(a, b, sizes, number), schema).write.parquet(where)
        shape = table.schema
    held = spark.read.schema(shape).parquet(path)
    return held.join(spark.read.schema(schema).parquet(where), number).select(*quoted(*kept), *FIELDS)
