"""Sentence ends learned from the texts: which words are abbreviations, which begin sentences.

Unsupervised, by log-likelihood ratios over counts of word types in the whole
corpus (Kiss and Strunk 2006). A type that nearly always has a full stop behind
it, and is short, is an abbreviation. A type that follows a sentence end more
often than chance has it is a sentence starter. A full stop behind an
abbreviation ends a sentence only if a starter with a capital follows.

Training is a few aggregates, added up in the tasks first; the model is a table
with one row per type, above a least count. Splitting looks types up in that
table: as a set in the plan while the model is small, and by joins beyond that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import Splitter
from passagework.session import scratch_path

# Fixed values of the published method: how sure an abbreviation is of its full
# stop, and the scores from which a type counts as one or as a starter.
SURE = 0.99
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0

LEAST_COUNT = 3
PLAN_TYPES = 1 << 15  # a model of at most so many types becomes part of the plan

EDGE = "\"'()[]{}<>,;:!?.*_“”„‘’«»"
BLANKS = " \t\n\x0b\x0c\r"

# words in a row that end sentences, and the one behind them
SENTENCE_SEAM = r"(?<!\S)\S++(?<=[.!?])(?:\s++\S++(?<=[.!?]))*+(?:\s++\S++)?"

MODEL_SCHEMA = "kind string, type string, seen bigint, total bigint, score double"
ABBREVIATION, STARTER = "abbreviation", "starter"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda word: word != "")


def word_type(word: Column) -> Column:
    """A word as it is counted: lower case, without the marks around it."""
    return F.lower(F.btrim(word, F.lit(EDGE)))


def is_counted(kind: Column) -> Column:
    return kind.rlike(r"\p{L}")


# training


def type_counts(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``type, stopped, total`` of every word type with a letter: how often, and how often with a full stop behind it."""
    found = pages.select(F.explode(F.split(F.col(text_col), r"\s+", -1)).alias("word")).where("word <> ''")
    typed = found.select(word_type(F.col("word")).alias("type"), F.endswith("word", F.lit(".")).alias("stop"))
    return counted_only(typed.groupBy("type").agg(F.count_if("stop").alias("stopped"), F.count("*").alias("total")), "total")


def counted_only(groups: DataFrame, count: str) -> DataFrame:
    """Groups whose type has a letter: looked for once for each type, and not below the aggregate for each word."""
    return groups.where(F.when(F.col(count) > 0, is_counted(F.col("type"))))


def abbreviations(counts: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``type, stopped, total, score`` of the types that are abbreviations."""
    total, stopped = counts.agg(F.sum("total"), F.sum("stopped")).first()
    share = stopped / total if total else 0.0
    if not 0 < share < 1:
        return counts.where(F.lit(False)).withColumn("score", F.lit(0.0))
    with_stop, without = F.col("stopped"), F.col("total") - F.col("stopped")
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    ratio = 2 * (with_stop * F.log(F.lit(SURE / share)) + without * F.log(F.lit((1 - SURE) / (1 - share))))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -without)
    return counts.where(with_stop >= least_count).withColumn("score", score).where(F.col("score") >= ABBREVIATION_SCORE)


def followers(pages: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``type, seen``: how often each type stands behind a sentence end of the same page, abbreviations not counted as ends."""

    seams = pages.select(F.explode(F.regexp_extract_all(text_col, F.lit(SENTENCE_SEAM), F.lit(0))).alias("seam"))
    listed = seams.select(F.split("seam", r"\s+", -1).alias("words")).where(F.size("words") > 1)
    pairs = F.arrays_zip(F.slice("words", 1, F.size("words") - 1).alias("before"), F.slice("words", 2, F.size("words") - 1).alias("word"))
    found = listed.select(F.inline(pairs).alias("before", "word"))
    stopped = F.endswith("before", F.lit("."))
    typed = found.select(F.when(stopped, word_type(F.col("before"))).alias("before"), word_type(F.col("word")).alias("type"))
    counted = typed.groupBy("before", "type").agg(F.count("*").alias("seen"))
    ends = counted.join(known.select(F.col("type").alias("before")), "before", "left_anti")
    return counted_only(ends.groupBy("type").agg(F.sum("seen").alias("seen")), "seen")


def _chance(hits: Column, tries: Column, share: Column) -> Column:
    """The logarithm of the likelihood of so many hits, without the constant."""
    misses = tries - hits
    return F.when(hits > 0, hits * F.log(share)).otherwise(0.0) + F.when(misses > 0, misses * F.log(1 - share)).otherwise(0.0)


def starters(behind: DataFrame, counts: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``type, seen, total, score`` of the types that begin sentences more often than chance has it."""
    every = counts.agg(F.sum("total")).first()[0] or 0
    ends = behind.agg(F.sum("seen")).first()[0] or 0
    joined = behind.where(F.col("seen") >= least_count).join(counts.select("type", "total"), "type")
    seen, total = F.col("seen").cast("double"), F.col("total").cast("double")
    n, m = F.lit(float(every)), F.lit(float(ends))
    after, elsewhere = seen / m, (total - seen) / (n - m)
    alike = _chance(seen, m, total / n) + _chance(total - seen, n - m, total / n)
    apart = _chance(seen, m, after) + _chance(total - seen, n - m, elsewhere)
    scored = joined.withColumn("score", 2 * (apart - alike))
    return scored.where((F.col("score") >= STARTER_SCORE) & (after > total / n)).select("type", "seen", "total", "score")


@dataclass(frozen=True)
class SentenceModel:
    """A table of types: ``kind, type, seen, total, score``."""

    table: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.table.where(F.col("kind") == kind).select("type")

    def save(self, path: str, mode: str = "error") -> None:
        self.table.write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentenceModel:
        return SentenceModel(spark.read.schema(MODEL_SCHEMA).parquet(path))


def train(pages: DataFrame, text_col: str = "text", least_count: int = LEAST_COUNT, path: str | None = None) -> SentenceModel:
    """A model of all texts, stored at ``path`` or in the shared folder.

    A null or empty text has no words. Without a text, or where no word or
    every word has a full stop behind it, the model is empty, and splits like
    the rule splitter.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "sentence-model")
    kept = scratch_path(spark, "types")
    type_counts(pages, text_col).write.parquet(kept)
    counts = spark.read.schema("type string, stopped bigint, total bigint").parquet(kept)
    short = abbreviations(counts, least_count).select(F.lit(ABBREVIATION).alias("kind"), "type", F.col("stopped").alias("seen"), "total", "score")
    short.write.parquet(path)
    known = SentenceModel.load(spark, path).of(ABBREVIATION)
    kept = scratch_path(spark, "followers")
    followers(pages, known, text_col).write.parquet(kept)
    behind = spark.read.schema("type string, seen bigint").parquet(kept)
    first = starters(behind, counts, least_count).select(F.lit(STARTER).alias("kind"), "type", "seen", "total", "score")
    first.write.mode("append").parquet(path)
    return SentenceModel.load(spark, path)


# splitting


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fragments(text: Column) -> Column:
    """The text cut behind every ``.``, ``!`` or ``?`` with its blanks; joined they are the text again."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]*+(?:[.!?](?!\s)[^.!?]*+)*+(?:[.!?]\s++)?"), F.lit(0)), lambda part: part != "")


def last_word(part: Column) -> Column:
    return F.regexp_extract(part, r"(?<!\S)(\S++)\s*+\z", 1)


def first_word(part: Column) -> Column:
    return F.regexp_extract(part, r"\A\S++", 0)


def begins_with_capital(part: Column) -> Column:
    return part.rlike(r"\A\p{Lu}")


def _together(part: Column, following: Column, short: Callable[[Column], Column], first: Callable[[Column], Column]) -> Column:
    """Whether a sentence goes on behind a fragment."""
    stopped = F.endswith(F.rtrim(part, F.lit(BLANKS)), F.lit("."))
    return stopped & short(word_type(last_word(part))) & ~(begins_with_capital(following) & first(word_type(first_word(following))))


def _merged(parts: Column, goes_on: Callable[[Column], Column]) -> Column:
    """Fragments joined where a sentence goes on behind the fragment of a place."""

    def cut(ends: Column) -> Column:
        def sentence(end: Column, k: Column) -> Column:
            start = F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(0)
            return F.rtrim(F.array_join(F.slice(parts, start + 1, end - start + 1), ""), F.lit(BLANKS))

        return F.array_remove(F.transform(ends, sentence), "")

    places = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return _bound(F.filter(places, lambda i: (i == F.size(parts) - 1) | ~goes_on(i)), cut)


def trained_splitter(model: SentenceModel, most: int = PLAN_TYPES) -> Splitter:
    """A splitter for ``create_chunks`` and ``ingest``: the types are a hash set in the plan.

    A model of more than ``most`` types does not fit there; ``with_trained_sentences`` takes it.
    """
    found = model.table.select("kind", "type").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} types: use with_trained_sentences")
    short, first = ([r["type"] for r in found if r["kind"] == kind] for kind in (ABBREVIATION, STARTER))

    def among(types: list[str]) -> Callable[[Column], Column]:
        return lambda kind: kind.isin(types) if types else F.lit(False)

    def split(text: Column) -> Column:
        def merged(parts: Column) -> Column:
            return _merged(parts, lambda i: _together(F.get(parts, i), F.get(parts, i + 1), among(short), among(first)))

        return F.when(text.isNotNull(), _bound(fragments(text), merged))

    return split


def joined_sentences(pages: DataFrame, model: SentenceModel, text_col: str = "text") -> DataFrame:
    """``pages`` and their ``sentences``, types looked up by joins: for a model of any size.

    Only fragment ends with a full stop are rows on the way; the fragments of a
    page stay in one row and are joined with the places where they go on.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "fragments")
    rows = pages.withColumn("page_row", F.monotonically_increasing_id()).withColumn("parts", fragments(F.col(text_col)))
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)

    def seam(i: Column) -> Column:
        part, following = F.get(F.col("parts"), i), F.get(F.col("parts"), i + 1)
        return F.struct(
            i.alias("place"),
            F.endswith(F.rtrim(part, F.lit(BLANKS)), F.lit(".")).alias("stopped"),
            word_type(last_word(part)).alias("last"),
            F.when(begins_with_capital(following), word_type(first_word(following))).alias("next"),
        )

    places = F.when(F.size("parts") > 1, F.sequence(F.lit(0), F.size("parts") - 2)).otherwise(F.array().cast("array<int>"))
    seams = F.filter(F.transform(places, seam), lambda s: s["stopped"])
    ends = stored.select("page_row", F.explode(seams).alias("s")).select("page_row", "s.place", "s.last", "s.next")
    after_short = ends.join(model.of(ABBREVIATION).withColumnRenamed("type", "last"), "last", "left_semi")
    on = after_short.join(model.of(STARTER).withColumnRenamed("type", "next"), "next", "left_anti")
    going = on.groupBy("page_row").agg(F.collect_list("place").alias("going"))
    joined = stored.join(going, "page_row", "left").withColumn("going", F.coalesce("going", F.array().cast("array<int>")))
    made = _merged(F.col("parts"), lambda i: F.array_contains(F.col("going"), i))
    return joined.withColumn("sentences", F.when(F.col(text_col).isNotNull(), made)).select(*pages.columns, "sentences")


def with_trained_sentences(pages: DataFrame, model: SentenceModel, text_col: str = "text", most: int = PLAN_TYPES) -> DataFrame:
    """Adds ``sentences`` and ``page_sentence_count``; the lookup follows the size of the model."""
    if model.table.limit(most + 1).count() <= most:
        split = pages.withColumn("sentences", trained_splitter(model, most)(F.col(text_col)))
    else:
        split = joined_sentences(pages, model, text_col)
    return split.withColumn("page_sentence_count", F.size("sentences").cast("bigint"))
