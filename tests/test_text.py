import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import text as tx

EDGES = [
    "", " ", "  ", "a    b", ". ", "end. ", "x.Y.Z", "x.É", "What?Yes", "a. b. c", "..  ..", "a\nb\n",
    " hi　", "\x1fz\t", "😀 b. C", " x ", "a  b   c    d", ". . . ", "Mr. X left. He ran! Why? No.",
    "one.Two.three.Four", "​kept​", "\x85next line ",
]


def python_rules(t):
    page = t.replace("\n", " ").strip()
    return {
        "page": page,
        "chars": len(page),
        "words": len(page.split(" ")),
        "raw": len(page.split(". ")),
        "tokens": len(page) / 4,
        "chunk": re.sub(r"\.([A-Z])", r". \1", page.replace("  ", " ").strip()),
    }


def spark_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    page = tx.normalize(F.col("t"))
    out = df.select(
        "i",
        page.alias("page"),
        tx.char_count(page).alias("chars"),
        tx.word_count(page).alias("words"),
        tx.raw_sentence_count(page).alias("raw"),
        tx.token_estimate(page).alias("tokens"),
        tx.join_sentences(F.array(page)).alias("chunk"),
    )
    return [{k: v for k, v in r.asDict().items() if k != "i"} for r in out.orderBy("i").collect()]


def test_edge_strings(spark):
    assert spark_rules(spark, EDGES) == [python_rules(t) for t in EDGES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB. \n\t!?é　\xa0😀"), max_size=30), min_size=20, max_size=40))
def test_random_strings(spark, texts):
    assert spark_rules(spark, texts) == [python_rules(t) for t in texts]


def test_strip_equals_python_for_every_character(spark):
    characters = [c for c in map(chr, range(1, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    spaces = sorted(c for c in characters if not c.strip())
    assert sorted(tx.WHITESPACE) == spaces
    df = spark.createDataFrame([(f"{c}x{c}y{c}",) for c in [*spaces, "​", "﻿", "_"]], "t string")
    for row in df.select("t", tx.strip(F.col("t")).alias("s")).collect():
        assert row.s == row.t.strip()


@pytest.mark.parametrize("count", [0, 1, 9, 10, 11, 20])
@pytest.mark.parametrize("size", [1, 5, 10])
def test_slices(spark, count, size):
    items = [f"s{i}" for i in range(count)]
    df = spark.createDataFrame([(items,)], "s array<string>")
    got = df.select(tx.slices(F.col("s"), size).alias("g")).first().g
    assert got == [items[i : i + size] for i in range(0, count, size)]


def sentences_of(spark, text, splitter=tx.sentences):
    return spark.createDataFrame([(text,)], "t string").select(splitter(F.col("t")).alias("s")).first().s


def test_sentences(spark):
    assert sentences_of(spark, "") == []
    assert sentences_of(spark, "end. ") == ["end."]
    assert sentences_of(spark, "One. Two!  Three? 3.5 is one.x") == ["One.", "Two!", "Three?", "3.5 is one.x"]
    assert sentences_of(spark, "Dr. Who left. Bye.") == ["Dr.", "Who left.", "Bye."]


def test_sentences_with_abbreviations(spark):
    splitter = tx.sentence_splitter(["Dr.", "etc"])
    assert sentences_of(spark, "Dr. Who left etc. and ran. Fdr. Bye.", splitter) == [
        "Dr. Who left etc. and ran.",
        "Fdr.",
        "Bye.",
    ]


def test_joiner_option(spark):
    df = spark.createDataFrame([(["What?", "Yes.", "No."],)], "s array<string>")
    assert df.select(tx.join_sentences(F.col("s"))).first()[0] == "What?Yes. No."
    assert df.select(tx.join_sentences(F.col("s"), " ")).first()[0] == "What? Yes. No."
