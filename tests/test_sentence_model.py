"""The learned sentence splitter against a plain version, and what it is for."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.functions import sentence_model as sm
from passagework.operators import chunks as ch

SHORT = ["dr.", "e.g.", "z.B.", "approx."]


def prose(seed, sentences):
    dice = random.Random(seed)
    nouns = ["river", "bridge", "town", "boat", "field", "letter", "garden", "winter", "market", "stone"]
    made = []
    for _ in range(sentences):
        words = [dice.choice(nouns) for _ in range(dice.randrange(3, 9))]
        if dice.random() < 0.5:
            words.insert(dice.randrange(1, len(words)), dice.choice(SHORT))
        first = dice.choice(["The", "The", "However,", "It", "They"])
        made.append(f"{first} {' '.join(words)}{dice.choice('...!?')}")
    return " ".join(made)


TEXTS = [prose(i, 40) for i in range(12)] + [None, "", " ", "no end", "Dr.", ". . .", "a\tb.\n\nThe end. ", "x" * 20_000]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def model(pages):
    return sm.train(pages)


def plain_type(word):
    return word.strip(sm.EDGE).lower()


def plain_model(texts, least=sm.LEAST_COUNT):
    lists = [re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for t in texts]
    total, stopped = Counter(), Counter()
    for words in lists:
        for word in words:
            kind = plain_type(word)
            if any(c.isalpha() for c in kind):
                total[kind] += 1
                stopped[kind] += word.endswith(".")
    n, share = sum(total.values()), sum(stopped.values()) / sum(total.values())
    found = {}
    for kind in total:
        k, m, letters = stopped[kind], total[kind] - stopped[kind], len(kind.replace(".", ""))
        ratio = 2 * (k * math.log(0.99 / share) + m * math.log((1 - 0.99) / (1 - share)))
        score = ratio * math.exp(-letters) * (kind.count(".") + 1) * letters**-m
        if k >= least and score >= 0.3:
            found["abbreviation", kind] = (k, total[kind], score)
    behind = Counter()
    for words in lists:
        for a, b in zip(words, words[1:]):
            short = a.endswith(".") and ("abbreviation", plain_type(a)) in found
            if a[-1] in ".!?" and not short and any(c.isalpha() for c in plain_type(b)):
                behind[plain_type(b)] += 1
    ends = sum(behind.values())

    def chance(k, of, p):
        return (k * math.log(p) if k else 0) + ((of - k) * math.log(1 - p) if of > k else 0)

    for kind, seen in behind.items():
        all_of = total[kind]
        apart = chance(seen, ends, seen / ends) + chance(all_of - seen, n - ends, (all_of - seen) / (n - ends))
        alike = chance(seen, ends, all_of / n) + chance(all_of - seen, n - ends, all_of / n)
        if seen >= least and 2 * (apart - alike) >= 30 and seen / ends > all_of / n:
            found["starter", kind] = (seen, all_of, 2 * (apart - alike))
    return found


def plain_split(text, found):
    if text is None:
        return None
    made, sentence = [], ""
    for part in re.findall(r"(?s).*?(?:[.!?][ \t\n\x0b\f\r]+|\Z)", text):
        sentence += part
        rest = text[sum(map(len, made)) + len(sentence) :]
        words, following = part.split(), rest.split()
        goes_on = words and rest and words[-1].endswith(".") and ("abbreviation", plain_type(words[-1])) in found
        if goes_on and not (rest[0].isupper() and ("starter", plain_type(following[0])) in found):
            continue
        made.append(sentence)
        sentence = ""
    return [s.rstrip(sm.BLANKS) for s in [*made, sentence] if s.rstrip(sm.BLANKS)]


def test_model_equals_plain_version(model):
    got = {(r["kind"], r["type"]): (r["seen"], r["total"], r["score"]) for r in model.table.collect()}
    want = plain_model(TEXTS)
    assert got.keys() == want.keys()
    for key, (seen, total, score) in want.items():
        assert got[key][:2] == (seen, total) and got[key][2] == pytest.approx(score)
    assert {k for k in got if k[0] == "abbreviation"} == {("abbreviation", s.rstrip(".").lower()) for s in SHORT}
    assert ("starter", "the") in got and ("starter", "river") not in got


@pytest.mark.parametrize("most", [sm.PLAN_TYPES, 1])
def test_splits_equal_plain_version(pages, model, most):
    """With the model in the plan, and with joins."""
    found = plain_model(TEXTS)
    got = {r["doc_id"]: r["sentences"] for r in sm.with_trained_sentences(pages, model, most=most).collect()}
    assert got == {i: plain_split(t, found) for i, t in enumerate(TEXTS)}


def test_abbreviations_do_not_end_sentences(spark, model):
    text = "It cost approx. ten boats. The Dr. saw it, e.g. from the bridge. He left with the Dr. The town slept."
    page = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    want = ["It cost approx. ten boats.", "The Dr. saw it, e.g. from the bridge.", "He left with the Dr.", "The town slept."]
    assert page.select(sm.trained_splitter(model)(F.col("text"))).first()[0] == want


def test_model_in_create_chunks(pages, model):
    made = ch.create_chunks(pages.withColumn("page_number", F.lit(1)), splitter=sm.trained_splitter(model))
    assert made.where("sentence_chunk like '%Dr. %'").count() == 0  # seams are joined without a blank as ever
    assert made.count() > 30


def test_large_model_is_not_put_into_the_plan(model):
    with pytest.raises(ValueError, match="with_trained_sentences"):
        sm.trained_splitter(model, most=2)


def test_model_of_no_text_splits_like_the_rule(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sm.train(empty).table.count() == 0
    only_stops = spark.createDataFrame([(1, "a. b. c.")], "doc_id bigint, text string")
    untaught = sm.train(only_stops)
    assert untaught.table.count() == 0
    split = sm.with_trained_sentences(only_stops, untaught).first()
    assert (split["sentences"], split["page_sentence_count"]) == (["a.", "b.", "c."], 3)


def test_model_can_be_kept(spark, pages, model, tmp_path):
    model.save(str(tmp_path / "model"))
    again = sm.SentenceModel.load(spark, str(tmp_path / "model"))
    assert sorted(again.table.collect()) == sorted(model.table.collect())


def test_counts_are_added_up_before_the_shuffle(pages):
    plan = sm.type_counts(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # printed from the last step to the first
    assert "Python" not in plan
