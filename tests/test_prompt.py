import pytest

from passagework.operators import prompt as pr

HITS = "qid bigint, rank int, sentence_chunk string"


@pytest.fixture
def hits(spark):
    rows = [(1, 2, "second"), (1, 1, "first {query}"), (2, 1, "only")]
    return spark.createDataFrame(rows, HITS)


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([(1, "why {context}?"), (2, "what?"), (3, "nothing?")], "qid bigint, text string")


def test_context_is_in_rank_order(hits):
    got = {r.qid: r.context for r in pr.context_blocks(hits).collect()}
    assert got == {1: "- first {query}\n- second", 2: "- only"}


def test_template_slots(hits, requests):
    got = {r.qid: r.prompt for r in pr.prompts(requests, hits, "C={context} Q={query} {other}").collect()}
    assert got == {
        1: "C=- first {query}\n- second Q=why {context}? {other}",
        2: "C=- only Q=what? {other}",
        3: "C=-  Q=nothing? {other}",
    }


def test_messages_and_answers(hits, requests):
    prompted = pr.prompts(requests, hits, "{query}|{context}")
    messages = {r.qid: [(m.role, m.content) for m in r.messages] for r in pr.chat_messages(prompted).collect()}
    assert messages[2] == [("user", "what?|- only")]
    answers = {r.qid: (r.query, r.results) for r in pr.answer_rows(prompted).collect()}
    assert answers[2] == ("what?", "what?|- only")


def test_default_template_has_both_slots():
    assert pr.DEFAULT_TEMPLATE.count("{context}") == pr.DEFAULT_TEMPLATE.count("{query}") == 1
