"""Decontamination, language-model scores and the pipeline, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from passagework.llm import catalog, decontaminate, lm_score, quality, secrets, simhash


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(words))


def edited(text, edits, seed):
    rng = random.Random(seed)
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "#" + text[at:], text[:at] + "#" + text[at + 1 :]])
    return text


def least_edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    chars = np.array(list(text))
    for i, c in enumerate(pattern, 1):
        step = np.r_[i, np.minimum(row[:-1] + (chars != c), row[1:] + 1)]
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return row.min()


def plain_leaks(texts, items):
    found = set()
    for d, text in enumerate(texts):
        whole = decontaminate.normal(text or "")
        for i, item in items:
            edits = [(least_edits(w, whole), w) for w in decontaminate.windows(item or "")]
            hits = {w for e, w in edits if e <= int(len(w) * decontaminate.ERRORS)}
            if hits:
                found.add((d, i, min(e for e, w in edits if w in hits)))
    return found


@pytest.fixture(scope="module")
def leaking():
    items = [(i, prose(100 + i, 30)) for i in range(12)] + [(20, "too short"), (21, None), (22, prose(5, 8)), (23, prose(105, 30))]
    texts = []
    for d in range(40):
        own = prose(d, 80)
        item = items[d % 12][1]
        piece = [item, item.upper(), edited(item, 8, d), edited(item, 25, d), item[: len(item) // 2], item.replace(" ", " \n\t"), "", item[:60]][d % 8]
        texts.append(own[:200] + " " + piece + " " + own[200:])
    return texts + [items[0][1] * 5, "", None, items[14][1], prose(5, 8)], items


def test_leaks_equal_plain_alignment(spark, texts_table, leaking):
    texts, items = leaking
    got = decontaminate.leaks(texts_table(texts), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == plain_leaks(texts, items)


def test_leaks_in_blocks(spark, texts_table, leaking, monkeypatch):
    texts, items = leaking
    table = spark.createDataFrame(items, "item_id bigint, text string")
    once = sorted(map(tuple, decontaminate.leaks(texts_table(texts), table).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 7)
    assert sorted(map(tuple, decontaminate.leaks(texts_table(texts), table).collect())) == once
    left = {r.doc_id for r in decontaminate.without_leaks(texts_table(texts), table).collect()}
    assert left == set(range(len(texts))) - {d for d, *_ in once}


def test_pairs_are_counted_in_parts(leaking, monkeypatch):
    texts, items = leaking
    rows = [(i, w) for i, t in items for w in decontaminate.windows(t or "")]
    index = decontaminate.WindowIndex([i for i, _ in rows], [w for _, w in rows])
    plain = [t or "" for t in texts]
    whole = index.leaks(plain)
    monkeypatch.setattr(decontaminate, "RUN_PAIRS", 50)
    monkeypatch.setattr(decontaminate, "ALIGNED_AT_ONCE", 3)
    assert index.leaks(plain) == whole


def test_every_planted_passage_is_found(spark, sf_dir):
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontaminate.normal(r.text) for r in catalog.documents(spark, sf_dir).collect()}
    want = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    got = {(r.doc_id, r.item_id) for r in catalog.op8_decontaminate(spark, sf_dir).collect()}
    assert want and got == want


def test_verbatim_excerpts_are_found_at_every_offset():
    """Without windows(): an excerpt of the item stands in a text or it does not."""
    item = prose(300, 40)
    index = decontaminate.WindowIndex(*zip(*[(7, w, s) for s, w in decontaminate.cuts(item)]))
    for length in (60, 80, 100):
        texts = [f"{prose(301, 30)} | {item[at : at + length].strip()} | {prose(302, 30)}" for at in range(len(item) - length + 1)]
        texts += [prose(303, 90), prose(304, 90)]
        got = [bool(found) for found in index.leaks(texts)]
        assert got == [True] * (len(texts) - 2) + [False] * 2


def test_alignments_equal_plain_alignment():
    items = [prose(400 + i, 30) for i in range(4)] + [prose(410, 7)]
    rows = [(i, w, s) for i, t in enumerate(items) for s, w in decontaminate.cuts(t)]
    index = decontaminate.WindowIndex(*zip(*rows))
    for d in range(12):
        piece = edited(items[d % 5], (2, 5, 9, 14)[d % 4], d)
        text = decontaminate.normal(f"{prose(420 + d, 20)} {piece} {prose(440 + d, 20)}")
        want = {}
        for i, w, _ in rows:
            if (least := least_edits(w, text)) <= int(len(w) * decontaminate.ERRORS):
                n, best = want.get(i, (0, 1000))
                want[i] = n + 1, min(best, least)
        assert {i: (n, e) for i, n, e in index.leaks([text])[0]} == want


def test_leaks_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[3][1]), (2, None), (None, odd_rows[3][1]), (3, "")], "item_id bigint, text string")
    rows = decontaminate.leaks(odd_docs, items).collect()
    assert {r.item_id for r in rows} == {1} and sum(r.doc_id == 4 for r in rows) >= 3
    left = decontaminate.without_leaks(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == len(odd_rows) - len(rows)
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd_docs, items.limit(0)).count() == len(odd_rows)


def test_items_without_id_take_their_documents_out(spark, texts_table):
    items = spark.createDataFrame([(None, prose(1, 30)), (None, prose(2, 30)), (3, None)], "item_id bigint, text string")
    docs = texts_table([prose(1, 30) + " end", prose(9, 40), "start " + prose(2, 30)])
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [1]


# language models


@pytest.mark.parametrize("part_bytes", [600, lm_score.PART_BYTES])
@pytest.mark.parametrize("many", [False, True])
def test_scores_equal_plain_models(texts_table, part_bytes, many):
    docs = [prose(i, 40) + " The end." for i in range(20)] + ["", None, "unseen"] + [prose(3, 40)] * 3
    target = [prose(i, 25) for i in range(15, 30)]
    if many:  # far more words and bigrams than any table of fixed size here would hold
        dice = random.Random(3)
        docs += [" ".join(f"w{dice.randrange(60_000)}" for _ in range(4000)) for _ in range(40)]
        target += [" ".join(f"w{dice.randrange(60_000)}" for _ in range(2000)) for _ in range(10)]
        part_bytes *= 100
    rows = lm_score.with_scores(texts_table(docs), texts_table(target), part_bytes=part_bytes).orderBy("doc_id").collect()
    sides = [[t or "" for t in docs], target]
    lists = [[["<s>", *(lm_score.plain(w) for w in t.split())] for t in side] for side in sides]
    types = len({w for side in lists for t in side for w in t[1:]})
    assert not many or types > 50_000
    total = [sum(len(t) - 1 for t in side) for side in lists]
    models = []
    for side, n in zip(lists, total):
        scale = min(total) / n
        uni = Counter({w: c * scale for w, c in Counter(w for t in side for w in t[1:]).items()})
        context = Counter({w: c * scale for w, c in Counter(w for t in side for w in t[:-1]).items()})
        pair = Counter({w: c * scale for w, c in Counter(p for t in side for p in zip(t, t[1:])).items()})
        models.append((uni, context, pair, sum(uni.values()) + types))

    def loss(model, text):
        uni, context, pair, mass = model
        mu = lm_score.PRIOR_WORDS
        bits = [-math.log2((pair[a, b] + mu * (uni[b] + 1) / mass) / (context[a] + mu)) for a, b in zip(text, text[1:])]
        return sum(bits) / len(bits)

    for row, text in zip(rows, lists[0]):
        assert row.n_words == len(text) - 1
        if row.n_words:
            assert row.background_loss == pytest.approx(loss(models[0], text)) and row.target_loss == pytest.approx(loss(models[1], text))
            assert row.difference == pytest.approx(row.target_loss - row.background_loss)
        else:
            assert row.target_loss is row.background_loss is row.difference is None


def test_target_like_documents_score_lower(texts_table):
    own, other = [prose(i % 5, 60) for i in range(40)], [prose(50 + i % 5, 60) for i in range(40)]
    scored = lm_score.with_scores(texts_table(own + other), texts_table([prose(i % 5, 60) for i in range(10)])).orderBy("doc_id").collect()
    assert max(r.difference for r in scored[:40]) < min(r.difference for r in scored[40:])


def test_scores_of_odd_rows(odd_docs, no_docs, odd_rows):
    rows = lm_score.with_scores(odd_docs, odd_docs).collect()
    assert len(rows) == len(odd_rows) and all(r.difference is None or abs(r.difference) < 1e-9 for r in rows)
    assert lm_score.with_scores(no_docs, odd_docs).count() == 0
    assert lm_score.with_scores(odd_docs, no_docs).count() == len(odd_rows)


# pipeline


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        made = stage(spark, kept, sf_dir)
        rows = {r.doc_id: r for r in made.collect()}
        assert made.columns == columns and rows.keys() <= before.keys()
        if name == "quality classifier":
            model = quality.fit(kept)
            assert rows.keys() == {r.doc_id for r in quality.with_quality(kept, model).collect() if r.kept}
        elif name == "near duplicates":
            assert rows.keys() == {r.component_id for r in simhash.near_duplicates(kept).collect()}
        elif name == "decontamination":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            leaked = {d for d, r in before.items() if any(i in decontaminate.normal(r.text) for i in items)}
            assert rows.keys() == before.keys() - leaked
        else:
            assert rows.keys() == before.keys()
            for d, row in rows.items():
                assert row.text == secrets.masked(before[d].text) and row.n_chars == len(row.text)
                assert secrets.scan(row.text)[0] == []
        kept = spark.createDataFrame(made.collect(), made.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.collect()} == rows.keys()
    whole = {(r.doc_id, r.start, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "doc_tokens").collect() if r.start == 0}
    assert {d for d, *_ in whole} == rows.keys()


def test_stages_take_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns
            made.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
