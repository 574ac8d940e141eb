"""The quality classifier step by step against plain loops."""

import math

import numpy as np
import pytest

from passagework.llm import quality
from passagework.llm.catalog import documents

BIG = 1 << 64


def known(char):
    return char if ord(char) <= 0xFFFF else "￿"


def plain_votes(text):
    words = [[known(c) for c in w] for w in text.split()]
    if not words:
        return [quality.BAD] * quality.LABELLERS
    n = len(words)
    letters = [sum(c.isalpha() for c in w) for w in words]
    share = lambda found: sum(found) / n

    def band(value, bad_above, good_below):
        return quality.BAD if value > bad_above else quality.GOOD if value <= good_below else quality.NONE

    same = sum(a == b for a, b in zip(text.split(), text.split()[1:]))
    capitals = sum(c.isupper() and c.isalpha() for w in words for c in w)
    odd = share(not w[-1].isalnum() and w[-1] not in ".,;:?!)\"'" for w in words)
    return [
        band(share(any(c in "#*$%&|<>" for c in w) for w in words), 0.15, 0.02),
        band(share(len(w) > 1 and w[-1] in "!?" and w[-2] in "!?" for w in words), 0.10, 0.02),
        band((capitals / n) / max(sum(letters) / n, 1e-9), 0.30, 0.10),
        band(share(w == ["|"] for w in words), 0.08, 0.01),
        band(same / n, 0.15, 0.03),
        quality.NONE if n < 20 else band(-share(k <= 3 for k in letters), -0.15, -0.25),
        quality.NONE if not 20 <= n <= 2000 else band(-len(set(text.split())) / n, -0.25, -0.45),
        quality.NONE if n < 30 else band(-share(w[-1] in ".,;:" for w in words), -0.005, -0.02),
        band(odd, 0.20, 0.05),
        band(-(sum(letters) / n) / max(sum(map(len, words)) / n, 1e-9), -0.80, -0.88),
    ]


def place(values, salt):
    """The feature of some numbers at their places."""
    total = 0
    for at, value in values:
        mixed = ((value + salt) * 0x9E3779B97F4A7C15 + at) % BIG
        mixed = ((mixed ^ (mixed >> 30)) * 0xBF58476D1CE4E5B9) % BIG
        total = (total + (mixed ^ (mixed >> 27))) % BIG
    return 1 + (total ^ (total >> 31)) % (quality.FEATURES - 1)


def plain_features(text):
    words, made = text.split(), np.zeros(quality.FEATURES)
    for word in words:
        chars = [known(c) for c in word]
        kinds = [ord("A") if c.isupper() else ord("a") if c.isalpha() else ord("0") if c.isalnum() else ord(c) for c in chars]
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars]
        turns = [k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
        made[place(enumerate(turns), 1)] += 1
        made[place(enumerate(low[::-1][:3]), 2)] += 1
        made[place(enumerate(low), 3)] += 1
    made[0] = sum(a == b for a, b in zip(words, words[1:]))
    return made / (len(words) + quality.FEW_WORDS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir, odd_rows):
    short = [t if t is None else t[:20_000] for _, t in odd_rows]
    return [*(r.text for r in documents(spark, sf_dir).collect()), *(t or "" for t in short), "A!! | | | b?? C# D# D# d", "𝒳 𝒳y é"]


def test_votes_equal_plain_votes(texts):
    lexicon = quality.Lexicon()
    got = quality.patterns_of(quality.Run.of(texts, lexicon), lexicon)
    want = [sum(v * 3**i for i, v in enumerate(plain_votes(t))) for t in texts]
    assert got.tolist() == want
    assert len(set(want)) > 20


def test_features_equal_plain_features(texts):
    lexicon = quality.Lexicon()
    some = texts[::5] + texts[-18:]
    got = quality.features(quality.Run.of(some, lexicon), lexicon)
    assert np.allclose(got, [plain_features(t) for t in some])


def test_posteriors_equal_bayes_rule():
    rng = np.random.default_rng(1)
    model = quality.LabelModel(0.7, rng.uniform(0.05, 0.9, (2, quality.LABELLERS)))
    for _ in range(200):
        votes = rng.integers(0, 3, quality.LABELLERS)
        like = [1.0, 1.0]
        for i, vote in enumerate(votes):
            for truth in (0, 1):
                fault = model.fault[truth, i]
                like[truth] *= {quality.BAD: fault, quality.GOOD: 1 - fault, quality.NONE: 1.0}[int(vote)]
        want = 0.7 * like[1] / (0.7 * like[1] + 0.3 * like[0])
        assert model.posterior(np.array([votes @ quality._WEIGHTS]))[0] == pytest.approx(want)


def test_training_equals_plain_descent(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 6)
    rng = np.random.default_rng(2)
    rows, labels = rng.random((9, 6)), np.array([1, 0.9, 0.2, 0, 0.6, 0.1, 1, 0.4, 0.8])
    weights, bias = quality.train(rows, labels, 0.6, rounds=30)
    want, start = [0.0] * 6, math.log(0.6 / 0.4)
    good = [v >= 0.5 for v in labels]
    for _ in range(30):
        error = []
        for row, label, own in zip(rows, labels, good):
            guess = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(row, want)) + start)))
            error.append((guess - label) * (0.6 / sum(good) if own else 0.4 / (len(good) - sum(good))))
        want = [w - 8.0 * (sum(r[k] * e for r, e in zip(rows, error)) + 1e-4 * w) for k, w in enumerate(want)]
    assert np.allclose(weights, want) and bias == pytest.approx(start)


def test_query_equals_plain_scores(spark, texts, texts_table):
    docs = texts_table(texts)
    classifier = quality.fit(docs)
    rows = {r.doc_id: r for r in quality.with_quality(docs, classifier).collect()}
    for i, text in enumerate(texts):
        words = len(text.split())
        score = float(plain_features(text) @ classifier.weights) + classifier.bias
        want = 1 / (1 + math.exp(-score)) if words else 0.0
        assert rows[i].quality == pytest.approx(want, abs=1e-5)
        assert rows[i].kept == (rows[i].quality >= quality.KEPT_FROM)


def test_sample_is_bounded_and_not_a_prefix(spark, texts_table, monkeypatch):
    """Many equal rows: at most as many as the bound train the scorer, of whatever place."""
    seen = []
    real = quality.train

    def watched(rows, labels, share):
        seen.append(len(rows))
        return real(rows, labels, share)

    monkeypatch.setattr(quality, "train", watched)
    table = texts_table(["the same text of all rows, again and again, it is said"] * 600 + [f"other | | {i} #" for i in range(600)])
    quality.fit(table.repartition(4), sample_rows=50)
    assert 20 < seen[0] <= 50
