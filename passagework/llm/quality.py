"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. How often each
pattern of votes occurs, at most 3^10 numbers, is all that expectation
maximisation needs to estimate the accuracy of each labeller, over all
documents. The posterior of a pattern labels a bounded sample, and a hashed
linear scorer is trained on it, which then judges every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import computed, fresh, per_worker, quoted, runs_of, texts, with_fields

# Parameters of the scorer: hashed features, and how many documents it is trained on at most.
FEATURES = 2048
SAMPLE_ROWS = 4096
KEPT_FROM = 0.5
RUN_CHARS = 1 << 20
LEXICON_WORDS = 1 << 17
FEW_WORDS = 12  # added to the length of a document: so many words say little

GOOD, BAD, NONE = 2, 0, 1


class CharTable:
    """What the labellers and features ask of a character, by code point of the basic plane."""

    def __init__(self):
        chars = [chr(i) for i in range(1 << 16)]
        self.alpha = np.array([c.isalpha() for c in chars])
        self.upper = np.array([c.isupper() for c in chars])
        self.alnum = np.array([c.isalnum() for c in chars])
        self.symbol = np.isin(np.arange(1 << 16), [ord(c) for c in "#*$%&|<>"])
        self.shout = np.isin(np.arange(1 << 16), [ord(c) for c in "!?"])
        self.stop = np.isin(np.arange(1 << 16), [ord(c) for c in ".,;:"])
        self.close = self.stop | np.isin(np.arange(1 << 16), [ord(c) for c in "?!)\"'"])
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint64)
        kind = np.where(self.alpha, ord("a"), np.where(self.alnum, ord("0"), np.arange(1 << 16)))
        self.kind = np.where(self.upper, ord("A"), kind).astype(np.uint64)  # ``Word,`` is ``Aa,``


def _hashed(values: np.ndarray, place: np.ndarray, used: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A feature for each word, from numbers and places of those of its characters that are used."""
    mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(np.where(used, mixed ^ (mixed >> np.uint64(27)), np.uint64(0)), starts)
    return 1 + ((total ^ (total >> np.uint64(31))) % np.uint64(FEATURES - 1)).astype(np.int32)


class Lexicon:
    """Facts and features of every word seen; emptied when it has grown too large.

    Facts: symbol, shout, bar, stop, short, letters, capitals, odd end, length.
    Features: the places of the shape, the ending and the word itself; place 0
    is for repeats.
    """

    def __init__(self):
        self.chars = CharTable()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.facts, self.places = np.zeros((0, 9), np.int32), np.zeros((0, 3), np.int32)

    def describe(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Facts and features of words, none of them empty."""
        table = self.chars
        length = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(length) - length
        ends = starts + length - 1
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points > 0xFFFF, 0xFFFF, points)
        last, before = points[ends], points[np.maximum(ends - 1, 0)]
        letters = np.add.reduceat(table.alpha[points], starts, dtype=np.int64)
        facts = [
            np.add.reduceat(table.symbol[points], starts, dtype=np.int64) > 0,
            (length > 1) & table.shout[last] & table.shout[before],
            (length == 1) & (last == ord("|")),
            table.stop[last],
            letters <= 3,
            letters,
            np.add.reduceat(table.upper[points] & table.alpha[points], starts, dtype=np.int64),
            ~table.alnum[last] & ~table.close[last],
            length,
        ]
        place = np.arange(len(points)) - np.repeat(starts, length)
        from_end = np.repeat(ends, length) - np.arange(len(points))
        kind, low = table.kind[points], table.lower[points]
        turns = np.r_[True, kind[1:] != kind[:-1]] | (place == 0)  # a run of one kind counts once
        turn = np.cumsum(turns)
        turn -= np.repeat(turn[starts], length)
        places = [
            _hashed(kind, turn, turns, starts, 1),
            _hashed(low, from_end, from_end < 3, starts, 2),
            _hashed(low, place, place >= 0, starts, 3),
        ]
        return np.stack(facts, axis=1).astype(np.int32), np.stack(places, axis=1)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > LEXICON_WORDS:
            self.clear()
        new = list(set(words) - self.number.keys())
        if new:
            facts, places = self.describe(new)
            self.facts, self.places = np.concatenate([self.facts, facts]), np.concatenate([self.places, places])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


@dataclass
class Run:
    """The words of a run of texts, as numbers of a lexicon."""

    split: list[list[str]]
    number: np.ndarray
    counts: np.ndarray
    same: np.ndarray  # by text: words equal to the one before

    @staticmethod
    def of(run: list[str], lexicon: Lexicon) -> Run:
        split = [t.split() for t in run]
        counts = np.array([len(w) for w in split], np.int64)
        number = lexicon.numbers(list(chain.from_iterable(split)))
        doc = np.repeat(np.arange(len(run)), counts)
        same = (number[1:] == number[:-1]) & (doc[1:] == doc[:-1])
        return Run(split, number, counts, np.bincount(doc[1:][same], minlength=len(run)))

    def kinds(self) -> np.ndarray:
        """Different words of each text."""
        return np.array([len(set(w)) for w in self.split], np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        total = np.zeros((len(self.counts), *values.shape[1:]))
        some = self.counts > 0
        if some.any():
            total[some] = np.add.reduceat(values, (np.cumsum(self.counts) - self.counts)[some], axis=0)
        return total


def _band(value: np.ndarray, bad_above: float, good_below: float) -> np.ndarray:
    return np.where(value > bad_above, BAD, np.where(value <= good_below, GOOD, NONE))


def patterns_of(run: Run, lexicon: Lexicon) -> np.ndarray:
    """The votes of all labellers on each text, as one number."""
    n = np.maximum(run.counts, 1)
    facts = run.sums(lexicon.facts[run.number])
    symbol, shout, bar, stop, short, letters, capitals, odd, length = facts.T / n
    cast = [
        _band(symbol, 0.15, 0.02),
        _band(shout, 0.10, 0.02),
        _band(capitals / np.maximum(letters, 1e-9), 0.30, 0.10),
        _band(bar, 0.08, 0.01),
        _band(run.same / n, 0.15, 0.03),
        np.where(n < 20, NONE, _band(-short, -0.15, -0.25)),
        np.where((n < 20) | (n > 2000), NONE, _band(-run.kinds() / n, -0.25, -0.45)),
        np.where(n < 30, NONE, _band(-stop, -0.005, -0.02)),
        _band(odd, 0.20, 0.05),
        _band(-letters / np.maximum(length, 1e-9), -0.80, -0.88),
    ]
    votes = np.where(run.counts[:, None] == 0, BAD, np.stack(cast, axis=1))
    return votes @ _WEIGHTS


LABELLERS = 10
_WEIGHTS = 3 ** np.arange(LABELLERS)


# The first guess: a labeller that finds fault is seldom wrong, and each finds only some of the faults.
FAULT_IF_BAD, FAULT_IF_GOOD, GOOD_SHARE = 0.4, 0.02, 0.8
PRIOR_SHARE = 0.01  # weight of the first guess, in documents per document


@dataclass
class LabelModel:
    """The share of good documents, and how often each labeller finds fault given the truth."""

    prior: float
    fault: np.ndarray  # [truth, labeller]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern. Who does not vote says nothing."""
        given = (patterns[:, None] // _WEIGHTS) % 3
        logs = np.stack([np.log(self.fault), np.zeros_like(self.fault), np.log(1 - self.fault)])
        each = logs[given, :, np.arange(LABELLERS)].sum(axis=1).T  # [truth, pattern]
        bad, good = each + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation maximisation over the patterns of all documents."""
    first = np.repeat([[FAULT_IF_BAD], [FAULT_IF_GOOD]], LABELLERS, axis=1)
    model = LabelModel(GOOD_SHARE, first)
    given = (patterns[:, None] // _WEIGHTS) % 3
    trust = 1 + PRIOR_SHARE * counts.sum()
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([counts * (1 - good), counts * good])
        faults, votes_cast = weight @ (given == BAD), weight @ (given != NONE)
        fault = np.clip((faults + trust * first) / (votes_cast + trust), 1e-6, 1 - 1e-6)
        prior = float((weight[1].sum() + GOOD_SHARE) / (counts.sum() + 1))
        done = np.abs(fault - model.fault).max() < 1e-9
        model = LabelModel(prior, fault)
        if done:
            break
    return model


# the scorer


def features(run: Run, lexicon: Lexicon) -> np.ndarray:
    """Shares of the features in each text; of a few words they are small."""
    made = np.zeros((len(run.counts), FEATURES))
    doc = np.repeat(np.arange(len(run.counts)), 3 * run.counts)
    np.add.at(made, (doc, lexicon.places[run.number].ravel()), 1)
    made[:, 0] = run.same
    return made / (run.counts + FEW_WORDS)[:, None]


def train(rows: np.ndarray, labels: np.ndarray, good_share: float, rounds: int = 400, rate: float = 8.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, each class weighted with its share of all documents.

    The bias stays at the share of good documents, which decides where words say little.
    """
    weights, bias = np.zeros(FEATURES), float(np.log(good_share / (1 - good_share)))
    good = labels >= 0.5
    if not good.any() or good.all():
        return weights, bias  # one class only: nothing to tell apart
    weight = np.where(good, good_share / good.sum(), (1 - good_share) / (~good).sum())
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(rows @ weights.astype(rows.dtype) + bias, -50, 50))) - labels) * weight
        weights -= rate * (rows.T @ error.astype(rows.dtype) + ridge * weights)
    return weights, bias


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Label model over all documents; scorer on at most ``sample_rows`` of them, half from either class."""

    def count():
        lexicon = per_worker("lexicon", Lexicon)

        def work(batch: pa.Array) -> list[pa.Array]:
            found = [patterns_of(Run.of(run, lexicon), lexicon) for run in runs_of(texts(batch), len, RUN_CHARS)]
            return [pa.array(np.concatenate(found) if found else [], pa.int64())]

        return work

    (holder,) = fresh(docs, "made")
    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    voted = own.select(computed("pattern: bigint", count)(F.col("text")).alias(holder))
    found = voted.groupBy(f"{holder}.pattern").count().collect()  # one row per pattern, 59,049 at most
    patterns = np.array([r["pattern"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], np.float64)
    model = estimate(patterns, counts)
    good = model.posterior(patterns) >= 0.5
    of_class = [max(counts[~good].sum(), 1), max(counts[good].sum(), 1)]
    rates = [min(1.0, sample_rows / 2 / n) for n in of_class]

    def describe():
        lexicon = per_worker("lexicon", Lexicon)

        def work(batch: pa.Array) -> list[pa.Array]:
            labels, rows = [np.zeros(0)], []
            for part in runs_of(texts(batch), len, RUN_CHARS):
                run = Run.of(part, lexicon)
                labels.append(model.posterior(patterns_of(run, lexicon)))
                rows += [row.tobytes() for row in features(run, lexicon).astype(np.float32)]
            return [pa.array(np.concatenate(labels)), pa.array(rows, pa.binary())]

        return work

    # the place of a row is hashed as well, so that equal rows are not drawn together
    drawn = F.pmod(F.xxhash64("text", "id", F.monotonically_increasing_id()), F.lit(1 << 20)).alias("drawn")
    few = own.select("text", drawn).where(F.col("drawn") < int(max(rates) * (1 << 20)) + 1)
    told = few.select("drawn", computed("label: double, features: binary", describe)(F.col("text")).alias("made"))
    rate = F.when(F.col("made.label") >= 0.5, F.lit(int(rates[1] * (1 << 20)) + 1)).otherwise(int(rates[0] * (1 << 20)) + 1)
    chosen = told.where(F.col("drawn") < rate).select("drawn", "made.label", "made.features")
    # about as many as the bound; what chance has drawn beyond it goes by the highest draws
    sample = chosen.orderBy("drawn", "label", "features").limit(sample_rows).toArrow()
    rows = [np.frombuffer(r, np.float32) for r in sample["features"].to_pylist()]
    matrix = np.stack(rows) if rows else np.zeros((0, FEATURES), np.float32)
    share = float(np.clip(of_class[1] / sum(of_class), 0.05, 0.95))
    weights, bias = train(matrix, np.asarray(sample["label"], np.float64), share)
    return Classifier(model, weights, bias)


def with_quality(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """Adds ``quality`` (the scorer's probability of good) and ``kept``.

    Columns of these names are replaced. A null, empty or blank text has no
    words: quality 0, not kept. Every row is judged whole and by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))

    def setup():
        weights, bias = shared.value
        lexicon = per_worker("lexicon", Lexicon)

        def work(batch: pa.Array) -> list[pa.Array]:
            qualities = [np.zeros(0)]
            for part in runs_of(texts(batch), len, RUN_CHARS):
                run = Run.of(part, lexicon)
                each = weights[lexicon.places].sum(axis=1)
                total = run.sums(each[run.number]) + weights[0] * run.same
                quality = 1 / (1 + np.exp(-np.clip(total / (run.counts + FEW_WORDS) + bias, -50, 50)))
                qualities.append(np.where(run.counts > 0, quality, 0.0))
            quality = np.concatenate(qualities)
            return [pa.array(quality), pa.array(quality >= KEPT_FROM)]

        return work

    return with_fields(docs, F.col(text_col), "quality: double, kept: boolean", setup)


def only_kept(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The documents the scorer keeps, with all their columns as they are."""
    (text, row) = fresh(docs, "own_text", "row")
    whole = docs.select(F.struct(*quoted(*docs.columns)).alias(row), F.col(text_col).alias(text))
    judged = with_quality(whole, classifier, text).where("kept")
    return judged.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
