"""Token counts and packing equal the tokenizer library's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from passagework.llm import packing, tokens
from passagework.llm.catalog import documents, op1_pack, op10_token_count
from passagework.llm.common import Memo
from passagework.llm.token_count import with_token_counts
from passagework.llm.tokens import TokenLengths, WordIds, frequent_lengths

WORD_PATH = public_tokenizers.path(packing.VOCABULARY)
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")


def strange_texts(count=400):
    rng = random.Random(5)
    alphabet = ["a", "B", "zebra", "Über", "élan", "ñ", " ", " ", " ", "\n", "  ", "\t", ".", ",", "'s", "'", "!?", "9", "42", "é",
                "a\u0301", "İ", "ﬁ", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "\u00a0", "_x", "-", "\x1c", "Σ", "&&&"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(count)]


def library_ids(text, path):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_library():
    words, library = WordIds(WORD_PATH), Tokenizer.from_file(WORD_PATH)
    texts = [None, *strange_texts(), " ", "", "\n\n"]
    ids, bounds = words.of_batch(pa.array(texts, pa.string()))
    assert (bounds[0], bounds[-1], len(bounds)) == (0, len(ids), len(texts) + 1)
    for text, a, z in zip(texts, bounds, bounds[1:]):
        assert ids[a:z].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert words._encoded(list(words.given)) == list(words.given.values())


def test_word_ids_are_forgotten_but_stay_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 5)
    words, library = WordIds(WORD_PATH), Tokenizer.from_file(WORD_PATH)
    texts = ["qqa, qqb qqc", "qqd qqe. qqf qqg qqh qqi", "qqa qqb; " + "zx" * 60, "Qqe QQF! " + "zx" * 60]
    for text in texts * 2:
        ids, _ = words.of_batch(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(words.young) <= 5 and len(words.old) <= 5 and "zx" * 60 not in words.young


def test_counts_equal_the_library():
    lengths, library = TokenLengths(BYTE_PATH, frequent_lengths(BYTE_PATH)), Tokenizer.from_file(BYTE_PATH)
    for text in strange_texts():
        assert lengths.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_memo_forgets_but_stays_right():
    memo = Memo(len, given={"given": 5}, entries=3)
    for word in ["a", "bb", "ccc", "dddd", "a", "eeeee", "given", "x" * 100] * 3:
        assert memo[word] == len(word)
    assert len(memo) <= 5 and len(memo.old) <= 5 and "given" in memo and "x" * 100 not in memo


def test_count_query(spark, sf_dir):
    library = Tokenizer.from_file(BYTE_PATH)
    want = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    got = op10_token_count(spark, sf_dir).collect()
    assert len(got) == len(want)
    for row in got:
        n = len(library.encode(want[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(want[row.doc_id].encode()), n, n > 1024)


def test_count_of_odd_rows(odd_docs, odd_rows, no_docs):
    made = with_token_counts(odd_docs)
    library = Tokenizer.from_file(BYTE_PATH)
    assert made.columns == [*[c for c in odd_docs.columns if c != "n_tokens"], "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in made.collect())
    rows = [(i, t or "") for i, t in odd_rows]
    assert got == sorted(
        (i is None, i or 0, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows
    )
    assert with_token_counts(no_docs).count() == 0


# packing


def check_packed(rows, docs):
    """Every id in one piece, checksums right, sequences gapless and not too long. Returns the share of padding."""
    library = Tokenizer.from_file(WORD_PATH)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    got = {}
    for row in rows:
        fits = [d for d in ids[row.doc_id] if len(d) == row.doc_tokens]
        sums = [zlib.crc32(np.array(d[row.start : row.start + row.length], "<u4").tobytes()) for d in fits]
        assert row.ids_crc32 in sums
        got.setdefault((row.doc_id, row.doc_tokens), []).append((row.start, row.length))
    total = 0
    for (doc, tokens), pieces in got.items():
        copies = sum(len(d) == tokens for d in ids[doc])
        covered = np.zeros(tokens, int)
        for start, length in pieces:
            covered[start : start + length] += 1
        assert (covered == copies).all()
        total += copies
    assert total == len(docs) and len(want) == len(docs)
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    padding = used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        used += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding / max(padding + used, 1)


def test_pack_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert check_packed(op1_pack(spark, sf_dir).collect(), docs) < 0.02


def test_pack_odd_rows(odd_docs, odd_rows, no_docs):
    assert check_packed(packing.pack(odd_docs).collect(), odd_rows) < 0.05
    assert packing.pack(no_docs).count() == 0


def test_pack_equal_lengths(texts_table):
    """No combination of 1,101 fills a window, so the pieces must be cut."""
    texts = [" ".join(["tree"] * 1100)] * 60
    assert check_packed(packing.pack(texts_table(texts)).collect(), list(enumerate(texts))) < 0.03


def test_pack_short_texts(texts_table):
    texts = [" ".join(["tree"] * (i % 50)) for i in range(3000)]
    assert check_packed(packing.pack(texts_table(texts)).collect(), list(enumerate(texts))) < 0.03


def test_checksum_of_the_rest():
    sums = packing.Checksums(64)
    data = np.arange(60, dtype="<u4") * 77
    for cut in (0, 1, 8, 59, 60):
        front, rest = data[:cut].tobytes(), data[cut:].tobytes()
        assert sums.rest(zlib.crc32(data.tobytes()), zlib.crc32(front), 60 - cut) == zlib.crc32(rest)


def test_least_squares_is_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        matrix, target = rng.integers(0, 3, (6, 9)).astype(float), rng.integers(0, 9, 6).astype(float)
        x = packing.non_negative_least_squares(matrix, target)
        gain = matrix.T @ (target - matrix @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6


def test_fillings():
    assert sorted(packing.fillings([2, 3, 4, 8], 8)) == [(3, 3, 2), (4, 2, 2), (4, 4), (8,)]


@pytest.mark.parametrize("stride", [2041, 100])
def test_cut_covers_the_piece(stride):
    for start in range(0, 400, 7):
        for length in (1, 5, 99, 100, 250):
            parts = packing.cut(length, start, stride)
            assert [a for a, _, _ in parts] == [0, *(z for _, z, _ in parts[:-1])] and parts[-1][1] == length
            for a, z, number in parts:
                assert start + a >= number * stride - 7 and start + z <= (number + 1) * stride
                assert z % packing.UNIT == 0 or z == length
