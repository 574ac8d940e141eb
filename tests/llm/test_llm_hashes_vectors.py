"""Hard negatives, the Merkle manifest and repeated bytes against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.llm import merkle, negatives, repeats


def by_nulls(row):
    return tuple((x is not None, x) for x in row)


# hard negatives


def plain_negatives(rows):
    """``rows`` are id, label, vector of whole numbers; an id may be missing."""
    last = (1 << 63) - 1
    kept = [(last if i is None else i, label, np.array(v, np.int64)) for i, label, v in rows if label is not None and v is not None]
    found = []
    for own, (anchor, label, vector) in enumerate(kept):
        if anchor == last or anchor % 100:
            continue
        ranked = sorted(((-int(v @ vector), i, k) for k, (i, _, v) in enumerate(kept) if k != own))
        for minus, positive, _ in [r for r in ranked if kept[r[2]][1] == label][:5]:
            fit = [r for r in ranked if kept[r[2]][1] != label and 80 * -minus <= 100 * -r[0] <= 100 * -minus][:5]
            found += [(anchor, positive, place, i, -minus, -s) for place, (s, i, _) in enumerate(fit, 1)]
    return sorted((a, None if p == last else p, r, None if n == last else n, x, y) for a, p, r, n, x, y in found)


def vector_rows(count, dim, seed, spread=60):
    dice = np.random.default_rng(seed)
    centres = dice.integers(-spread, spread, (6, dim))
    return [
        (int(i), int(dice.integers(0, 4)), (centres[dice.integers(0, 6)] + dice.integers(-9, 9, dim)).tolist())
        for i in dice.permutation(count) * 5
    ]


VECTORS = "id bigint, label bigint, vector array<bigint>, leaf int, question string"


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(4)
    result = negatives.hard_negatives(table, F.col("id") % 100 == 0, **options)
    return sorted((tuple(r) for r in result.collect()), key=by_nulls)


@pytest.mark.parametrize("sample_rows", [16, 200, 8192])
def test_negatives_equal_brute_force(spark, sample_rows):
    rows = vector_rows(500, 6, 1)
    want = plain_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows, sample_rows=sample_rows, block_cells=40) == sorted(want, key=by_nulls)


def test_negatives_with_copies_ties_and_repeated_anchors(spark):
    rows = vector_rows(120, 4, 2, spread=4)
    # a third of all rows is one vector, in two labels, anchors among them; one anchor occurs twice
    rows += [(700 + 3 * i, i % 2, [9, 9, 9, 9]) for i in range(80)]
    rows += [(1000, 0, [9, 9, 9, 9]), (1000, 0, [9, 9, 9, 9]), (1100, 1, [0, 0, 0, 0]), (1200, 1, [-9, -9, 1, 0])]
    rows += [(None, 0, [9, 9, 9, 9]), (None, 1, [9, 9, 9, 8]), (5, None, [9, 9, 9, 9]), (10, 0, None)]
    assert mined(spark, rows) == sorted(plain_negatives(rows), key=by_nulls)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1, 2]), (2, 1, [1, 2])]) == []  # no anchors
    assert mined(spark, [(100, 0, [1, 2])]) == []  # no other rows
    assert mined(spark, [(100, 0, []), (200, 0, []), (3, 1, [])]) == [(100, 200, 1, 3, 0, 0), (200, 100, 1, 3, 0, 0)]


def test_negatives_pads_shorter_vectors_and_takes_large_ones(spark):
    big = 1 << 20
    rows = [(100, 0, [big, 1]), (2, 0, [big]), (3, 1, [big, 0]), (4, 1, [big - 1, 5, 0]), (5, 1, [1])]
    padded = [(i, label, v + [0] * (3 - len(v))) for i, label, v in rows]
    assert mined(spark, rows) == plain_negatives(padded) != []
    with pytest.raises(ValueError):
        negatives.exact_type(float(1 << 60))


def test_usable_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [0.5, None]), (4, [float("nan"), 1.0]), (5, [float("inf")]), (6, [])]
    table = spark.createDataFrame(rows, "id int, v array<float>").where(negatives.usable(F.col("v")))
    got = {r[0]: r[1] for r in table.select("id", negatives.whole_numbers(F.col("v"))).collect()}
    assert got == {1: [128, -1], 6: []}


def test_no_annulus_is_left_out(spark):
    """Whatever the window, a leaf that holds an answer is visited, and some leaves are not."""
    dice = np.random.default_rng(3)
    rows = np.concatenate([dice.integers(-20, 20, (300, 3)) + centre for centre in dice.integers(-900, 900, (8, 3))])
    tree = negatives.fit(rows[::4], split_points=4, leaf_rows=10)
    shape = [(len(p), len(p)) for p in tree.points]
    found = negatives.Ranges(
        *([np.full(s, v) for s in shape] for v in (np.inf, -np.inf)), *([np.full(s[0], v) for s in shape] for v in (np.inf, -np.inf))
    )
    own = negatives.norms(rows)

    def seen(node, child, away, members):
        found.least[node][:, child], found.most[node][:, child] = away.min(axis=0), away.max(axis=0)
        found.norm_least[node][child], found.norm_most[node][child] = own[members].min(), own[members].max()

    leaf = tree.visit(rows, seen)
    asked = rows[::7]
    scores = asked @ rows.T
    centre = dice.choice(scores.ravel(), len(asked)).astype(float)
    none = np.zeros(len(asked), np.int64)
    windows = negatives.Questions(asked, none, none, np.arange(len(asked)), centre - 3000, centre + 3000, True, 5)
    walk, left_out = negatives.Walk(tree, found, windows), 0
    for number in range(len(tree.leaf_parent)):
        fits = ((scores >= windows.low[:, None]) & (scores <= windows.high[:, None]))[:, leaf == number].any(axis=1)
        visited = np.isin(np.arange(len(asked)), walk.questions(number))
        assert not (fits & ~visited).any()
        left_out += int((~visited).sum())
    assert left_out > len(asked) * len(tree.leaf_parent) // 4


# the Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_path(levels, i):
    found = []
    for level in levels[:-1]:
        j = i ^ 1
        found.append((level[j] if j < i else "", level[j] if i < j < len(level) else ""))
        i //= 2
    return found


def plain_manifest(rows):
    """``rows`` are doc_id, source, lang, n_chars, text."""

    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = plain_tree([leaf(r) for r in groups[name]])
    top = plain_tree([trees[name][-1][0] for name in names])
    found = []
    for number, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = plain_path(trees[name], i) + plain_path(top, number)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf((*row[:3], row[3] + 1, row[4])) if hit and row[3] is not None else leaf(row)
            for before, after in path:
                h = digest(before, h, after)
            proof = digest(*(before + after for before, after in path))
            found.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(found, key=by_nulls)


DOCUMENTS = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, `steps` int, hash string, n int"


def manifest_of(spark, rows):
    table = spark.createDataFrame([(*r, "g", 1, "h", 2) for r in rows], DOCUMENTS).repartition(3)
    result = merkle.manifest(table)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in result.collect()), key=by_nulls)


def manifest_rows(count, langs, seed=0):
    dice = random.Random(seed)
    return [(i * 3 - 50, f"s{i % 5}", dice.choice(langs), i, f"text {i} é") for i in range(count)]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 256, 257, 1500])
def test_manifest_of_sizes(spark, count):
    rows = manifest_rows(count, ["en", "en", "en", "de", None, "zz", "É"])
    got = manifest_of(spark, rows)
    assert got == plain_manifest(rows)
    assert len({r[3] for r in got}) == 1
    assert count < 100 or 0 < sum(not r[6] for r in got) < count / 3


def test_manifest_of_odd_rows(spark):
    rows = manifest_rows(40, ["en", "", None])
    rows += [(7, None, None, None, None), (None, "s", "en", 3, "x"), (None, "s", "en", 3, "x"), (None, None, None, None, None)]
    rows += [(9, "s", "en", 1, "same")] * 30 + [(9, "s", "en", 2, "other"), (11, "", "en", None, ""), (12, "s", "en", 5, "x" * 200_000)]
    rows += [(17, "s", "fr", None, "no count"), (9, "s", "en", (1 << 63) - 1, "most")]
    rows += [(i, "s", "en", (1 << 63) - 1, "most") for i in range(60, 90)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []) == []


def test_manifest_of_many_groups(spark):
    rows = [(i, "s", f"l{i % 400}", i, "t") for i in range(900)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_intervals_of_cells_are_nested(spark):
    leaves = spark.range(700).selectExpr("'g' AS grp", "700L AS n", "id AS rank", "sha2(cast(id AS string), 256) AS hash")
    grown = merkle.tree(leaves)
    assert len(grown.tiers) == 2
    for number, tier in enumerate(grown.tiers):
        for row in tier.collect():
            for below, above in zip(row["levels"], row["levels"][1:]):
                for parent in above:
                    inside = [n for n in below if parent["lo"] <= n["lo"] < parent["hi"]]
                    assert [inside[0]["lo"], inside[-1]["hi"]] == [parent["lo"], parent["hi"]] and len(inside) <= 2
            assert row["levels"][-1][0]["hi"] == min(700, (row["cell"] + 1) << (merkle.CELL_LEVELS * (number + 1)))


# repeated bytes


def plain_repeats(rows, least=50):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - least + 1):
            first.setdefault(raw[i : i + least], doc)
    found = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1 if doc is not None else 0):
            if first[raw[i : i + least]] < doc:
                gone[i : i + least] = b"\1" * least
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        found.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=by_nulls)


def odd_texts(seed, count):
    dice = random.Random(seed)
    base = ["".join(dice.choice("abcdefgh ") for _ in range(dice.randrange(400))) for _ in range(12)]

    def text():
        kind = dice.random()
        if kind < 0.2:
            return dice.choice([None, "", *base])
        if kind < 0.3:
            return dice.choice("ax\0é") * dice.randrange(30, 300)
        if kind < 0.4:
            return ("lorem ipsum dolor sit amet " + dice.choice("abc")) * dice.randrange(1, 8)
        made = ""
        for _ in range(dice.randrange(1, 5)):
            source = dice.choice(base)
            at = dice.randrange(len(source) + 1)
            made += source[at : at + dice.choice([20, 49, 50, 51, 80, 200])]
            made += "".join(dice.choice("xyz日\0") for _ in range(dice.randrange(40)))
        return made

    return [(dice.choice([None, *range(-3, 60)]) if dice.random() < 0.5 else i, text()) for i in range(count)]


def cut_down(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 0, 1, "x") for r in rows], "doc_id bigint, text string, part int, number int, kind string")
    result = repeats.without_repeats(table.repartition(3), sizes=repeats.Sizes(**sizes))
    return sorted((tuple(r) for r in result.collect()), key=by_nulls)


SMALL = [
    {"part": 3000, "bucket": 8000, "span": 4000, "slot": 9000, "hot": 3},
    {"part": 500, "bucket": 9000, "span": 1 << 20, "slot": 9000, "block": 64},
    {"part": 1 << 20, "bucket": 1 << 20, "span": 2000, "block": 333, "hot": 20},
]


@pytest.mark.parametrize("sizes", SMALL)
def test_repeats_equal_brute_force(spark, sizes):
    rows = odd_texts(len(sizes) + sizes["part"], 160)
    want = plain_repeats(rows)
    assert sum(r[2] for r in want) > 5000
    assert cut_down(spark, rows, **sizes) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("parts_")]


def test_repeats_in_one_hot_passage(spark):
    line = "the same passage of sixty bytes stands in a third of all the documents"
    rows = [(i, f"{i:05d}" * 12 + (line if i % 3 == 0 else "") + f"{i * 7919:07d}" * 9) for i in range(200)]
    got = cut_down(spark, rows, part=2000, bucket=20_000, span=5000, hot=8)
    assert got == plain_repeats(rows)
    assert sum(r[2] >= len(line) for r in got) >= 66


def test_repeats_of_odd_rows(spark, odd_docs, odd_rows):
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in odd_rows]
    rows = spark.createDataFrame(short, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in repeats.without_repeats(rows).collect()), key=by_nulls)
    assert got == plain_repeats(short)
    whole = repeats.without_repeats(odd_docs)
    assert whole.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(r[1] for r in whole.collect()) == sorted(len((t or "").encode()) for _, t in odd_rows)


def test_repeats_of_nothing(spark, no_docs):
    assert repeats.without_repeats(no_docs).collect() == []
    assert cut_down(spark, [(1, None), (None, "x" * 80), (2, "x" * 80), (None, "x" * 80)])[-1][2] == 0


def test_front_coding_and_merging():
    dice = random.Random(4)
    runs, every = [], []
    for _ in range(11):
        rows = sorted(bytes(dice.choice(b"\0ab") for _ in range(repeats.WIDTH - 60)) + bytes(60) for _ in range(dice.randrange(60)))
        made = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, repeats.WIDTH)
        common = repeats.shared_prefixes(made)
        tails = made[np.arange(repeats.WIDTH) >= common[:, None]].tobytes()
        assert repeats.decoded(common, tails) == rows
        runs.append((rows, common.tolist()))
        every += rows
    order, common = repeats.merged(runs)
    at = [0] * len(runs)
    out = []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(every)
    made = np.frombuffer(b"".join(out), np.uint8).reshape(-1, repeats.WIDTH)
    assert common[1:] == repeats.shared_prefixes(made)[1:].tolist()


def test_known_prefixes_are_not_compared_again():
    """A head that shares more with what came out last wins without a look at its bytes."""

    class Watched(bytes):
        looked: list = []

        def __getitem__(self, at):
            Watched.looked.append(at)
            return bytes.__getitem__(self, at)

    rows = [b"p" * 40 + bytes([65 + i // 26, 65 + i % 26]) + b"q" * (repeats.WIDTH - 42) for i in range(90)]
    made = [np.frombuffer(b"".join(rows[k::3]), np.uint8).reshape(-1, repeats.WIDTH) for k in range(3)]
    runs = [([Watched(x) for x in rows[k::3]], repeats.shared_prefixes(m).tolist()) for k, m in enumerate(made)]
    repeats.merged(runs)
    prefix_looks = sum(at < 40 for at in Watched.looked)
    assert prefix_looks <= 2 * 40 * 3  # the first heads only, each pair from the front


def test_equal_bytes_have_equal_anchors():
    dice = random.Random(6)
    passage = "".join(dice.choice("abc de") for _ in range(50)).encode()
    places = set()
    for front, behind in [(0, 0), (3, 90), (200, 7), (64, 64)]:
        text = bytes(dice.choice(b"xyzw ") for _ in range(front)) + passage + bytes(dice.choice(b"xyzw ") for _ in range(behind))
        ends = np.array([len(text)])
        for size in (64, 1 << 20):
            for place, _, least, most in repeats.anchors(np.frombuffer(text, np.uint8), ends, size):
                places |= {int(p) - front for p, a, z in zip(place, least, most) if p - z <= front <= p - a}
    assert len(places) == 1


def test_hashes_of_a_part_tell_documents_apart():
    batch = pa.RecordBatch.from_pydict({"part": [0, 0], "number": [0, 1], "doc_id": [1, 2], "text": [b"r" * 60, b"s" * 60]})
    packed = pa.Table.from_batches(repeats.packs(iter([batch]), 1 << 20))
    rows = repeats.hashes_of(packed, 1, repeats.SIZES).to_pylist()
    assert [max(r["seen"]) for r in rows] == [11]  # eleven windows, each document with its own
    assert repeats.survivors_of(pa.Table.from_pylist(rows, repeats.HASHES_ARROW), repeats.SIZES).num_rows == 0
