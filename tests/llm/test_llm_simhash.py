"""Fingerprints and classes equal a plain version."""

import random
import re

import numpy as np
import pytest
import xxhash

from passagework.llm import simhash
from passagework.llm.catalog import documents, op5_simhash
from passagework.llm.components import components


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(values, bits):
    """Class number of every value: the least index reachable."""
    values = np.array(values, np.uint64)
    label = np.arange(len(values))
    changed = True
    while changed:
        before = label.copy()
        for i in range(len(values)):
            near = np.bitwise_count(values ^ values[i]) <= bits
            label[near] = np.minimum(label[near], label[near].min())
        changed = (label != before).any()
    return label.tolist()


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 300):
        text = " \t".join("".join(rng.choices("abÄÉé日Z\u00a0", k=rng.randint(1, 5))) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    assert simhash.fingerprint(text) == whole


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, plain_fingerprint(r.text)) for r in documents(spark, sf_dir).collect())
    label = classes_of([f for _, f in docs], 4)
    want = {d: (f"{f:016x}", docs[label[i]][0]) for i, (d, f) in enumerate(docs)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf_dir).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def clustered(seed, bases=12, near=25):
    rng = random.Random(seed)
    made = set()
    for _ in range(bases):
        value = rng.getrandbits(64)
        for _ in range(near):
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            made.add(value)
    return sorted(made)


@pytest.mark.parametrize("bits,split_rows", [(4, 1 << 18), (4, 40), (3, 1 << 18), (2, 1 << 18), (0, 1 << 18), (3, 40)])
def test_links_find_every_class(spark, bits, split_rows):
    """Also where prefixes with many fingerprints are split."""
    values = clustered(bits) + [0, 1, 3, 7, 15, 2**64 - 1]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = simhash.links(table, bits, split_rows).collect()
    place = {v: i for i, v in enumerate(signed)}
    for row in found:
        assert ((row.u ^ row.v) & (2**64 - 1)).bit_count() <= bits * len(values)
    root = {r.node: r.root for r in components(simhash.links(table, bits, split_rows)).collect()}
    want = classes_of(values, bits)
    groups = {}
    for v, i in place.items():
        groups.setdefault(root.get(v, v), []).append(i)
    mine = {i: min(g) for g in groups.values() for i in g}
    assert [mine[i] for i in range(len(values))] == want


def test_regions_are_split_inside_a_task(spark, monkeypatch):
    values = np.array(clustered(9, 3, 150), np.uint64)
    whole, parts = simhash._Forest(), simhash._Forest()
    region = np.zeros(len(values), np.uint64)
    simhash._collide(whole, region, values, 0, 2)
    monkeypatch.setattr(simhash, "TASK_VARIANTS", 500)
    simhash._link_runs(parts, region, values, 0, 2)
    assert {v: whole.find(v) for v in values.tolist()} == {v: parts.find(v) for v in values.tolist()}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    prints = {(r.doc_id, r.fp) for r in rows}
    assert prints == {(i, np.array([plain_fingerprint(t)], np.uint64).view(np.int64)[0]) for i, t in odd_rows}
    empty = [r for r in rows if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_class_stays(spark, odd_docs, odd_rows, no_docs):
    classes = simhash.near_duplicates(odd_docs).collect()
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({r.root for r in classes})
    assert {(r.doc_id, r.text) for r in rows} <= set(odd_rows)
    assert sum(r.doc_id == -10 for r in rows) == 1 and all(r.doc_id != 1 or r.text is None for r in rows)
    assert simhash.one_of_each(no_docs).count() == 0
    repeated = spark.createDataFrame([(3, "one two three", "a"), (3, "one two three", "b"), (None, "x", "c"), (None, "x", "d")], "doc_id bigint, text string, n string")
    assert len(simhash.one_of_each(repeated).collect()) == 2
