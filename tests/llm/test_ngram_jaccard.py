import random
from collections import defaultdict

import numpy as np
import pytest

from motifspark.llm import graph, ngram_jaccard as J
from motifspark.llm import text as X
from motifspark.llm.text import shingle_set


def plain_shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(n_shingles, component) of each doc_id, comparing everything with everything."""
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = set()
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.add((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


def test_components_equal_brute_force(docs, texts):
    got, links = J.linked(docs)
    expected, all_links = brute(texts)
    rows = got.collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert {(r.a, r.b) for r in links.collect()} <= all_links


def test_all_links_between_classes(docs, texts):
    rows, links = J.linked(docs, all_links=True)
    classes = {r.doc_id: r.class_id for r in rows.collect()}
    _, expected = brute(texts)
    expected = {(max(classes[i], classes[j]), min(classes[i], classes[j])) for i, j in expected if classes[i] != classes[j]}
    assert {(r.a, r.b) for r in links.collect()} == expected


def test_keys_of_linked_sets_meet():
    """Any two sets that are linked share a key, whatever is common and however many slots are doubled."""
    rng = np.random.default_rng(0)
    for trial in range(400):
        n = int(rng.integers(1, 300))
        one = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 3 + 1))
        other = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1)), dtype=np.uint64)]))
        one = np.unique(one)
        both = len(np.intersect1d(one, other))
        if not len(other) or 100 * both < 75 * (len(one) + len(other) - both):
            continue
        doubled = {b: int(rng.integers(0, J.slots(b))) for b in range(6)} if trial % 2 else {}
        held = [x for s in (one, other) for b in J.bands(len(s)) for x in J.contents(np.add.reduceat(J.fill(s, b)[2], J.fill(s, b)[1]), J.fill(s, b)[0], b)]
        known = np.unique(np.array(held, np.uint64)[rng.random(len(held)) < rng.random()])
        common = known, rng.choice([40, 300, 3000, 10**6], len(known))
        assert len(np.intersect1d(J.signature(one, common, doubled), J.signature(other, common, doubled))), (n, trial)
        a, b = sorted((one, other), key=len)
        words = len(J.sketch(a, J.band_of(len(a))))
        x, y = (J.folded(J.sketch(z, J.band_of(len(z))).view(np.uint64)[None], words)[0] for z in (a, b))
        assert 7 * int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b)


def test_large_buckets_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 2)
    monkeypatch.setattr(J, "BLOCK", 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.components_of(docs).collect()} == brute(texts)[0]


def test_without_broadcast(docs, texts, monkeypatch):
    monkeypatch.setattr(J, "PICKED", 0)
    kept = {r.doc_id for r in J.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in brute(texts)[0].items() if i == c}


def test_empty_and_null(spark, none, docs):
    assert J.components_of(none).count() == 0 and J.keep_one(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.components_of(rows).collect()), key=str)
    assert [g[:2] for g in got] == [(1, 2), (2, 2), (2, 2), (None, 2)] and [g[2] for g in got[:3]] == [1, 1, 1]
    kept = J.keep_one(rows.withColumnRenamed("text", "text"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None] and kept.columns == rows.columns
    assert J.keep_one(docs).columns == docs.columns


def test_shingles_are_sets_of_words():
    assert len(shingle_set(b"a b c")) == 1 and len(shingle_set(b"")) == 0
    assert (shingle_set(b"A b\tc") == shingle_set(b"a b c")).all()
    assert len(shingle_set(b"a " * 100)) == 1


@pytest.mark.parametrize("shape", ["star", "chain", "both"])
def test_components_of_graphs(spark, shape):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 300)] if shape != "chain" else []
    order = list(range(1000, 1200))
    rng.shuffle(order)
    edges += list(zip(order, order[1:])) if shape != "star" else []
    if shape == "both":
        edges.append((5, 1100))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = defaultdict(int)
    for a, b in edges:
        for x in (a, b):
            expected[x] = 0 if shape == "both" or x < 1000 else 1000
    assert got == dict(expected)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("piece,short", [(1 << 18, 64), (40, 8)])
def test_words_of_many_texts_are_hashed_as_one_by_one(texts, piece, short, monkeypatch):
    monkeypatch.setattr(X, "PIECE", piece)
    monkeypatch.setattr(X, "SHORT", short)
    monkeypatch.setattr(X.Powers, "up", None)
    raws = [t.encode() if t is not None else None for _, t in texts] + [b"A b  a B\tc\x0b\x0c\x1c", b"w" * 70 + b" " + b"W" * 70 + b" " + b"w" * 71, b" ", b""]
    hashes, bounds = X.word_hashes(raws)
    words = [w for r in raws for w in (r or b"").lower().split()]
    assert list(np.diff(bounds)) == [len((r or b"").lower().split()) for r in raws]
    known = {}
    for word, h in zip(words, hashes.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert all((a == shingle_set(r)).all() for a, r in zip(X.shingle_sets(raws), raws))
    assert len(X.word_hashes([])[0]) == 0 and len(X.word_hashes([None, b""])[0]) == 0
