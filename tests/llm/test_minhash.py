from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from brindle.llm import minhash
from tests.llm.data import awkward, documents, empty, sentence


def weights(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def components(rows, threshold=0.8):
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    w = [(i, weights(t)) for i, t in rows]
    for k, (i, a) in enumerate(w):
        for j, b in w[:k]:
            if a and b and probability_jaccard(a, b) >= threshold:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
    return " ".join(w)


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(12):
        base = sentence(rng, rng.randrange(40, 160))
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 2, 4]))) for k in range(8)]
    rows += [(len(rows) + k, sentence(rng, 50)) for k in range(30)]
    loop = sentence(rng, 12)
    rows += [(500, (loop + " ") * 9), (501, (loop + " ") * 9 + "end"), (502, loop)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    want = components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == {i for i, c in want.items() if i == c}


def test_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE_ROWS", 16)
    monkeypatch.setattr(minhash, "TILE_COLUMNS", 32)
    rng = random.Random(2)
    base = sentence(rng, 120)
    rows = [(k, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5]))) for k in range(150)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    want = components(rows)
    assert sum(got[i] != want[i] for i in want) <= 1  # pairs right at the threshold may share no band


def test_exact_measure():
    rng = random.Random(3)
    for _ in range(30):
        a, b = (Counter(rng.choices(range(12), k=rng.randrange(1, 30))) for _ in range(2))
        side = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.uint32))
        assert abs(minhash.probability_jaccard(*side(a), *side(b)) - probability_jaccard(a, b)) < 1e-12


def test_signatures_estimate_the_measure():
    rng = random.Random(4)
    text = sentence(rng, 300)
    other = edited(rng, text, 8)
    sigs = []
    for t in (text, other):
        key, weight, owner, _ = minhash.weighted_runs(pa.array([t]), 5)
        sigs.append(minhash.signatures(key, weight, owner, 1, 2000)[0])
    want = probability_jaccard(weights(text), weights(other))
    assert abs((sigs[0] == sigs[1]).mean() - want) < 0.04


def test_awkward_and_empty(spark):
    rows = minhash.near_duplicates(awkward(spark)).collect()
    assert len(rows) == 13
    same = [r for r in rows if r["doc_id"] in (5, 6, 7)]
    assert {r["component_id"] for r in same} == {None}  # the null doc_id goes first
    assert sum(r["kept"] for r in rows if r["component_id"] is None and r["doc_id"] in (5, 6, 7, None)) == 2  # of the group, and the null text
    assert all(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 8, 9))
    assert minhash.near_duplicates(empty(spark)).collect() == []
