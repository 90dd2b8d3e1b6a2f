from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from brindle.llm import embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<double>, c int, x int"


def table(spark, rows):
    return spark.createDataFrame([(int(i), v if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], SCHEMA)


def sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, 32))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 32)) * rng.choice([0.0, 0.1, 0.3, 0.6], size=(n, 1))
    bad = [(n, None), (n + 1, [0.0] * 32), (n + 2, [1.0, None] * 16), (n + 3, [float("nan")] * 32), (n + 4, [float("inf")] * 32), (n + 5, [1.0] * 7), (n + 6, [])]
    return x, [(i, v.tolist()) for i, v in enumerate(x)] + bad


def test_embedding_components(spark):
    x, rows = sample()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.97 * link.sum()
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i)
        if i >= len(x):
            assert r["n_links"] == 0 and r["kept"]


def test_smaller_ids_that_only_a_larger_one_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(100):  # 3t - 3t+2 - 3t+1: the middle one has the largest id
        u, v = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        rows += [(3 * t + k, (np.cos(a) * u + np.sin(a) * v).tolist()) for k, a in enumerate(np.radians([-20.0, 20.0, 0.0]))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    whole = [t for t in range(100) if [got[3 * t + k]["n_links"] for k in range(3)] == [1, 1, 2]]
    assert len(whole) > 90
    for t in whole:
        assert [got[3 * t + k]["component_id"] for k in range(3)] == [3 * t] * 3
        assert [got[3 * t + k]["kept"] for k in range(3)] == [True, False, False]


def test_recall_where_vectors_share_a_direction(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(0.83 * unit(rng.normal(size=32)) + 0.56 * unit(rng.normal(size=(600, 32))))
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    x = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * away])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    got = embedding_dedup.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert sum(r["n_links"] for r in got) >= 0.95 * link.sum()


def test_hot_key_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((150, 16)) + rng.normal(size=(150, 16)) * 0.02, rng.normal(size=(40, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert [got[i] for i in range(150)] == link.sum(axis=1)[:150].tolist()


def test_equal_vectors_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table(spark, [(3, v), (1, v), (2, v)])).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert embedding_dedup.near_duplicates(table(spark, [])).collect() == []


def test_nearest_equals_brute_force(spark):
    x, rows = sample(300, 2)
    got: dict = {}
    for r in nearest.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=7, block=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        scores = [(-sum(a * b for a, b in zip(x[q], x[c])), c) for c in range(len(x)) if c != q]
        want = sorted(scores)[:7]
        assert [v for _, v, _ in sorted(found)] == [c for _, c in want]
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in want], rtol=0, atol=1e-12)


def test_nearest_ties_few_and_empty(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(table(spark, rows), F.col("vec_id") == 2, k=20).collect())
    assert got == [(2, 1, 0), (2, 2, 1), (2, 3, 3), (2, 4, 4)]
    assert nearest.nearest(table(spark, []), F.col("vec_id") == 2).collect() == []


def test_repeated_and_null_ids(spark):
    rows = table(spark, [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0]), (4, [0.0, 1.0])]).unionByName(table(spark, []).limit(0))
    nameless = spark.createDataFrame([(None, [1.0, 0.0], 1, 2)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(rows.unionByName(nameless), F.col("vec_id") == 1).collect())
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 4), (1, 4, 4)]  # each row of the query's id asks; none meets its own id
    found = [(r["vec_id"], r["kept"]) for r in embedding_dedup.near_duplicates(rows.unionByName(nameless)).collect()]
    assert len(found) == 5 and (None, True) in found and (4, True) in found
