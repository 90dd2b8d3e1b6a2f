"""Sharding against a dynamic programme over all contiguous partitions, and what the law promises."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import sharding
from tests.llm.data import awkward, documents, empty, sentence


def groups_of(rows):
    """Sizes of the groups of equal texts, in order of their smallest doc_id (a group of none but null first)."""
    found = defaultdict(list)
    for i, t in rows:
        found[t or ""].append(i)
    key = lambda t: min((i for i in found[t] if i is not None), default=float("-inf"))
    return [(t, len(found[t]) * (len(t.encode()) + 1)) for t in sorted(found, key=key)]


def least_largest(sizes, n):
    """The smallest largest shard of all contiguous partitions, by dynamic programming."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = total[:]
    for _ in range(n - 1):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(1, len(total))]
    return best[-1]


def frame(spark, sizes):
    end, rows = 0, []
    for s in sizes:
        end += s
        rows.append((s, end))
    return spark.createDataFrame(rows, "bytes long, end long").coalesce(1)


def loads(sizes, cuts):
    out, end = [0] * len(cuts), 0
    for s in sizes:
        end += s
        out[sum(end > c for c in cuts[:-1])] += s
    return out


@pytest.mark.parametrize("n_blocks", [3, 20, 4096])
def test_cuts_are_minimax(spark, n_blocks):
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.choice([1, 2, 3, 9, 40, rng.randrange(1, 200)]) for _ in range(rng.choice([1, 5, 40, 120]))]
        if seed % 2:
            sizes.insert(rng.randrange(len(sizes) + 1), sum(sizes) // 2 + 1)  # a third of all in one group
        n = rng.choice([2, 5, 16])
        got = loads(sizes, sharding.minimax_cuts(frame(spark, sizes), n, n_blocks))
        assert sum(got) == sum(sizes) and max(got) == least_largest(sizes, n), (seed, n)


def test_a_hot_group_leaves_the_others_even(spark):
    rng = random.Random(7)
    sizes = [rng.randrange(1, 30) for _ in range(600)]
    rest = sum(sizes)
    sizes.insert(200, rest // 2)
    got = loads(sizes, sharding.minimax_cuts(frame(spark, sizes), 16))
    assert max(got) == rest // 2 and got.count(0) == 0
    assert all(x <= 1.15 * rest / 15 for x in got if x != rest // 2)


def check(rows, got, n=16):
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    assert {r["law"] for r in got} <= {"bytes"} and {r["grown_shard"] for r in got} <= {None}
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    if rows:
        assert max(sizes.values()) == least_largest([s for _, s in groups_of(rows)], n)
    return sizes


def test_shards_of_documents(spark):
    rng = random.Random(2)
    copied = sentence(rng, 30)
    rows = [(i, copied if i % 3 == 0 else sentence(rng, rng.randrange(1, 40))) for i in range(300)]
    rng.shuffle(rows)
    for n_blocks in (4, 4096):
        got = sharding.shard(documents(spark, rows), n_blocks=n_blocks).collect()
        sizes = check(rows, got)
        assert len(sizes) == 16
        text = dict(rows)
        assert len({r["shard"] for r in got if text[r["doc_id"]] == copied}) == 1
    firsts = {}
    for r in got:
        firsts[r["shard"]] = min(firsts.get(r["shard"], 10**9), rows and min(i for i, t in rows if t == text[r["doc_id"]]))
    assert [firsts[s] for s in sorted(firsts)] == sorted(firsts.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, sharding.shard(docs).collect())
    nulls = documents(spark, [(None, None)] * 3 + [(None, "")])
    assert sorted(r["slot"] for r in sharding.shard(nulls).collect()) == [0, 1, 2, 3]
    assert sharding.shard(empty(spark)).collect() == []


def test_no_python_workers(spark):
    plan = sharding.shard(documents(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sharding.shard(documents(spark, [(1, "a")])).select(F.col("shard")).first()[0] == 0
