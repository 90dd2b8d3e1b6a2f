"""Graph retrieval for many questions against one question and source at a time, in plain Python."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from brindle.operators import graph_search as G
from brindle.operators import retrieval
from brindle.plans.retrieval import _queries, graph_corpus

SF = "/root/testdata/sf0.001"


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_pagerank(nodes, edges, seeds):
    """A dictionary of dictionaries and the textbook iteration."""
    weight = {v: defaultdict(float) for v in nodes}
    for a, b, w in edges:
        w = w or 1.0
        weight[a][b] += w
        if a != b:
            weight[b][a] += w
    total = sum(seeds.get(v, 0.0) for v in nodes)
    home = {v: seeds.get(v, 0.0) / total if total > 0 else 1 / len(nodes) for v in nodes}
    score = {v: 1 / len(nodes) for v in nodes}
    for _ in range(100):
        lost = sum(score[v] for v in nodes if not weight[v])
        after = {v: 0.15 * home[v] + 0.85 * lost * home[v] for v in nodes}
        for v in nodes:
            out = sum(weight[v].values())
            for u, w in weight[v].items():
                after[u] += 0.85 * score[v] * w / out
        moved = sum(abs(after[v] - score[v]) for v in nodes)
        score = after
        if moved < len(nodes) * 1e-6:
            break
    return score


def brute_run(corpus, source, query, top_k, candidates, tokens, max_nodes=500, max_edges=2000):
    named = sorted(((-cosine(v, query), n) for s, n, v in corpus["nodes"] if s == source and usable(v) and len(v) == len(query)))[:10]
    seeds = {n: max(0.0, -c) for c, n in named}
    if not seeds:
        return []
    edges = [(a, b, w) for s, a, b, w in corpus["edges"] if s == source]
    near = {b for a, b, _ in edges if a in seeds} | {a for a, b, _ in edges if b in seeds}
    visited = set(seeds) | set(sorted(near - set(seeds))[: max_nodes - len(seeds)])
    inner = sorted(((a, b, w) for a, b, w in edges if a in visited and b in visited), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))[:max_edges]
    score = plain_pagerank(sorted(visited), inner, seeds)
    held, named_by = defaultdict(float), defaultdict(set)
    for s, n, c in corpus["links"]:
        if s == source:
            named_by[n].add(c)
    for n in visited:
        for c in named_by[n]:
            held[c] += score[n] / math.log(2 + len(named_by[n]))
    texts = {c: (name, t) for s, c, name, t in corpus["chunks"] if s == source and t}
    out, used = [], 0
    for c in sorted(held, key=lambda c: (-round(held[c], 12), c))[:candidates]:
        if c not in texts or len(out) >= top_k:
            continue
        cost = -(-len(f"{texts[c][0] or ''}\n{texts[c][1]}") // 4)
        if used + cost >= max(int(tokens * 0.9), 100):
            break
        used += cost
        out.append((c, held[c]))
    return out


def brute(corpus, query, k, tokens):
    sources = sorted(corpus["sources"], key=lambda x: x[1])
    graphed = {s for s, _, _ in corpus["nodes"]}
    others = [s for s, _ in sources if s not in graphed]
    out, budget = [], max(int(tokens * 0.9), 100)
    for source, _ in sources:
        if source in graphed:
            out += [(source, c) for c, _ in brute_run(corpus, source, query, max(1, k // len(sources)), max(1, 2 * k, k + 5), tokens)]
        elif source == others[0]:
            used, kept = 0, []
            for s in others:
                own, held = max(1, k // len(others)), 0
                found = sorted(((-cosine(v, query), c) for t, c, v in corpus["vectors"] if t == s and usable(v) and len(v) == len(query)))[: max(own, 20)]
                texts = {c: (name, t) for t_, c, name, t in corpus["chunks"] if t_ == s}
                for _, c in found:
                    cost = -(-len(f"{texts[c][0] or ''}\n{texts[c][1]}") // 4) if c in texts and texts[c][1] is not None else None
                    if cost is not None and held < own and used + cost < budget:
                        used, held = used + cost, held + 1
                        kept.append((s, c))
            out += kept[: max(k, len(others))]
    return out


def collected(corpus):
    columns = {"sources": "source_id place", "nodes": "source_id node embedding", "edges": "source_id src dst weight", "links": "source_id node chunk", "chunks": "source_id chunk name text", "vectors": "source_id chunk embedding"}
    return {name: [tuple(r[c] for c in cs.split()) for r in corpus[name].collect()] for name, cs in columns.items()}


def test_equals_one_question_at_a_time(spark):
    corpus, asked = graph_corpus(spark, SF), _queries(spark, SF)
    rows = collected(corpus)
    found = defaultdict(list)
    for r in sorted(G.graph_search(corpus, asked, 92, tokens=4000).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["source_id"], r["chunk"]))
    for q in asked.collect():
        assert found[q["query_id"]] == brute(rows, list(q["query"]), 92, 4000)


def made(spark, seed):
    """A graph with a hub beyond the limit of nodes, loops, parallel edges, weights of 0 and null, nodes without vectors, and one without edges."""
    rng = np.random.default_rng(seed)
    vector = lambda: rng.normal(size=4).round(3).tolist()
    hub = [vector() for _ in range(4)]
    nodes = [("g", f"n{i:04d}", None if i % 9 == 5 else vector()) for i in range(900)] + [("h", f"m{i}", vector()) for i in range(12)] + [("bare", "x", None)]
    nodes[0] = ("g", "n0000", hub[0])
    edges = [("g", "n0000", f"n{i:04d}", float(rng.integers(0, 3))) for i in range(1, 700)] + [("g", f"n{a:04d}", f"n{b:04d}", None if (a + b) % 7 == 0 else 1.5) for a, b in rng.integers(0, 900, (3000, 2))] + [("h", "m0", "m0", 1.0), ("h", "m1", "m2", 2.0), ("h", "m1", "m2", 1.0)]
    links = [("g", f"n{i:04d}", int(c)) for i in range(900) for c in rng.integers(0, 200, 2)] + [("h", f"m{i % 12}", i) for i in range(30)] + [("h", "m1", 1)]
    chunks = [("g", c, f"f{c}", None if c % 13 == 0 else "" if c % 11 == 0 else "w" * int(rng.integers(1, 900))) for c in range(200)] + [("h", c, None, "t" * 50) for c in range(25)] + [(s, c, "v", "z" * int(rng.integers(1, 400))) for s in ("v1", "v2", "v3") for c in range(30)]
    vectors = [(s, c, vector()) for s in ("v1", "v2", "v3") for c in range(30)]
    sources = [("v2", 1), ("g", 2), ("v1", 3), ("h", 4), ("bare", 5), ("v3", 6)]
    kinds = {"sources": "source_id string, place int", "nodes": "source_id string, node string, embedding array<double>", "edges": "source_id string, src string, dst string, weight double", "links": "source_id string, node string, chunk int", "chunks": "source_id string, chunk int, name string, text string", "vectors": "source_id string, chunk int, embedding array<double>"}
    tables = {"sources": sources, "nodes": nodes, "edges": edges, "links": links, "chunks": chunks, "vectors": vectors}
    asked = [(0, hub[0]), (1, vector()), (2, [-x for x in hub[0]]), (3, vector())]
    return {n: spark.createDataFrame(t, kinds[n]).repartition(3) for n, t in tables.items()}, tables, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_hubs_loops_and_missing_vectors(spark, seed):
    corpus, rows, asked = made(spark, seed)
    questions = spark.createDataFrame(asked, "query_id int, query array<double>")
    for k, tokens in ((30, 1500), (4, 120)):
        found = defaultdict(list)
        for r in sorted(G.graph_search(corpus, questions, k, tokens=tokens).collect(), key=lambda r: r["rank"]):
            found[r["query_id"]].append((r["source_id"], r["chunk"]))
        for i, q in asked:
            assert found[i] == brute(rows, q, k, tokens), (i, k)
    hits = retrieval.retrieve("graphrag", corpus, questions, 6)
    assert hits.columns == ["query_id", "doc_id", "score", "rank"] and hits.count() > 0


def test_pagerank_scores_to_1e_9():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (60, 150)):
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.uniform(0.1, 3, m))]
        for start in (np.zeros(n), rng.uniform(size=n) * (rng.uniform(size=n) < 0.3)):
            src, dst, w = (np.array([e[i] for e in edges], t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
            want = plain_pagerank(list(range(n)), edges, dict(enumerate(start)))
            assert np.allclose(G.pagerank(n, src, dst, w, start), [want[i] for i in range(n)], atol=1e-9)
