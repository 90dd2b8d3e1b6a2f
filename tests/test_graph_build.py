"""Applying extractions to a graph against one chunk at a time; twice is once; degrees are those of a recount."""

from __future__ import annotations

import random
from collections import Counter

from brindle.operators import graph, graph_build

KIND = f"source_id string, chunk long, entities {graph_build._ENTITY}, relationships {graph_build._RELATION}"


def one_by_one(chunks):
    nodes, edges, links, done = {}, [], set(), {}

    def upsert(source, name, kind=None, said=None):
        node = nodes.setdefault((source, name.lower()), {"name": name, "type": None, "said": "", "n": 0})
        node["n"] += 1
        node["type"] = node["type"] or kind or None
        if said and said not in node["said"]:
            node["said"] += (" " if node["said"] else "") + said

    for source, chunk, entities, relations in chunks:
        if chunk is None or done.get((source, chunk)) == "done":
            continue
        if entities is None or relations is None:
            done[source, chunk] = "failed"
            continue
        own = set()
        for name, kind, said in entities:
            if name and name.strip():
                upsert(source, name.strip(), kind, said)
                own.add(name.strip().lower())
                links.add((source, name.strip().lower(), chunk))
        for a, b, kind, said, weight in relations:
            ends = []
            for x in (a, b):
                if x and x.strip():
                    if x.strip().lower() not in own:
                        upsert(source, x.strip())
                        own.add(x.strip().lower())
                    ends.append(x.strip().lower())
            if len(ends) == 2:
                try:
                    w = float(weight) or 1.0
                except (TypeError, ValueError):
                    w = 1.0
                edges.append((source, *ends, kind or None, said or None, w, chunk))
        done[source, chunk] = "done"
    return nodes, edges, links, done


def state(g):
    names = {(r["source_id"], r["node"]): r["normalized_name"] for r in g["nodes"].collect()}
    nodes = {(r["source_id"], r["normalized_name"]): {"name": r["name"], "type": r["type"], "said": r["description"] or "", "n": r["doc_freq"]} for r in g["nodes"].collect()}
    edges = [(r["source_id"], names[r["source_id"], r["src"]], names[r["source_id"], r["dst"]], r["type"], r["description"], r["weight"], r["chunk"]) for r in g["edges"].collect()]
    links = {(r["source_id"], names[r["source_id"], r["node"]], r["chunk"]) for r in g["links"].collect()}
    assert g["links"].count() == len(links)
    degree = {(r["source_id"], r["node"]): r["degree"] for r in g["nodes"].collect() if r["degree"]}
    recount = Counter()
    for s in {e[0] for e in edges}:
        recount.update({(s, r["node"]): r["degree"] for r in graph.degrees(g["edges"].filter(g["edges"].source_id == s)).collect()})
    assert degree == dict(recount)
    return nodes, sorted(edges, key=repr), links, {(r["source_id"], r["chunk"]): r["status"] for r in g["progress"].collect()}


def chunks_of(seed, n):
    rng = random.Random(seed)
    name = lambda: rng.choice(["Ada", "ada ", "Engine", "Babbage", "\tNote", "É", "é", "", " ", None, "x"])
    said = lambda: rng.choice([None, "", "a pioneer", "pioneer", "of engines", "a pioneer of engines"])
    rows = []
    for chunk in range(n):
        entities = None if rng.random() < 0.1 else [(name(), rng.choice([None, "", "person", "thing"]), said()) for _ in range(rng.randrange(4))]
        relations = None if rng.random() < 0.05 else [(name(), name(), rng.choice([None, "made"]), said(), rng.choice(["2", "0", "x", None, "0.5"])) for _ in range(rng.randrange(4))]
        rows.append((rng.choice(["s", "t"]), chunk, entities, relations))
    return rows


def applied(spark, *batches):
    g = graph_build.empty_graph(spark)
    for rows in batches:
        g = graph_build.apply_chunks(g, spark.createDataFrame(rows, KIND).repartition(3))
    return state(g)


def test_equals_one_chunk_at_a_time(spark):
    rows = chunks_of(1, 40)
    nodes, edges, links, done = one_by_one(rows)
    assert applied(spark, rows) == (nodes, sorted(edges, key=repr), links, done)


def test_twice_is_once_and_failed_chunks_come_again(spark):
    rows = chunks_of(2, 24)
    later = [(s, c, e or [("Late", None, None)], r or []) for s, c, e, r in rows]
    half = rows[:12]
    nodes, edges, links, done = one_by_one([*half, *rows, *later])
    assert applied(spark, half, [*rows, *rows, ("s", None, [], [])], rows, later) == (nodes, sorted(edges, key=repr), links, done)


def test_nothing(spark):
    assert applied(spark, []) == ({}, [], set(), {})
