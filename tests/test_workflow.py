"""Workflow runs that advance together against a plain interpreter of one run after the other."""

from __future__ import annotations

import random

import pytest

from brindle.operators.workflow import ELSE, Node, Workflow, run_workflow

OPERATIONS = {"x + 1": lambda s: s["x"] + 1, "x * 2 - y": lambda s: s["x"] * 2 - s["y"], "y": lambda s: s["y"], "greatest(x, y)": lambda s: max(s["x"], s["y"]), "0": lambda s: 0}
CASES = {"x > 5": lambda s: s["x"] > 5, "y % 2 = 0": lambda s: s["y"] % 2 == 0, "x = y": lambda s: s["x"] == s["y"], "null": lambda s: False, " ": None, "name = 'a'": lambda s: s["name"] == "a"}


def interpret(flow, state, max_steps):
    state, node, log = dict(state), next(i for i, n in flow.nodes.items() if n.kind == "start"), []
    for step in range(max_steps):
        if node not in flow.nodes:
            return "failed", step, state, log
        before, here = dict(state), flow.nodes[node]
        for variable, expression in here.operations:
            state[variable] = OPERATIONS[expression](state)
        log.append((step, node, {k: None if v is None else str(v) for k, v in state.items() if (before[k] != v if step else v is not None)}))
        if here.kind == "end":
            return "completed", step + 1, state, log
        handle = None
        if here.kind == "condition":
            handle = next((h for h, e in here.cases if CASES[e] and CASES[e](state)), ELSE)
        node = next((b for a, b, h in flow.edges if a == node and handle in (None, h)), None)
        if node is None:
            return "ended", step + 1, state, log
    return "max_steps", max_steps, state, log


def generated(rng):
    names = [f"n{i}" for i in range(rng.randrange(2, 8))]
    nodes = {"go": Node("start")}
    for name in names:
        kind = rng.choice(["state", "state", "condition", "note", "end"])
        operations = tuple((rng.choice("xy"), rng.choice(list(OPERATIONS))) for _ in range(rng.randrange(4))) if kind == "state" else ()
        nodes[name] = Node(kind, operations, tuple((rng.choice("abc"), rng.choice(list(CASES))) for _ in range(rng.randrange(4))) if kind == "condition" else ())
    edges = [("go", rng.choice(names), None)] + [(rng.choice(names), rng.choice([*names, *names, "nowhere"]), rng.choice(["a", "b", "c", ELSE])) for _ in range(len(names) * 3)]
    return Workflow(nodes, tuple(edges))


def test_generated_workflows(spark):
    rng, seen = random.Random(8), set()
    for _ in range(6):
        flow = generated(rng)
        states = [{"x": rng.randrange(8), "y": rng.randrange(8), "name": rng.choice(["a", "b", None])} for _ in range(12)]
        runs = spark.createDataFrame([(i, s["x"], s["y"], s["name"]) for i, s in enumerate(states)], "run int, x long, y long, name string").repartition(2)
        over, log = run_workflow(flow, runs, "run", max_steps=7)
        got = {r["run"]: (r["status"], r["steps"], {"x": r["x"], "y": r["y"], "name": r["name"]}) for r in over.collect()}
        steps = sorted((r["run"], r["step"], r["node"], r["delta"]) for r in log.collect())
        want = {i: interpret(flow, s, 7) for i, s in enumerate(states)}
        assert got == {i: w[:3] for i, w in want.items()}
        assert steps == [(i, *e) for i, w in want.items() for e in w[3]]
        seen |= {w[0] for w in want.values()}
    assert len(seen) >= 3


def test_a_workflow_needs_a_start_and_its_variables(spark):
    runs = spark.createDataFrame([(1, 2)], "run int, x long")
    with pytest.raises(ValueError):
        run_workflow(Workflow({"a": Node("end")}), runs, "run")
    with pytest.raises(ValueError):
        run_workflow(Workflow({"a": Node("start"), "b": Node("state", (("z", "1"),))}), runs, "run")
    with pytest.raises(ValueError):
        Workflow({"a": Node("loop")})
