"""Workflow runs: many runs of a graph of nodes advance together, a round a step.

A run is a row: its key, the node that it is at, and the variables of its state as columns of their own types. A round is a
projection, without a shuffle: the operations of each run's node change its variables, then the first case that holds, or the
first edge, names the next node. What a round made is written, so a lost executor repeats one step; runs that
have ended are not read again. Expressions are Spark SQL over the variables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.shared import cut

# Steps of a run at most, kinds of nodes, and the handle of a condition of which no case holds.
MAX_STEPS = 50
KINDS = ("start", "note", "state", "condition", "end")
ELSE = "else"


@dataclass(frozen=True)
class Node:
    """A node: a state node has operations (variable, expression), done one after the other; a condition has cases (handle, expression)."""

    kind: str
    operations: tuple[tuple[str, str], ...] = ()
    cases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Workflow:
    """Nodes by id, and edges (from, to, handle) in order; a handle counts behind a condition only."""

    nodes: dict[str, Node]
    edges: tuple[tuple[str, str, str | None], ...] = field(default=())

    def __post_init__(self) -> None:
        unknown = {n.kind for n in self.nodes.values()} - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds of nodes: {sorted(unknown)}")

    @property
    def start(self) -> str:
        found = next((i for i, n in self.nodes.items() if n.kind == "start"), None)
        if found is None:
            raise ValueError("a workflow needs a start node")
        return found

    def target(self, node: str, handle: str | None = None) -> str | None:
        return next((b for a, b, h in self.edges if a == node and (handle is None or h == handle)), None)

    def after(self, node: str) -> Column:
        """The node behind ``node``, null if there is none."""
        if self.nodes[node].kind != "condition":
            return F.lit(self.target(node)).cast("string")
        cases = [(F.coalesce(F.expr(e).cast("boolean"), F.lit(False)), h) for h, e in self.nodes[node].cases if e.strip()]
        last = F.lit(self.target(node, ELSE)).cast("string")
        return reduce(lambda rest, case: F.when(case[0], F.lit(self.target(node, case[1])).cast("string")).otherwise(rest), reversed(cases), last)


def _by_node(flow: Workflow, of: dict[str, Column], otherwise: Column) -> Column:
    return reduce(lambda rest, x: F.when(F.col("_node") == x[0], x[1]).otherwise(rest), of.items(), otherwise)


def run_workflow(flow: Workflow, runs: DataFrame, key: str, max_steps: int = MAX_STEPS) -> tuple[DataFrame, DataFrame]:
    """What became of all runs, and what each step did.

    ``runs`` has the key and the variables as they are at first; a variable that an operation names must be among them. The first
    frame has key, status, steps (nodes passed) and the variables: status is ``completed`` at an end node, ``ended`` where a branch ends
    before one, ``failed`` where an edge leads to no node, ``max_steps`` if the run was not over by then. The second has key, step (from 0), node, delta:
    the variables that the step changed or, in the first step, that are not null, as text. A case that is null does not hold.
    Spark's errors end the job, so operations that may fail use the try_ functions.
    """
    variables = [c for c in runs.columns if c != key]
    kinds = dict(runs.dtypes)
    unknown = {v for n in flow.nodes.values() for v, _ in n.operations} - set(variables)
    if unknown:
        raise ValueError(f"no such variables: {sorted(unknown)}")
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
    depth = max((len(n.operations) for n in flow.nodes.values()), default=0)
    active = runs.withColumn("_node", F.lit(flow.start))
    over, log = [], []
    for step in range(max_steps):
        after = active.select(key, "_node", *variables, *(text(v).alias(f"_was_{v}") for v in variables))
        for k in range(depth):  # the operations of a node see what those before have done
            at = {(i, n.operations[k]) for i, n in flow.nodes.items() if k < len(n.operations)}
            for v in {v for _, (v, _) in at}:
                after = after.withColumn(f"_new_{v}", _by_node(flow, {i: F.expr(e).cast(kinds[v]) for i, (w, e) in sorted(at) if w == v}, F.col(v)))
            for v in {v for _, (v, _) in at}:
                after = after.withColumn(v, F.col(f"_new_{v}")).drop(f"_new_{v}")
        known = F.col("_node").isin(*flow.nodes)
        after = after.withColumn("_next", _by_node(flow, {i: flow.after(i) for i in flow.nodes}, F.lit(None).cast("string")))
        status = F.when(~known, "failed").when(_by_node(flow, {i: F.lit(n.kind == "end") for i, n in flow.nodes.items()}, F.lit(False)), "completed").when(F.col("_next").isNull(), "ended").otherwise("max_steps" if step + 1 == max_steps else None)
        done = cut(after.withColumn("_status", status), "workflow")
        entry = lambda v: F.struct(F.lit(v).alias("key"), F.get_json_object(F.concat(F.lit('{"d":'), text(v), F.lit("}")), "$.d.v").alias("value"), (text(v) != F.col(f"_was_{v}") if step else F.col(v).isNotNull()).alias("new"))
        changed = F.map_from_entries(F.transform(F.filter(F.array(*map(entry, variables)), lambda e: e["new"]), lambda e: F.struct(e["key"], e["value"])))
        log.append(done.filter(F.col("_node").isin(*flow.nodes)).select(key, F.lit(step).alias("step"), F.col("_node").alias("node"), changed.alias("delta")))
        over.append(done.filter("_status is not null").select(key, F.col("_status").alias("status"), (F.lit(step) + F.when(F.col("_status") == "failed", 0).otherwise(1)).alias("steps"), *variables))
        active = done.filter("_status is null").select(key, F.col("_next").alias("_node"), *variables)
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, over), reduce(DataFrame.unionByName, log)
