"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking.

Rotations are learned on a bounded sample (``sample`` vectors, a documented bound): each turns the
principal components so that their signs are balanced binary codes close to the data. A code is the
signs of a whole vector through the origin, under one rotation after the other: only there a pair's
angle is that of its cosine, whatever direction all vectors share. The code is cut into
substrings, each the key of one table. A table is searched in the Hamming ball of radius 1: a vector is
filed under its key and asks for the keys that have one bit more, so every pair whose substrings differ in at most one
bit meets once. Of these, pairs whose whole codes differ in more bits than nearly all linked pairs are dropped by
counting bits. The width of a substring grows with the logarithm of the number of vectors; the number of tables
follows from it, the threshold and the wanted recall of a pair right at the threshold.

Tables hold codes, not vectors. A first pass over them names the vectors that have a candidate, a second
brings these vectors (no others) to the same tiles and compares the candidates by cosine in double precision. A key
that holds more entries than a tile is dealt into pairs of blocks. Each pair is settled by the first table that
brings it together, so counts add up. Tasks return counts and a spanning forest of their links (each vector hangs
on the smallest that its links reach within the call), never pairs.

Equal vectors are one class with a count, and links between them are counted, not made.

Defined cases: a vector that is null, empty, zero, of another length than most or holds null or
non-finite components links with nothing (n_links 0, its own component); repeated rows are vectors of
their own, but those that repeat a vec_id share its links; a null vec_id links with nothing; columns other than vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut
from brindle.llm.graph import components
from brindle.llm.vectors import dot_in_order, matrix, modal_width, usable

#: Entries that one key may hold before it is dealt into tiles of so many.
TILE = 4096
#: Entries that one task call holds at about this number.
GROUP_ROWS = 32768
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Copies of a vector look their class up in so many parts.
SALTS = 8

_ENTRY = "tab int, key long, probe boolean, id long, code binary"
_LINKS = "id long, n long, up long"


def learn_rotations(sample: np.ndarray, bits: int, count: int, rounds: int = 30, seed: int = 0) -> list[np.ndarray]:
    """``count`` projections to ``bits`` balanced signs, by alternating codes and rotation."""
    centred = sample - sample.mean(axis=0)
    _, _, axes = np.linalg.svd(centred.T @ centred)
    base = axes[:bits].T
    projected = centred @ base
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(count):
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ projected)
            rotation = (u @ v).T
        found.append(base @ rotation)
    return found


class Plan(NamedTuple):
    """Bits of a substring, number of tables, rotations, bits that codes of a pair may differ in."""

    part: int
    tables: int
    rotations: int
    limit: int


def plan_tables(n: int, width: int, threshold: float, recall: float) -> Plan:
    part = min(40, max(8, math.ceil(math.log2(max(n, 2))) - 3))
    flip = math.acos(threshold) / math.pi  # chance that a bit differs right at the threshold
    meet = (1 - flip) ** part + part * flip * (1 - flip) ** (part - 1)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    rotations = -(-tables * part // width)
    bits = rotations * width
    return Plan(part, tables, rotations, math.ceil(bits * flip + 4 * math.sqrt(bits * flip * (1 - flip))))


def encode(unit: np.ndarray, rotations: list[np.ndarray]) -> list[bytes]:
    """The code of every vector, filled up to whole 64-bit words."""
    signs = np.concatenate([unit @ r >= 0 for r in rotations], axis=1)
    packed = np.packbits(signs, axis=1)
    return [row.tobytes() for row in np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))]


def substrings(codes: np.ndarray, plan: Plan) -> np.ndarray:
    """The key of every code (rows of 64-bit words) in every table."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    weight = 1 << np.arange(plan.part, dtype=np.int64)
    return np.stack([bits[:, t * plan.part : (t + 1) * plan.part] @ weight for t in range(plan.tables)], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), -1)


def candidate_pairs(tab: int, key: np.ndarray, probe: np.ndarray, own: np.ndarray, codes: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a tile that this table settles, a bounded number at a time. Sorted by key, filed entries first."""
    starts = np.searchsorted(key, key, side="left")
    filed = np.concatenate([[0], np.cumsum(~probe)])
    stops = starts + filed[np.searchsorted(key, key, side="right")] - filed[starts]
    begins = np.where(probe, starts, np.arange(len(key)) + 1)  # one that is filed meets those behind it, one that asks all that are filed
    count = np.maximum(stops - begins, 0)
    apart = own[0] != own.max() or own[0] != own.min()  # a tile of two blocks: pairs within a block belong to another
    keys = substrings(codes, plan)[:, :tab] if tab else None
    total = np.cumsum(count)
    at = 0
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = count[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = np.repeat(begins[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if apart:
            ok = own[a] != own[b]
            a, b = a[ok], b[ok]
        near = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1) <= plan.limit
        a, b = a[near], b[near]
        if tab and len(a):
            differ = keys[a] ^ keys[b]
            fresh = ~((differ & (differ - 1)) == 0).any(axis=1)  # no earlier table has brought them together
            a, b = a[fresh], b[fresh]
        if len(a):
            yield a, b
        at = stop


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of linked places: ``root`` holds the root of every place, before and after."""
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high > low
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: cosine of at least ``threshold`` is a link."""
    width = modal_width(vectors)
    rows = vectors.select("vec_id", F.when(usable(width) & F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("x"))
    classes = rows.filter("x is not null").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("c"))
    classes = cut(classes, "classes")
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    plan = plan_tables(n, width, threshold, recall)
    order = F.pmod(F.xxhash64("x"), F.lit(1 << 32))
    some = classes if n <= 4 * sample else classes.filter(order < (1 << 32) * 4 * sample // n)  # few more than are taken, however many tasks
    fit = matrix(some.orderBy(order, "id").limit(sample).select("x").toArrow()["x"], width)
    rotations = learn_rotations(fit / np.linalg.norm(fit, axis=1, keepdims=True), width, plan.rotations)
    spread = max(1, math.ceil(n * (1 + plan.part / 2) / GROUP_ROWS))  # calls of a table

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], width)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["c"], batch["x"], pa.array(encode(unit, rotations), pa.binary())], names=["id", "c", "x", "code"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = 1 << np.arange(plan.part, dtype=np.int64)
        for batch in batches:
            keys, every = substrings(_matrix(batch["code"]), plan), np.arange(len(batch))
            for t in range(plan.tables):
                key = keys[:, t]
                asks, which = np.nonzero((key[:, None] & bit) == 0)
                at = np.concatenate([every, asks])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), t), pa.int32()), pa.array(np.concatenate([key, key[asks] | bit[which]])), pa.array(np.arange(len(at)) >= len(key)),
                    batch["id"].take(pa.array(at)), batch["code"].take(pa.array(at)),
                ], names=["tab", "key", "probe", "id", "code"])

    coded = cut(classes.select("id", "c", "x").mapInArrow(code, "id long, c long, x array<double>, code binary"), "codes")
    filed = coded.select("id", "code").mapInArrow(file, _ENTRY)
    hot = filed.groupBy("tab", "key").agg(F.count("*").alias("size")).filter(F.col("size") > TILE)
    hot = cut(hot.withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int")).drop("size"), "hot")
    n_hot = hot.count()
    if n_hot:
        filed = filed.join(F.broadcast(hot) if n_hot <= 10_000 else hot, ["tab", "key"], "left")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        filed = filed.withColumn("own", F.coalesce(block, F.lit(-1))).withColumn("other", other).drop("blocks")
    else:
        filed = filed.withColumn("own", F.lit(-1)).withColumn("other", F.lit(-1))
    # keys of few entries share a call; a tile of a large key has one of its own
    call = F.when(F.col("other") < 0, F.pmod(F.xxhash64("key"), F.lit(spread))).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    filed = filed.withColumn("call", call).drop("other")

    def arranged(table: pa.Table) -> tuple[pa.Table, tuple]:
        order_ = np.lexsort((table["probe"].to_numpy(zero_copy_only=False), table["key"].to_numpy()))
        table = table.take(pa.array(order_))
        return table, (table["tab"][0].as_py(), table["key"].to_numpy(), table["probe"].to_numpy(zero_copy_only=False), table["own"].to_numpy(), _matrix(table["code"]), plan)

    def find(table: pa.Table) -> pa.Table:
        table, parts = arranged(table)
        some = np.zeros(table.num_rows, dtype=bool)
        for a, b in candidate_pairs(*parts):
            some[a] = some[b] = True
        return table.filter(pa.array(some)).select(["tab", "call", "key", "probe", "own", "id", "code"])

    def link(table: pa.Table) -> pa.Table:
        table, parts = arranged(table)
        ids, counts, x = table["id"].to_numpy(), table["c"].to_numpy(), matrix(table["x"], width)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        norms = np.sqrt(dot_in_order(x, x))
        n_links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, j in candidate_pairs(*parts):
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold - 1e-4
            i, j = i[ok], j[ok]
            ok = dot_in_order(x[i], x[j]) / (norms[i] * norms[j]) >= threshold
            i, j = i[ok], j[ok]
            np.add.at(n_links, i, counts[j])
            np.add.at(n_links, j, counts[i])
            _unite(root, i, j)
        least = ids.copy()
        np.minimum.at(least, root, ids)
        some, up = n_links > 0, least[root]
        return pa.table({"id": pa.array(ids[some], pa.int64()), "n": pa.array(n_links[some], pa.int64()), "up": pa.array(up[some], pa.int64())})

    found = cut(filed.groupBy("tab", "call").applyInArrow(find, "tab int, call long, key long, probe boolean, own int, id long, code binary"), "candidates")
    tiles = found.join(coded, ["id", "code"])
    found = cut(tiles.groupBy("tab", "call").applyInArrow(link, _LINKS), "vector-links")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("up").alias("b")))
    labelled = cut(links.join(labels, "id", "left"), "labels")

    # copies find their class by two hashes of the vector, in parts; a vector without copies is its own class
    sign = lambda x: [F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")]
    copies = classes.filter("c > 1").join(labelled, "id", "left").select(*sign("x"), "id", "c", "n", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")
    of_copies = rows.filter("x is not null").select("vec_id", *sign("x"), salt).join(copies, ["h", "g", "salt"], "left")
    single = labelled.select(F.col("id").alias("vec_id"), F.col("n").alias("n_own"), F.col("component").alias("component_own"))
    n_links = F.when(F.col("id").isNull(), F.coalesce("n_own", F.lit(0))).otherwise(F.coalesce("n", F.lit(0)) + F.col("c") - 1)
    out = of_copies.join(single, "vec_id", "left").select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "id", "component_own", "vec_id").alias("component_id"))
    alone = rows.filter("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
