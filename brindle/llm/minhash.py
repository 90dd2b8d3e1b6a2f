"""Near-duplicate texts: ProbMinHash signatures, banding, verification.

A text is the multiset of its runs of five words (a shorter text is one run of all its words), each
run weighted by how often it occurs; similarity is the probability Jaccard of the weights, which
is plain Jaccard where no run repeats. A signature component is won by the run that arrives first:
every run sends a Poisson process of arrivals at the rate of its weight to random components, and
stops as soon as its next arrival is later than the last component's winner. Equal texts are one
class from the start. Bands of the signature file classes into buckets.

Verification is exact and takes two steps, neither of which forms the pairs of a bucket. First
each class is compared with the most central class of its buckets. What this does not
settle is compared again: classes that buckets connect make a group, and those outside of the
group's largest component meet the whole group, in tiles of bounded size; a tile estimates from
signatures, verifies from the runs and returns no more links than it has classes.

Defined cases: a text without words (null, empty or white space) links with nothing; rows that
repeat a doc_id are documents of their own, the first of them in reading order goes first; a null
doc_id comes before all others; columns other than doc_id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SECOND, cut, mix, positions, rolling, runs, slices, split_words, word_hashes
from brindle.llm.graph import components

#: Classes of a tile: those that are not settled, and those that they meet.
TILE_ROWS, TILE_COLUMNS = 256, 1024
#: Bytes of runs that one call holds at about this number.
TILE_BYTES = 8 << 20
#: Texts whose names are broadcast to find them where they lie; more are joined.
MAX_WANTED = 250_000
#: Copies of a text look their class up in so many parts.
SALTS = 16

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_runs(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of each text, ascending, their counts, the text of each; where each text's words begin."""
    codes, offsets, vocabulary = split_words(texts)
    hashes = mix(word_hashes(vocabulary))[codes] if len(codes) else np.zeros(0, np.uint64)
    place, owner = positions(offsets)
    lengths = np.diff(offsets)
    keys, owners = [], []
    if len(hashes) >= words:
        inside = place[: len(hashes) - words + 1] + words <= lengths[owner[: len(hashes) - words + 1]]
        keys.append(rolling(hashes, words)[inside])
        owners.append(owner[: len(inside)][inside])
    for n in range(1, words):  # texts of fewer words
        at = offsets[:-1][lengths == n]
        if len(at):
            keys.append(rolling(hashes, n)[at])
            owners.append(np.flatnonzero(lengths == n))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    first = np.flatnonzero(runs(own, key)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))), own[first], offsets


def class_keys(texts: pa.Array) -> list[bytes | None]:
    """128 bits that stand for a text's sequence of words; None for a text without words."""
    codes, offsets, vocabulary = split_words(texts)
    hashes = mix(word_hashes(vocabulary))[codes] if len(codes) else np.zeros(0, np.uint64)
    place, owner = positions(offsets)
    n = len(offsets) - 1
    with_place = [mix(hashes ^ mix(place.astype(np.uint64) * m + m)) for m in (_GOLDEN, SECOND)]
    starts = offsets[:-1][np.diff(offsets) > 0]
    out: list[bytes | None] = [None] * n
    if len(starts):
        sums = np.stack([np.add.reduceat(x, starts) for x in with_place], axis=1)
        for i, row in zip(np.flatnonzero(np.diff(offsets) > 0), sums):
            out[i] = row.astype(">u8").tobytes()
    return out


def signatures(key: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash of each text: 16 bits of the run that wins each of ``size`` components."""
    best = np.full(n * size, np.inf)
    winner = np.zeros(n * size, dtype=np.uint64)
    limit = np.full(n, np.inf)
    time, step = np.zeros(len(key)), 0
    weight = weight.astype(float)
    while len(key):
        step += 1
        draw = mix(key + np.uint64(step * int(_GOLDEN) % (1 << 64)))
        time = time - np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)) / weight
        component = ((mix(draw ^ SECOND) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        slot = owner * size + component.astype(np.int64)
        early = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[early], time[early])
        won = early[best[slot[early]] == time[early]]
        winner[slot[won]] = key[won]
        if step < 8 or step % 8 == 0:
            some = np.unique_values(owner)
            limit[some] = best.reshape(n, size)[some].max(axis=1)
            going = time < limit[owner]
            key, weight, owner, time = key[going], weight[going], owner[going], time[going]
    return (mix(winner) >> np.uint64(48)).astype(np.uint16).reshape(n, size)


def probability_jaccard(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> float:
    """Of two ascending arrays of runs with their counts (None: all are 1)."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = a[at] == b
    if x is None and y is None:
        n = int(common.sum())
        return n / (len(a) + len(b) - n)
    x = np.ones(len(a)) if x is None else x.astype(float)
    y = np.ones(len(b)) if y is None else y.astype(float)
    u, v = x[at[common]], y[common]
    alone_a, alone_b = x.sum() - u.sum(), y.sum() - v.sum()
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    ratio = u / v
    # sum over j of max(x_j / x_i, y_j / y_i): the first is larger where x_j / y_j is at least x_i / y_i
    first = np.searchsorted(ratio, ratio, side="left")
    after = np.concatenate([np.cumsum(u[::-1])[::-1], [0.0]])[first] + alone_a
    before = np.concatenate([[0.0], np.cumsum(v)])[first] + alone_b
    return float((1 / (after / u + before / v)).sum())


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of every signature in every band."""
    out = np.zeros((len(sigs), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out * _GOLDEN + sigs[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64) * SECOND).view(np.int64)


class _Find:
    """Union-find over the places of a tile."""

    def __init__(self, labels: list):
        seen: dict = {}
        self.up = [seen.setdefault(label, i) for i, label in enumerate(labels)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def _numbers(data: list[bytes | None]) -> list[np.ndarray | None]:
    """Runs and their counts, in turn, as numbers."""
    return [None if x is None else np.frombuffer(x, np.uint32 if i % 2 else np.uint64) for i, x in enumerate(data)]


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 7) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id that links reach), kept (the first of its component), text_hash.

    Two texts link where their probability Jaccard is at least ``threshold``. text_hash is xxhash64
    of the text: with doc_id it names the row.
    """
    size = bands * rows
    least = threshold - 3.5 * (threshold * (1 - threshold) / size) ** 0.5  # estimates of linked pairs lie above it

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                key, weight, owner, _ = weighted_runs(batch["text"], words)
                sigs = signatures(key, weight, owner, len(batch), size)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"], batch["text_hash"], pa.array(class_keys(batch["text"]), pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()),
                ], names=["doc_id", "text_hash", "digest", "sig"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sigs, bands, rows).ravel()), pa.array(np.repeat(batch["cls"].to_numpy(), bands))], names=["key", "cls"])

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                key, weight, owner, _ = weighted_runs(batch["text"], words)
                cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
                wanted = zip(batch["cls"].to_pylist(), batch["digest"].to_pylist(), class_keys(batch["text"]), cuts, cuts[1:])
                out = [(c, key[a:b].tobytes(), weight[a:b].astype(np.uint32).tobytes() if (weight[a:b] > 1).any() else None, int(b - a)) for c, d, f, a, b in wanted if d == f]
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["cls", "runs", "counts", "n"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = source.mapInArrow(sign, "doc_id long, text_hash long, digest binary, sig binary").withColumn("row", F.monotonically_increasing_id())
    signed = cut(signed, "signed")
    first = F.min(F.struct("doc_id", "row", "text_hash")).alias("first")
    # a class goes by the row number of its first document from here on
    classes = signed.filter("digest is not null").groupBy("digest").agg(first, F.any_value("sig").alias("sig"), F.count("*").alias("copies"))
    classes = cut(classes.select("digest", F.col("first.row").alias("cls"), "first", "sig", "copies"), "classes")

    # Buckets of two classes or more; of those with the same members one is enough.
    filed = classes.select("cls", "sig").mapInArrow(file, "key long, cls long")
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x")).filter("n > 1")
    chosen = sizes.groupBy("n", "m", "x").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    bucketed = cut(filed.join(chosen.select("key", "n", "times"), "key"), "bucketed")

    # The runs of classes that share a bucket.
    shared = bucketed.groupBy("cls").agg(F.sum((F.col("n") - 1) * F.col("times")).alias("degree"))
    name = lambda i, h: F.xxhash64(i, h).alias("name")
    texts = cut(shared.select("cls").join(classes, "cls").select("cls", "digest", name("first.doc_id", "first.text_hash")), "wanted")
    wanted = F.broadcast(texts) if texts.count() <= MAX_WANTED else texts
    listed = source.select(name("doc_id", "text_hash"), "text").join(wanted, "name").select("cls", "digest", "text")
    listed = listed.mapInArrow(list_runs, "cls long, runs binary, counts binary, n long").dropDuplicates(["cls"])
    listed = cut(listed.join(classes.select("cls", "sig"), "cls"), "runs")

    # Each class with the most central one of its buckets.
    ranked = bucketed.join(shared, "cls").select("key", "cls", F.struct("degree", "cls").alias("rank"))
    centre = cut(ranked.groupBy("key").agg(F.max("rank").alias("rank")), "centres")
    pairs = bucketed.join(centre, "key").groupBy("cls").agg(F.max("rank").alias("rank")).select(F.col("rank.cls").alias("a"), F.col("cls").alias("b")).filter("a <> b")
    side = lambda x, y: listed.select(F.col("cls").alias(x), F.col("runs").alias(f"runs_{y}"), F.col("counts").alias(f"counts_{y}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch[c] for c in ("runs_a", "counts_a", "runs_b", "counts_b")))
            ok = [probability_jaccard(*_numbers([x.as_py() for x in one])) >= threshold for one in sides]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    near = pairs.join(side("b", "b"), "b").join(side("a", "a"), "a").mapInArrow(verify, "a long, b long, ok boolean")
    links = cut(near.filter("ok").select("a", "b"), "central-links")
    labels = cut(components(links), "labels")

    # Groups of buckets that still hold more than one component.
    known = bucketed.select("key", "cls").join(labels, F.col("cls") == F.col("id"), "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    spread = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("m")).filter("lo <> hi")
    left = cut(known.join(spread.select("key", "m"), "key").select("m", "cls", "comp").distinct(), "open")
    if left.limit(1).count():
        groups = components(left.select(F.col("m").alias("a"), F.col("cls").alias("b"))).withColumnRenamed("component", "grp")
        members = left.select("cls", "comp").distinct().join(groups, F.col("cls") == F.col("id")).select("cls", "comp", "grp")
        members = cut(members.join(listed.select("cls", "n"), "cls"), "members")
        parts = members.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("runs"))
        totals = parts.groupBy("grp").agg(F.max(F.struct("c", "comp", "runs")).alias("top"), F.sum("c").alias("c"), F.sum("runs").alias("runs"))
        blocks = lambda n, size_, b: F.greatest(F.ceil(n / F.lit(size_)), F.ceil(b * 8 / F.lit(TILE_BYTES))).cast("int")
        totals = totals.select("grp", F.col("top.comp").alias("main"), blocks(F.col("c") - F.col("top.c"), TILE_ROWS, F.col("runs") - F.col("top.runs")).alias("rows"), blocks(F.col("c"), TILE_COLUMNS, F.col("runs")).alias("columns"), (F.col("runs") * 8).alias("bytes"))
        totals = totals.withColumn("rows", F.greatest("rows", F.lit(1)))
        calls = max(1, -(-(totals.agg(F.sum("bytes")).first()[0] or 0) // TILE_BYTES))
        placed = members.join(totals, "grp")
        deal = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        plain = ["grp", "cls", "comp", "rows", "columns"]
        rows_ = placed.filter("comp <> main").select(*plain, F.lit(True).alias("loose"), deal("rows", 1).alias("i"), every("columns").alias("j"))
        columns_ = placed.select(*plain, F.lit(False).alias("loose"), every("rows").alias("i"), deal("columns", 2).alias("j"))
        single = (F.col("rows") == 1) & (F.col("columns") == 1)
        call = F.when(single, F.pmod(F.xxhash64("grp"), F.lit(calls))).otherwise(F.xxhash64("grp", "i", "j"))
        tiles = rows_.unionByName(columns_).withColumn("call", call).drop("rows", "columns", "i", "j").join(listed, "cls")

        def tile(table: pa.Table) -> pa.Table:
            table = table.sort_by([("grp", "ascending"), ("loose", "descending"), ("cls", "ascending")])
            names, comps, groups_, loose = (table[c].to_pylist() for c in ("cls", "comp", "grp", "loose"))
            both = [_numbers(x) for x in zip(table["runs"].to_pylist(), table["counts"].to_pylist())]
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, size)
            found, start = [], 0
            while start < len(names):
                stop = start
                while stop < len(names) and groups_[stop] == groups_[start]:
                    stop += 1
                split = start + sum(loose[start:stop])
                find = _Find(comps[start:stop])
                pairs_ = []
                for i in range(start, split):
                    close = (sigs[split:stop] == sigs[i]).mean(axis=1)
                    pairs_ += [(-close[j], i, j + split) for j in np.flatnonzero(close >= least)]
                for _, i, j in sorted(pairs_):
                    if names[i] != names[j] and find.top(i - start) != find.top(j - start) and probability_jaccard(*both[i], *both[j]) >= threshold:
                        find.join(i - start, j - start)
                        found.append((names[i], names[j]))
                start = stop
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        more = tiles.groupBy("call").applyInArrow(tile, "a long, b long")
        labels = components(links.unionByName(more))
    else:
        labels = labels.select("id", "component")
    named = classes.select("digest", "cls", "first", "copies").join(labels, F.col("cls") == F.col("id"), "left").select("digest", "cls", "first", "copies", F.coalesce("component", "cls").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("first").alias("head"))
    of = named.join(heads, "comp").select("digest", "cls", "head", "copies")
    # a text without copies goes by its row; the copies of a text are dealt into parts, so that one of many is not one task's
    copied = of.filter("copies > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("head").alias("shared"))
    single = of.filter("copies = 1").select(F.col("cls").alias("row"), F.col("head").alias("own"))
    worded = signed.filter("digest is not null").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    found = worded.join(copied, ["digest", "salt"], "left").join(single, "row", "left").select("doc_id", "row", "text_hash", F.coalesce("shared", "own").alias("head"))
    bare = signed.filter("digest is null").select("doc_id", "row", "text_hash", F.struct("doc_id", "row", "text_hash").alias("head"))
    out = found.unionByName(bare)
    return out.select("doc_id", F.col("head.doc_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("kept"), "text_hash")
