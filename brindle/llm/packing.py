"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Tokenising is a map over whole texts. The pieces (a few numbers each) are dealt at random into
groups of bounded size; every group is packed once, and those that are above the bound then are evolved on
several islands, tasks of their own that start from different orders. Crossover injects whole well-filled sequences of one parent into the
other, drops the sequences that hold a duplicate and the worst, lets displaced pieces replace worse ones where they fill
a sequence better, and best-fits the others. After an epoch each island's elite migrates to the next island of its group. The poorly filled sequences
that the groups leave are dissolved and packed again across groups, until one group is left.
A group stops as soon as it reaches the bound ceil(tokens / capacity).

Defined cases: a null or empty text is its end token alone; a document longer than the capacity is
cut into pieces of the capacity, the last may be shorter; repeated rows are packed as often as
they occur; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import random
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, slices, split_words

#: Pieces that one group holds at about this number.
GROUP_PIECES = 4000
#: Text handled at once, in bytes: the more, the fewer times a frequent word is looked up.
SLICE_BYTES = 4 << 20
#: Words of one generation that a worker remembers.
MEMO_WORDS = 200_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long"


# The steps of a tokenizer whose texts fall into words.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and joins nothing across it, nor a letter or digit and the full
    stop or comma behind it, so a text's ids are those of its words between ASCII white space. Ids of
    words are remembered for as long as the worker lives, in two generations of ``MEMO_WORDS``: a
    word that no text has used for a generation is forgotten. Words of nothing but letters go to the
    model at once, as the bytes that its byte-level step would make of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not spec["post_processor"]
        self.folds = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        by_letters = [x["type"] for x in steps] == ["Split", "ByteLevel"] and "[\\p{L}]+" in steps[0]["pattern"]["Regex"] and not steps[1]["add_prefix_space"]
        self.bare = Tokenizer(self.tokenizer.model) if by_letters and self.folds else None
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def run(tokenizer, words: list[str]) -> list[bytes]:
        """Ids of each word, many words as one sequence."""
        found: list[bytes] = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            (whole,) = tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)
            data = array("I", whole.ids).tobytes()
            if None in whole.word_ids:  # special tokens belong to no word
                found += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                continue
            stops = np.cumsum(np.bincount(np.array(whole.word_ids, dtype=np.int64), minlength=len(part)) * 4).tolist()
            found += [data[a:b] for a, b in zip([0, *stops], stops)]
        return found

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [self.bare is not None and t.isalpha() and (t.isascii() or t == t.lower() and unicodedata.is_normalized("NFC", t)) for t in texts]
        out = dict(zip(compress(words, plain), self.run(self.bare, [byte_level(w) for w in compress(words, plain)])))
        other = [not p for p in plain]
        return out | dict(zip(compress(words, other), self.run(self.tokenizer, list(compress(texts, other)))))

    def look_up(self, words: set[bytes]) -> tuple[dict[bytes, bytes], list[bytes]]:
        """The words that are known, and those that are not."""
        recent, older, found, new = self.recent, self.older, {}, []
        for word in words:
            ids = recent.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    new.append(word)
                    continue
                recent[word] = ids
            found[word] = ids
        return found, new

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as the bytes of little-endian unsigned 32-bit numbers."""
        ended = {w: w[:-1] for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalnum()}
        found, new = self.look_up({ended.get(w, w) for w in words} | {b".", b","})
        fresh = self.encode(new)
        self.recent |= fresh
        found |= fresh
        if len(self.recent) > MEMO_WORDS:
            self.older, self.recent = self.recent, {}
        return [found[ended[w]] + found[w[-1:]] if w in ended else found[w] for w in words]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts, likewise; whole texts at once where the tokenizer does not fall into words as described."""
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        codes, offsets, words = split_words(pc.ascii_lower(texts) if self.folds else texts)
        ids = self.ids(words.cast(pa.binary()).to_pylist())
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.cumsum(size)
        tokens = flat[np.repeat(begins[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        return [tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@cache
def _byte_table() -> dict[int, str]:
    """The characters that byte-level models write bytes as: printable ones themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def byte_level(word: bytes) -> str:
    return word.decode("latin-1").translate(_byte_table())


@cache
def word_ids(path: str) -> WordIds:
    """One for each worker and vocabulary file."""
    return WordIds(path)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a random part number of every piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                rows = []
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.texts(batch["text"])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        crc = zlib.crc32(part)
                        rows.append((doc_id, piece, at // 4, len(part) // 4, crc, zlib.crc32(f"{doc_id} {piece}".encode(), crc)))
                columns = list(zip(*rows)) if rows else [()] * 6
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECE)


# The algorithm on one group: a solution is a list of bins, a bin a list of places in ``sizes``.


def filled(items: list[int], sizes: list[int]) -> int:
    return sum(map(sizes.__getitem__, items))


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Put each item, the largest first, where the least room is left over."""
    room = sorted((capacity - filled(b, sizes), k) for k, b in enumerate(bins))
    for item in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[item], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(item)
        else:
            left, k = capacity, len(bins)
            bins.append([item])
        bisect.insort(room, (left - sizes[item], k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones."""
    return len(bins), -sum((filled(b, sizes) / capacity) ** 2 for b in bins)


#: Items of a bin of which pairs are tried when better ones are looked for.
TRIED = 24


def fill_better(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Change none, one or two items of a bin for one or two loose ones that fill it better, as long as some do; what is loose then."""
    order = sorted(loose, key=lambda i: (sizes[i], i))
    values = [sizes[i] for i in order]
    for k, own in enumerate(bins):
        room = capacity - filled(own, sizes)
        while room and order:
            best: tuple[int, tuple, tuple] = (0, (), ())
            pairs = [(x, y) for n, x in enumerate(own[:TRIED]) for y in own[:n]]
            # of equal sizes, the first will do
            outs = {filled(out, sizes): out for out in [*reversed(pairs), *((i,) for i in own), ()]}
            for size, out in outs.items():
                high = bisect.bisect_right(values, size + room) - 1
                if high >= 0 and values[high] - size > best[0]:
                    best = (values[high] - size, out, (high,))
                low = 0
                while low < high and best[0] < room:  # two loose items, from both ends
                    both = values[low] + values[high]
                    if both > size + room:
                        high -= 1
                        continue
                    if both - size > best[0]:
                        best = (both - size, out, (low, high))
                    low += 1
                if best[0] == room:
                    break
            gain, out, into = best
            if not gain:
                break
            own[:] = [i for i in own if i not in out] + [order[x] for x in into]
            for x in reversed(into):
                del order[x], values[x]
            for i in out:
                at = bisect.bisect_left(values, sizes[i])
                values.insert(at, sizes[i])
                order.insert(at, i)
            room -= gain
    return order


def crossover(into: list[list[int]], of: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject well-filled bins of one parent; bins that hold a duplicate go, and so do the worst of all.

    Their other items first replace worse ones of the bins that stay (``fill_better``), then best fit places what is loose.
    """
    fill = lambda b: filled(b, sizes)
    ranked = sorted(of, key=fill, reverse=True)
    inject = [list(b) for b in ranked[: max(1, len(ranked) * 3 // 4)] if rng.random() < 0.5]
    taken = {i for b in inject for i in b}
    loose = [i for b in into if not taken.isdisjoint(b) for i in b if i not in taken]
    bins = inject + [list(b) for b in into if taken.isdisjoint(b)]
    worst = set(sorted(range(len(bins)), key=lambda k: fill(bins[k]) + rng.random())[: max(2, len(bins) // 12)])
    loose += [i for k in worst for i in bins[k]]
    bins = [b for k, b in enumerate(bins) if k not in worst]
    return best_fit(bins, fill_better(bins, loose, sizes, capacity), sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int = 8, generations: int = 40) -> list[list[int]]:
    """One island's epoch: the best packing that it finds."""
    bound = -(-sum(sizes) // capacity)
    scored = lambda s: (*fitness(s, sizes, capacity), s)
    solutions = [scored(s) for s in (*elites, best_fit([], list(range(len(sizes))), sizes, capacity))]
    rng = random.Random(seed)
    order = lambda s: s[:2]
    while len(solutions) < population and min(s[0] for s in solutions) > bound:
        some = [i for i in range(len(sizes)) if rng.random() < 0.3]
        first = best_fit([], some, sizes, capacity)
        chosen = set(some)
        solutions.append(scored(best_fit(first, [i for i in range(len(sizes)) if i not in chosen], sizes, capacity)))
    for _ in range(generations):
        solutions.sort(key=order)
        if solutions[0][0] <= bound or len(solutions) < 2:
            break
        a, b = rng.sample(solutions, 2)
        child = scored(crossover(a[2], b[2], sizes, capacity, rng))
        if order(child) < order(solutions[-1]):
            solutions[-1] = child
    return min(solutions, key=order)[2]


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("part", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])


def _encode(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _decode(data: bytes) -> list[list[int]]:
    where = np.frombuffer(data, dtype=np.int32)
    bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1)] if len(where) else []
    for i, k in enumerate(where):
        bins[k].append(i)
    return [b for b in bins if b]


def _epoch(pieces: DataFrame, elites: DataFrame | None, capacity: int, islands: int, seed: int) -> DataFrame:
    """(grp, island, n_bins, bound, bins): the elite of every island after an epoch."""
    schema = "grp long, island int, n_bins int, bound int, score double, bins binary"

    def island(key: tuple, table: pa.Table, sent: list[bytes]) -> pa.Table:
        sizes = _ordered(table)["length"].to_pylist()
        best = evolve(sizes, capacity, seed * 1000003 + key[0].as_py() * 31 + key[1].as_py(), [_decode(x) for x in sent])
        n, score = fitness(best, sizes, capacity)
        row = {"grp": [key[0].as_py()], "island": [key[1].as_py()], "n_bins": [n], "bound": [-(-sum(sizes) // capacity)], "score": [score], "bins": [_encode(best, len(sizes))]}
        return pa.table(row, schema=pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int32()), ("bound", pa.int32()), ("score", pa.float64()), ("bins", pa.binary())]))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return island(key, table, [])

    def later(key: tuple, table: pa.Table, sent: pa.Table) -> pa.Table:
        return island(key, table, sent["bins"].to_pylist())

    copies = pieces.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands if elites is not None else 1)))))
    if elites is None:  # one island tells which groups best fit leaves above the bound
        return copies.groupBy("grp", "island").applyInArrow(first, schema)
    migrants = elites.select("grp", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).alias("island"), "bins")
    copies = copies.join(elites.filter("n_bins > bound").select("grp").distinct(), "grp", "left_semi")
    migrants = migrants.join(elites.filter("n_bins > bound").select("grp").distinct(), "grp", "left_semi")
    return copies.groupBy("grp", "island").cogroup(migrants.groupBy("grp", "island")).applyInArrow(later, schema)


def _placing(level: int):
    """Writes a group's chosen packing down, a row a piece."""

    def place(key: tuple, table: pa.Table, chosen: pa.Table) -> pa.Table:
        table = _ordered(table)
        sizes = table["length"].to_pylist()
        sequence, offset, fill = ([0] * len(sizes) for _ in range(3))
        for k, b in enumerate(_decode(chosen["bins"][0].as_py())):
            at, total = 0, sum(sizes[i] for i in b)
            for i in b:
                sequence[i], offset[i], fill[i] = (level << 58) + (key[0].as_py() << 22) + k, at, total
                at += sizes[i]
        table = table.select([x.split()[0] for x in _PIECE.split(", ")])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return place


def pack(pieces: DataFrame, capacity: int = 4096, islands: int = 3, epochs: int = 3, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece (doc_id, piece, start, length, ids_crc32, part) a sequence_id and an offset."""
    out_schema = f"{_PIECE}, sequence_id long, offset long, fill long"
    done, left, level = None, cut(pieces, "pieces"), 0
    count = left.count()
    while True:
        groups = max(1, -(-count // group_pieces))
        items = left.withColumn("grp", F.pmod(F.xxhash64("part", "doc_id", "piece"), F.lit(groups)))
        best = cut(_epoch(items, None, capacity, islands, level), "elites")
        for epoch in range(1, epochs):
            if not best.filter("n_bins > bound").limit(1).count():
                break
            best = cut(best.unionByName(_epoch(items, best, capacity, islands, level * 100 + epoch)), "elites")
        elite = best.groupBy("grp").agg(F.min_by("bins", F.struct("n_bins", "score", "island")).alias("bins"))

        placed = cut(items.groupBy("grp").cogroup(elite.groupBy("grp")).applyInArrow(_placing(level), out_schema), "placed")
        if groups == 1:
            break
        poor = F.col("fill") < F.lit(0.99 * capacity)
        left, again = placed.filter(poor).select(*pieces.columns), placed.filter(poor).count()
        if again >= count:  # nothing came out full; packing once more changes nothing
            break
        settled = placed.filter(~poor)
        done = settled if done is None else done.unionByName(settled)
        count, level = again, level + 1
        if not count:
            return done.drop("fill", "part")
    done = placed if done is None else done.unionByName(placed)
    return done.drop("fill", "part")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise every document, end it with ``end_id``, cut what is longer than ``capacity`` and pack.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(tokenised_pieces(docs, tokenizer_path, capacity, end_id), capacity)
