"""Cross-tokenizer alignment against an interval-by-interval version with the libraries' own encoders."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import alignment
from tests.llm.data import awkward, documents, empty, sentence

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = [
    None, "", " ", "  two  spaces ", "a\n b", "a\n\n  b\tc", "▁", "x ▁y", "\x00\x01 z", "日本語 😀é", "don't stop. I'll 3.14 ½ ²", "\xa0nbsp \xa0x", "<|endoftext|> <s> </s>", "tab\t next\r\nline", "x" * 3000, " lead", "trail ",
    "é  em 　wide", "﻿bom", "a  \n  b", "\x1c\x1d \x1e", "ﬁ ǆ Å",
]


def byte_level():
    """The printable character of each byte, counted upwards from U+0100 for those that are not printable."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(n)] = b
            n += 1
    return out


def brute(texts):
    tokenizer, model, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    tokenizer.encode_special_tokens = True
    links, found = Counter(), []
    for text in texts:
        a = [(i, bytes(table[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in (model.encode(text) if text else []) for p in [model.id_to_piece(i)]]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b) if text):
            a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, _, e in own if low < e <= high) for own in spans) for low, high in zip([0, *common], common)]
        own = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        links.update(own)
        found.append((len(a), len(b), len(groups), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, j), n in links.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, g, len(own), sum(links[x] == best[x[1]] for x in own), sum(links[x] for x in own), h) for n_a, n_b, g, own, h in found]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts_of(seed, n):
    rng = random.Random(seed)
    alphabet = ["a", "b", "th", "ing", " ", " ", "\n", "é", "日", "😀", "1", "23", "'s", "\t", "▁", " ", "."]
    return HARD + [sentence(rng, rng.randrange(1, 30)) for _ in range(n // 3)] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_equals_intervals(spark):
    texts = texts_of(3, 150)
    want = sorted(((i, *w) for i, w in enumerate(brute(texts))), key=repr)
    assert rows(alignment.align(documents(spark, list(enumerate(texts))), A, B)) == want


def test_small_blocks_and_few_common_pairs(spark, monkeypatch):
    """The same with pieces of long documents, and with most pairs joined rather than broadcast."""
    for name, value in (("BLOCK", 7), ("SWEPT", 40), ("COMMON", 5), ("MEMO", 10)):
        monkeypatch.setattr(alignment, name, value)
    texts = texts_of(4, 60) + [sentence(random.Random(9), 400)]
    want = sorted(((i, *w) for i, w in enumerate(brute(texts))), key=repr)
    assert rows(alignment.align(documents(spark, list(enumerate(texts))), A, B)) == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = [(i, t) for i, t in pairs if len(t or "") < 5000]
    got = alignment.align(docs, A, B)
    assert got.columns == list(COLUMNS) and got.count() == len(pairs)
    assert {r["n_a"] for r in got.filter("doc_id in (1, 2)").collect()} == {0}
    assert rows(alignment.align(docs.filter("coalesce(length(text), 0) < 5000"), A, B)) == sorted(((i, *w) for (i, _), w in zip(short, brute([t for _, t in short]))), key=repr)
    long = got.filter("doc_id = 8 and n_a > 1000").collect()
    assert len(long) == 1 and long[0]["n_links"] == long[0]["n_a"] + long[0]["n_b"] - long[0]["n_groups"]
    assert alignment.align(empty(spark), A, B).collect() == []


@pytest.mark.parametrize("n", [0, 1])
def test_event_rows_open_every_document(spark, n):
    docs = documents(spark, [(1, "a b")] * n + [(2, None)])
    sides = [r["side"] for r in alignment.events(docs, A, B).collect()]
    assert sides.count(alignment.OPENING) == n + 1 and len(sides) == n + 1 + 2 * n
