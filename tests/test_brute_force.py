"""Queries that SQL can't express, against plain Python on the smallest tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from brindle.operators import chunking, scan, tables
from brindle.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.connect().execute(sql.replace("@", SF)).fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(rows("SELECT doc_id, text FROM '@/documents.parquet'"))


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def spans(text, patterns):
    out = []
    for label, p in patterns.items():
        for m in re.finditer(p, text, re.ASCII):
            if label == "CREDIT_CARD" and not luhn(re.sub(r"\D", "", m[0])):
                continue
            a, b = m.span(1 if m.re.groups else 0)
            out.append((a, b, label))
    return sorted(out)


def masked(text, patterns):
    out, at = [], 0
    for a, b, label in spans(text, patterns):
        if a >= at:
            out += [text[at:a], f"[{label}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_personal_data(spark, docs):
    counts = {r["doc_id"]: r for r in QUERIES["pii_counts"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in QUERIES["redact_spans"](spark, SF).collect()}
    for i, t in docs.items():
        found = Counter(label for _, _, label in spans(t or "", scan.PII))
        assert all(counts[i][label.lower()] == found[label] for label in scan.PII)
        assert texts[i] == masked(t or "", scan.PII)


def test_secrets(spark, docs):
    from brindle.plans.texts import _PLANTED

    for r in QUERIES["redact_secrets"](spark, SF).collect():
        assert r["text"] == masked((docs[r["doc_id"]] or "") + _PLANTED[r["doc_id"] % 10], scan.SECRETS)


def test_stream_equals_batch(spark):
    whole = defaultdict(str)
    for conv, _, text in sorted(rows("SELECT conv_id, turn, text FROM '@/conversations.parquet'"), key=lambda r: r[:2]):
        whole[conv] += (text or "") + "\n"
    parts = defaultdict(list)
    for r in QUERIES["stream_redact_equiv"](spark, SF).collect():
        parts[r["message_id"]].append((r["sequence_no"], r["text"]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()} == {k: masked(t, scan.PII) for k, t in whole.items()}


def test_sentence_segments(spark):
    whole = defaultdict(str)
    for conv, _, text in sorted(rows("SELECT conv_id, turn, text FROM '@/conversations.parquet'"), key=lambda r: r[:2]):
        whole[conv] += text or ""
    parts, sizes = defaultdict(list), defaultdict(list)
    for r in QUERIES["sentence_segments"](spark, SF).collect():
        parts[r["message_id"]].append((r["sequence_no"], r["text"]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()} == {k: t for k, t in whole.items() if t}
    for v in parts.values():
        for _, t in sorted(v)[:-1]:
            assert len(t) > 300 and t[-1] in ".!?\n"


def test_character_runs(spark, docs):
    for r in QUERIES["fold_character_runs"](spark, SF).collect():
        t = docs[r["doc_id"]]
        assert r["text"] == (t if t is None else re.sub(r"([^ \t\r\n\f\v])\1{2,}", r"\1\1\1", t))


def tokens_of(text):
    return math.ceil(len(text) / 4)


def plain_recursive(text, low, high):
    """Separators one after the other, pieces walked character by character."""

    def cut(t, seps):
        if tokens_of(t) <= high:
            return [t]
        if not seps:
            out, piece = [], ""
            for c in t:
                if len(piece) == 4 * high:
                    out, piece = [*out, piece], ""
                piece += c
            return [*out, piece]
        out, rest = [], t
        while rest:
            head, sep, rest = rest.partition(seps[0])
            out += cut(head + sep, seps[1:]) if (head + sep).strip() else []
        return out

    return greedy([p for p in cut(text, ["\n\n", "\n", ". "]) if p.strip()], low, high, "")


def plain_classic(text, low, high, repeat=False):
    """One character at a time into windows, whose budgets the header reduces."""
    if tokens_of(text) <= high:
        return [text] if text.strip() else []
    ends = [i for i, c in enumerate(text) if c == "\n"]
    header = text[: ends[2] + 1] if len(ends) >= 3 else ""
    if tokens_of(header) >= high:
        header = ""
    left = high - tokens_of(header)
    repeat = repeat and left >= 0.25 * high
    out, piece = [], ""
    for c in text[len(header) :]:
        if len(piece) == 4 * (left if repeat or not out else high):
            out, piece = [*out, piece], ""
        piece += c
    out = [*out, piece] if piece or not out else out
    return [header + p if repeat or not i else p for i, p in enumerate(out)]


def plain_semantic(text, low, high):
    """Sentences by looking at each end, cosines of word counts in pure Python, the percentile by its definition."""
    sentences, begin = [], 0
    for m in re.finditer(r"\s+", text):
        if m.start() and text[m.start() - 1] in ".!?":
            sentences.append(text[begin : m.start()])
            begin = m.end()
    sentences = [s.strip() for s in [*sentences, text[begin:]] if s.strip()]
    if len(sentences) < 2:
        return plain_recursive(text, low, high)

    def counts(s):
        out = defaultdict(float)
        for w in re.findall(r"\w+", s.lower()):
            out[zlib.crc32(w.encode()) % 64] += 1
        return out

    def cosine(a, b):
        na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
        return sum(v * b.get(k, 0) for k, v in a.items()) / na / nb if na and nb else 0.0

    steps = [1 - cosine(counts(a), counts(b)) for a, b in zip(sentences, sentences[1:])]
    order = sorted(steps)
    place = 0.95 * (len(order) - 1)
    limit = order[int(place)] + (place - int(place)) * (order[min(int(place) + 1, len(order) - 1)] - order[int(place)])
    groups = [[sentences[0]]]
    for s, step in zip(sentences[1:], steps):
        if step >= limit - 1e-12 and max(steps) - min(steps) > 1e-12:
            groups.append([])
        groups[-1].append(s)
    pieces = [w for g in groups for t in [" ".join(g)] for w in ([t] if tokens_of(t) <= high else [t[i : i + 4 * high] for i in range(0, len(t), 4 * high)]) if w.strip()]
    return greedy(pieces, low, high, " ")


PLAIN = {"recursive": plain_recursive, "classic": plain_classic, "semantic": plain_semantic}


@pytest.mark.parametrize("name", list(PLAIN))
def test_chunks(spark, docs, name):
    got = defaultdict(list)
    for r in QUERIES[f"chunk_{name}"](spark, SF).collect():
        got[r["doc_id"]].append((r["part"], r["chunk"], r["tokens"]))
    for i, t in docs.items():
        assert sorted(got[i]) == [(k, c, tokens_of(c)) for k, c in enumerate(PLAIN[name](t or "", 50, 200))], i


def test_chunks_of_odd_texts():
    rng = np.random.default_rng(7)
    for _ in range(400):
        text = "".join(rng.choice(list("ab. \n\n!?") + ["word ", "end. ", "\n\n", "long" * 9], rng.integers(0, 80)))
        low, high = sorted(rng.integers(1, 30, 2).tolist())
        for name, plain in PLAIN.items():
            assert chunking.CHUNKERS[name](text, low, high) == plain(text, low, high), (name, text, low, high)
        assert chunking.classic(text, low, high, repeat_header=True) == plain_classic(text, low, high, True), (text, high)


def greedy(pieces, low, high, joiner):
    """What merging must give, by the plainest way."""
    out, i = [], 0
    tokens = lambda p: math.ceil(len(p) / 4)
    while i < len(pieces):
        text, i = pieces[i], i + 1
        while tokens(text) < low and i < len(pieces) and tokens(text + joiner + pieces[i]) <= high:
            text, i = text + joiner + pieces[i], i + 1
        out.append(text)
    return out


def test_merging_small_pieces():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pieces = ["x" * int(n) for n in rng.integers(1, 120, rng.integers(0, 30))]
        low, high = sorted(rng.integers(1, 60, 2).tolist())
        for joiner in ("", " "):
            assert chunking.merge_small(pieces, low, high, joiner) == greedy(pieces, low, high, joiner)


def test_markdown_chunks(spark, docs):
    got = defaultdict(list)
    for r in QUERIES["chunk_markdown"](spark, SF).collect():
        got[r["doc_id"]].append((r["part"], r["chunk"]))
    for i, t in docs.items():
        sections = [s for s in re.split(r"(?m)^(?=#{1,6}\s)", t or "") if s.strip(" ")]
        want = [s[a : a + 800] for s in sections for a in range(0, len(s), 800)]
        assert [c for _, c in sorted(got[i])] == [w for w in want if w.strip(" ")]


def test_windows_of_a_tokenizer(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    count = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole, parts = chunking.tokenizer_windows, defaultdict(list)
    frame = spark.createDataFrame([(i, t) for i, t in list(docs.items())[:60]] + [(10**6, "q" * 5000)], "doc_id long, text string")
    for r in whole(frame, public_tokenizers.path("byte_bpe_50k.json"), 16, 32).collect():
        parts[r["doc_id"]].append((r["part"], r["chunk"], r["tokens"]))
    for i, t in [*list(docs.items())[:60], (10**6, "q" * 5000)]:
        pieces = sorted(parts[i])
        assert "".join(c for _, c, _ in pieces) == (t or "")
        assert all(n <= (16 if k == 0 else 32) and len(c) <= n * 16 for k, c, n in pieces)
    assert sum(n for _, _, n in parts[10**6]) >= 5000 / 16 and count.get_vocab_size() > 0


def test_record_chunks_keep_the_words(spark, docs):
    parts = defaultdict(list)
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "intro\n\n# One\nalpha beta\n\ngamma\n## Two\n" + "word " * 400)], "doc_id long, text string")
    for r in chunking.record_chunks(frame).withColumn("n", F.length("chunk")).collect():
        parts[r["doc_id"]].append((r["part"], r["chunk"], r["n"]))
    pieces = [c for _, c, _ in sorted(parts[1])]
    assert all(n <= 800 for _, _, n in parts[1]) and len(pieces) >= 4
    assert "\n".join(pieces).split() == ["intro", "One", "alpha", "beta", "gamma", "Two", *["word"] * 400]


def test_rst_sections(spark):
    text = "before\nTitle\n=====\nline one\n\nSub part\n--------\n:ref:`x` text\n---\nend"
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["part"], r["header"], r["text"]) for r in chunking.rst_sections(frame).orderBy("doc_id", "part").collect()]
    assert got == [(1, 0, None, "before"), (1, 1, "Title", "line one\n"), (1, 2, "Sub part", "`x` text\n---\nend")]
    assert QUERIES["rst_sections"](spark, SF).count() > 0


def test_overlapping_chunks(spark, docs):
    for r in QUERIES["overlap_join"](spark, SF).collect():
        text = docs[r["doc_id"]]
        out, before = [], ""
        for a in range(0, max(len(text) - 1, 0) + 1, 400):
            piece = text[a : a + 440]
            fresh = piece[tables.overlap(before, piece) :]
            before = fresh or before
            out += [fresh] * bool(fresh)
        assert r["page"] == "\n\n".join(out)


def test_tableize(spark):
    by_order = defaultdict(list)
    for order, line, part, flag, quantity in rows("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity FROM '@/lineitem.parquet'"):
        by_order[order].append((line, part, f"item {flag} {int(quantity)} {line}"))
    for r in QUERIES["tableize_runs"](spark, SF).collect():
        lines = [x[2] for x in sorted(by_order[r["doc_id"]])]
        if len(lines) < 3:
            assert r["text"] == "\n".join(lines)
        else:
            cells = [(" ".join(x.split()[:2]), *x.split()[2:]) for x in lines]
            assert r["text"] == "\n|   |   |   |\n| --- | --- | --- |\n" + "\n".join("| " + " | ".join(c) + " |" for c in cells) + "\n"


def test_html_to_markdown(spark):
    from brindle.functions.text import html_to_markdown
    from pyspark.sql import functions as F

    html = "<html><title>t</title><style>a{}</style><h2>Head</h2><p>one <b>two</b> <em>three</em></p><ul><li>x</li><li>y</li></ul><a href='/u'>link</a><img src='data:abc'><script>1</script> &amp; end</html>"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_markdown(F.col("h"))).first()[0]
    assert got == "## Head\n\none **two** *three*\n\n- x\n- y\n\n[link](/u) & end"
    pages = rows("SELECT page_id, html FROM '@/pages.parquet'")
    for r in QUERIES["html_to_markdown"](spark, SF).collect():
        assert not re.search(r"(?i)<(?:script|style|p|div|h[1-6])\b", r["markdown"])
    assert len(pages) == QUERIES["html_to_markdown"](spark, SF).count()


def test_topic_clusters(spark):
    table = sorted(rows("SELECT vec_id, embedding FROM '@/embeddings.parquet'"))
    x = np.array([v for _, v in table], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(len(x), 12, max(2, round(math.sqrt(len(x) / 2))))
    seeds = [0]
    while len(seeds) < k:
        seeds.append(int(np.argmin(np.round((x @ x[seeds].T).max(axis=1), 12))))
    centres = x[seeds]
    for _ in range(50):
        label = np.round(x @ centres.T, 9).argmax(axis=1)
        after = np.stack([(m := x[label == c].mean(axis=0)) / np.linalg.norm(m) if (label == c).any() else centres[c] for c in range(k)])
        done, centres = np.abs(after - centres).max() < 1e-9, after
        if done:
            break
    label = np.round(x @ centres.T, 9).argmax(axis=1)
    got = {r["vec_id"]: r["cluster"] for r in QUERIES["topic_clusters"](spark, SF).collect()}
    assert [got[i] for i, _ in table] == label.tolist()


def test_pagerank_with_damped_hubs(spark):
    edges = rows("SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM '@/lineitem.parquet'")
    names = sorted({n for e in edges for n in e})
    place = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b in edges:
        w[place[a], place[b]] = w[place[b], place[a]] = 1.0
    degree = w.sum(axis=1)
    seed = np.zeros(len(names))
    seed[place["s1"]], seed[place["s2"]] = 2 / 3, 1 / 3
    rank = seed
    for _ in range(100):
        rank = 0.15 * seed + 0.85 * rank @ (w / degree[:, None])
    got = {r["node"]: r["score"] for r in QUERIES["ppr_scores"](spark, SF).collect()}
    assert np.allclose([got[n] for n in names], rank / np.log(2 + degree), atol=2e-3)


def test_snapshot_id_does_not_depend_on_order(spark):
    from brindle.operators.topics import snapshot_id

    make = lambda r: snapshot_id(spark.createDataFrame(r, "cluster int, members array<int>, centroid array<double>")).first()[0]
    one = [(0, [2, 1], [0.6, 0.8]), (1, [3], [1.0, 0.0])]
    assert make(one) == make([(1, [3], [1.0, 1e-14]), (0, [1, 2], [0.6, 0.8])]) != make([(0, [1], [0.6, 0.8]), (1, [2, 3], [1.0, 0.0])])
    assert len(QUERIES["topic_snapshot_id"](spark, SF).first()[0]) == 64


def test_pagerank_of_the_tables_is_the_limit(spark):
    edges = rows("SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM '@/lineitem.parquet'")
    names = sorted({n for e in edges for n in e})
    place = {n: i for i, n in enumerate(names)}
    a, b = np.array([(place[s], place[d]) for s, d in edges]).T
    ends, other = np.append(a, b), np.append(b, a)
    degree = np.bincount(ends, minlength=len(names))
    seed = np.zeros(len(names))
    seed[place["s1"]], seed[place["s2"]] = 2 / 3, 1 / 3
    rank = seed
    for _ in range(250):
        rank = 0.15 * seed + 0.85 * np.bincount(other, (rank / degree)[ends], minlength=len(names))
    got = {r["node"]: r["score"] for r in QUERIES["ppr_scores"](spark, SF).collect()}
    assert got.keys() == place.keys() and np.abs(np.array([got[n] for n in names]) * np.log(2 + degree) - rank).sum() < 1e-6
