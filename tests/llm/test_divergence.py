"""Source divergence against the definition in whole numbers, for awkward rows and several partitions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from brindle.llm import divergence
from tests.llm.data import awkward, empty, sentence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    """rows: (text, lang, source)."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = terms_of(text)
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in held[lang].items() if n >= 3]
        sources = [s for k, s in groups if k == lang]
        everything = Counter()
        for s in sources:
            everything.update(count[lang, s])

        def p_of(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: p_of(count[lang, s]) for s in sources}, p_of(everything)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][w], p[t][w]) for w in kept), t) for t in sources if t != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], q[w]), w) for w in kept if count[lang, s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:200]
            out += [(lang, s, part, item, v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, lang, source, "x", 7) for i, (t, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, count int").repartition(parts)


def test_equals_the_definition(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "s_only" if lang == "de" else "s4"])
        words = ["The", "the", "été", "ÉTÉ", "日本", "don't", "x9y", *sentence(rng, rng.randrange(0, 30)).split()]
        rows.append((" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))), lang, source))
    rows += [(None, "fr", "lonely"), ("rare words here", "it", "a"), ("other ones", "it", "b"), (None, None, None)]
    assert rows_of(divergence.audit(frame(spark, rows))) == brute(rows)


def test_more_than_200_terms_and_ties(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    rows = [(" ".join(names), "en", "big")] * 3 + [("zz yy " * 50, "en", "small")] * 3
    got = rows_of(divergence.audit(frame(spark, rows)))
    assert got == brute(rows) and sum(r[2] == "term" and r[1] == "big" for r in got) == 200


def test_blocks_that_are_sent_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COMBINED_ROWS", 20)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 3)
    rng = random.Random(2)
    rows = [(sentence(rng, 30), "en", f"s{rng.randrange(4)}") for _ in range(60)]
    assert rows_of(divergence.audit(frame(spark, rows))) == brute(rows)
    batch = frame(spark, rows, 1).select("doc_id", "text", "lang", "source").toArrow().combine_chunks().to_batches()[0]
    sent = list(divergence._count_terms(iter([batch.slice(k, 6) for k in range(0, 60, 6)])))
    total = Counter(w for t, _, _ in rows for w in terms_of(t))
    assert sum(b.num_rows for b in sent) > 100 and sum(sum(b["count"].to_pylist()) for b in sent) == sum(total.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert rows_of(divergence.audit(docs)) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert divergence.audit(empty(spark)).collect() == []
    nulls = docs.filter("text is null")
    assert rows_of(divergence.audit(nulls)) == []
