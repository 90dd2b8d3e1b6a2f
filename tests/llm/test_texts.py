from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import language, lm_score, pii, substring
from brindle.llm.common import rolling
from tests.llm.data import awkward, documents, empty, sentence


def substring_brute(rows, window=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(key, (i, s))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_equals_brute_force(spark):
    rng = random.Random(1)
    passages = [sentence(rng, n) for n in (19, 20, 21, 55, 80)]
    rows = []
    for i in range(80):
        parts = [rng.choice([sentence(rng, rng.randrange(0, 30)), rng.choice(passages), "a b " * rng.randrange(0, 30)]) for _ in range(4)]
        rows.append((i, " ".join(parts)))
    rows += [(80, None), (81, ""), (82, "x " * 200), (83, "\xa0 ".join("abcdefghijklmnopqrstuvwxyz"))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(documents(spark, rows), shard_bytes=2000, bucket_keys=100).collect()}
    assert got == substring_brute(rows)


def test_substring_carries_columns(spark):
    row = substring.dedup_substrings(documents(spark, [(1, "a  b\n")]), with_text=True, keep=("lang", "shard", "n_chars")).first()
    assert (row["kept"], row["lang"], row["shard"], row["n_chars"]) == ("a  b\n", "en", 3, 5)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_equal_brute_force(spark, order):
    rng = random.Random(2)
    base = sentence(rng, 300).split()
    rows = [(i, sentence(rng, rng.randrange(0, 60)) + " " + " ".join(base[(k := rng.randrange(250)) : k + rng.randrange(50)])) for i in range(60)] + [(99, None)]
    counts = Counter(tuple(w[i : i + n]) for _, t in rows for w in [(t or "").split()] for n in range(1, order + 1) for i in range(len(w) - n + 1))
    n_all = sum(c for g, c in counts.items() if len(g) == 1)

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / n_all
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= 2 else 0.4 * score(gram[1:])

    for run in (lambda d: lm_score.lm_scores(d, order, shard_bytes=1000), lambda d: lm_score.lm_scores_by_rows(d, order)):
        got = {r["doc_id"]: r for r in run(documents(spark, rows)).collect()}
        for i, t in rows:
            w = (t or "").split()
            s = sum(math.log10(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
            assert got[i]["n_words"] == len(w) and abs(got[i]["log10_score"] - s) < 1e-6
            assert got[i]["mean_log10"] is None if not w else abs(got[i]["mean_log10"] - s / len(w)) < 1e-6


def spread(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_held_out_accuracy(spark):
    docs = spread(spark)
    rows = language.predict(docs, language.fit(docs), ("doc_id", "lang", "text")).withColumn("held", language.held_out()).collect()
    held = [r for r in rows if r["held"] and r["lang"] is not None and len(r["text"] or "") > 40]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    clean = [r for r in rows if r["text"] and len(r["text"].split()) > 20]
    assert sum(r["rejected"] for r in clean) / len(clean) < 0.01


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spread(spark)
    model = language.fit(docs)
    rng = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x4F00)))]
    strange = [" ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(40)) for a in alphabets for _ in range(50)]
    got = {r["doc_id"]: r["rejected"] for r in language.predict(documents(spark, list(enumerate(strange))), model).collect()}
    for a in range(len(alphabets)):
        assert sum(got[50 * a + i] for i in range(50)) >= 48
    held = language.predict(docs.filter(language.held_out()), model, ("lang", "text")).collect()
    clean = [r["rejected"] for r in held if r["text"] and r["lang"] and len(r["text"].split()) > 20]
    assert sum(clean) / len(clean) < 0.02


def test_language_features_and_logits_the_plain_way():
    rng = np.random.default_rng(5)
    texts = ["Das ist ein Test, ja.", "été à la côte", "a", "", None, "x" * 300 + " y", "das das das"]
    model = language.LanguageModel(["a", "b", "c"], rng.normal(size=(512, 3)), rng.normal(size=3), 1.5, 0.4)
    got, logits = language._bags(pa.array(texts, pa.string()), 512), model.logits(pa.array(texts, pa.string()))
    for text, bag, found in zip(texts, got, logits):
        want = np.zeros(512)
        for word in (text or "").split():
            data = np.array([language.BEGIN, *word.encode(), language.END])
            for n in language.ORDERS:
                for i in range(len(data) - n + 1):
                    want[int(rolling(language._BYTE[data[i : i + n]], n)[0] % np.uint64(512))] += 1
        assert bag.tolist() == want.tolist()
        assert np.allclose(found, want @ model.table / max(want.sum(), 1) + model.bias)
    best, p = model.predict(pa.array(texts[:1]))
    e = np.exp(logits[0] / 1.5)
    assert best[0] == logits[0].argmax() and np.isclose(p[0], (e / e.sum()).max())


def test_language_calibration():
    """The threshold is a quantile of scores of rows that the scoring model has not seen: nearly all such rows pass it."""
    rng = np.random.default_rng(6)
    bags = rng.poisson(1.0, (400, 64)).astype(np.float32)
    langs = ["x" if i % 2 else "y" for i in range(400)]
    bags[::2, :8] += 6
    bags /= bags.sum(axis=1, keepdims=True)
    model = language.train(bags[:300], langs[:300])
    p = language.softmax((bags[300:] @ model.table + model.bias) / model.temperature)
    assert (np.array(model.labels)[p.argmax(axis=1)] == np.array(langs[300:])).mean() > 0.97
    assert (p.max(axis=1) >= model.threshold).mean() > 0.95 and 0.5 <= model.threshold < 1 and 1 <= model.temperature <= 20
    assert language.train(bags[:10], langs[:10]).threshold == 0.0  # too few to calibrate: nothing is rejected


def test_language_awkward(spark):
    got = language.predict(awkward(spark), None).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and all(r["rejected"] for r in got)
    model = language.fit(awkward(spark))
    by_id = {r["doc_id"]: r for r in language.predict(awkward(spark), model).collect()}
    assert by_id[1]["lang_pred"] == "und" and by_id[1]["score"] == 0.0 and by_id[5]["lang_pred"] == "en"
    kept = language.predict(awkward(spark), model, ("score", "text", "_text"))  # a kept column that is named like a result is left out
    assert kept.columns == ["doc_id", "text", "_text", "lang_pred", "score", "rejected"] and kept.count() == 13
    assert language.predict(empty(spark), language.fit(empty(spark))).collect() == []


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return out


PII_TEXTS = [
    None, "", "a@b.co, x.y+z@host-1.example.org.", "a@b@c.de..e@f.g", "ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 0010.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 4111 1111 1111 1111", "+49 (30) 123-4567, +1 2, +123456789012345678",
    "😀 é a@b.co 😀 +4930123456", "@" * 50, "1" * 300, "9.9.9.9@x.y", "write to john (at) mail.com please", "call me: 212-555-0188", "order no. 212-555-0188 shipped", "a%@-.-" * 20,
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_pii_base_spans_equal_the_patterns(spark, model):
    rng = random.Random(3)
    texts = PII_TEXTS + ["".join(rng.choice("a1.@+- 4()") for _ in range(rng.randrange(80))) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.find(documents(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        found = list(filter(None, got[i]["spans"].split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found) and got[i]["n_spans"] == len(found)


def test_pii_method_adds_and_rejects(spark, model):
    got = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, [(1, "write to john (at) mail.com please"), (2, "call me: 212-555-0188 now"), (3, "order no. 212-555-0188 shipped")]), model).collect()}
    assert "email:" in got[1] and "phone:" in got[2] and got[3] == ""


def test_pii_held_out_templates(spark, model):
    """Texts of templates that no tree has seen: what is accepted is nearly always right, and most is."""
    x, y, template = pii._proposals(spark, 4000)
    total = sum(pii._apply(t, x) for t in model.trees)
    accepted = 1 / (1 + np.exp(-(model.slope * total + model.shift))) >= model.threshold
    held = template % 4 == 1
    assert y[held & accepted].mean() >= 0.95 and accepted[held & (y == 1)].mean() >= 0.6


def test_pii_adds_spans_on_planted_rows(spark, model):
    rng = random.Random(9)
    docs = [r for r in spread(spark).select("doc_id", "text").filter("length(text) > 200").orderBy("doc_id").limit(120).collect()]
    secret = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    makes = [lambda: f'token = "{secret()}"', lambda: f"call me: {rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}", lambda: f"write to jo{rng.randrange(99)} (at) mail.example.com"]
    rows, want = [], {}
    for i, r in enumerate(docs):
        head, tail = r["text"][:100] + " ", " " + r["text"][100:]
        inner = makes[i % 3]() if i % 2 else "and no more than that"
        rows.append((i, head + inner + tail))
        want[i] = (len(head), len(head) + len(inner)) if i % 2 else None
    before = {r["doc_id"]: r["n_spans"] for r in pii.find(documents(spark, list(enumerate(d["text"] for d in docs))), model).collect()}
    got = {r["doc_id"]: r for r in pii.find(documents(spark, rows), model).collect()}
    caught = [any(want[i][0] <= s["start"] and s["end"] <= want[i][1] for s in got[i]["found"]) for i in want if want[i]]
    assert sum(caught) / len(caught) >= 0.9
    assert all(got[i]["n_spans"] == before[i] for i in want if not want[i])


def test_pii_many_matches_in_one_text(spark, model):
    text = " ".join(f"u{i}@h.example.org" for i in range(6000))
    row = pii.find(documents(spark, [(1, text)]), model).first()
    assert row["n_email"] == 6000 and row["found"][5999]["end"] == len(text)


def test_pii_leaves_columns_of_its_own_names_alone(spark, model):
    docs = documents(spark, [(1, "a@b.co")]).withColumn("found", F.lit("mine")).withColumn("n_email", F.lit(7))
    row = pii.redact(docs, model).first()
    assert (row["text"], row["_text"], row["found"], row["n_email"], row["shard"]) == ("[EMAIL]", "y", "mine", 7, 3)
    assert pii.find(docs, model, ("doc_id", "found", "_text")).first()["n_email"] == 1


def test_pii_redacts(spark, model):
    got = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, [(1, "😀 a@b.co!"), (2, None), (3, "none")]), model).collect()}
    assert got == {1: "😀 [EMAIL]!", 2: None, 3: "none"}


def test_pii_runs_no_python(spark, model):
    plan = pii.find(documents(spark, [(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


EMPTY = hashlib.sha256(b"").hexdigest()


def test_lm_awkward_and_empty(spark):
    rows = lm_score.lm_scores(awkward(spark)).collect()
    assert len(rows) == 13
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["n_words"], r["log10_score"], r["mean_log10"]) == (0, 0.0, None)
        else:
            assert r["n_words"] == 0 or r["mean_log10"] < 0
    assert len({round(r["log10_score"], 9) for r in rows if r["doc_id"] in (5, 6, 7)}) == 1  # ties and repeated rows
    assert lm_score.lm_scores(empty(spark)).collect() == lm_score.lm_scores_by_rows(empty(spark)).collect() == []


def test_substring_awkward_and_empty(spark):
    rows = substring.dedup_substrings(awkward(spark)).collect()
    assert len(rows) == 13
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    assert all(by_id[i] == [(0, 0, EMPTY)] for i in (1, 2, 3)) and by_id[4][0][:2] == (1, 0)
    # the row with a null doc_id goes first and keeps the text; all later copies lose it
    assert sorted(x[:2] for x in by_id[None]) == [(0, 0), (60, 0)]
    assert [x[:2] for i in (5, 6, 7) for x in by_id[i]] == [(60, 60)] * 4
    assert sorted(x[:2] for x in by_id[8]) == [(2, 0), (40_000, 0)]
    assert substring.dedup_substrings(empty(spark)).collect() == []


def test_pii_awkward_and_empty(spark, model):
    rows = pii.find(awkward(spark), model).collect()
    assert len(rows) == 13 and all(r["base_sha256"] == EMPTY and r["spans"] == "" and r["n_spans"] == 0 for r in rows)
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in pii.redact(awkward(spark), model).collect())
    assert texts == sorted((str(r["doc_id"]), r["text"] or "") for r in awkward(spark).collect())
    assert pii.find(empty(spark), model).collect() == [] and pii.redact(empty(spark), model).collect() == []
