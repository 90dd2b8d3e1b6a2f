from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm.queries import QUERIES
from tests.llm.data import awkward, empty, sentence
from tests.llm.test_minhash import components
from tests.llm.test_texts import substring_brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty(spark):
    docs = empty(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def own_documents(spark):
    """Rows whose way through the stages is known: clean ones, copies, near copies, a shared passage, personal data, junk."""
    rng = random.Random(11)
    passage = sentence(rng, 40)
    base = sentence(rng, 120)
    near = base.split()
    near[5] = "changed"
    rows = [(i, sentence(rng, 60), "en") for i in range(30)]
    rows += [(100, base, "en"), (101, base, "en"), (102, " ".join(near), "en"), (103, f"{sentence(rng, 60)} {passage} x", "en"), (104, f"{sentence(rng, 70)} {passage} y", "en")]
    rows += [(105, sentence(rng, 50) + " mail a.b@example.org now", "en"), (106, None, "en"), (107, "", "en"), (108, "12 34 !!", "en"), (100, base, "en"), (None, sentence(rng, 55), None)]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumn("_text", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("found", F.lit(2)), rows, passage


def test_stages_against_brute_force(spark):
    docs, rows, passage = own_documents(spark)
    schema = docs.select(*corpus_pipeline.COLUMNS).schema
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(docs.collect(), schema)
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    texts = {i: t for i, t, _ in rows}
    # what has no letter is rejected; nearly all others stay
    assert not {106, 107, 108} & set(after["language_id"]) and len(set(after["language_id"]) - {106, 107, 108}) >= 33
    # the first of each group of copies stays
    kept = components([(i, t) for i, t in after["language_id"].items() if i is not None])
    assert {i for i in after["minhash_dedup"] if i is not None} == {i for i, c in kept.items() if i == c} and 100 in after["minhash_dedup"]
    want = substring_brute([(i, t) for i, t in after["minhash_dedup"].items() if i is not None])
    for i, t in after["substring_dedup"].items():
        if i is not None:
            assert len(t.split()) == want[i][0] - want[i][1]
    assert passage in after["substring_dedup"][103] and passage not in after["substring_dedup"][104]
    for i, t in after["pii"].items():
        if i != 105:
            assert t == after["substring_dedup"][i]
    assert after["pii"][105] == texts[105].replace("a.b@example.org", "[EMAIL]")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert check_packing(rows, list(after["pii"].items()), 4096) == -(-sum(r["length"] for r in rows) // 4096)


def test_awkward(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
