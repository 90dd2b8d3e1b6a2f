"""A corpus from language identification to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents`` (others are dropped), a row
for each document that stays:

language_id      documents that the classifier rejects go (no letter, null, or too uncertain)
minhash_dedup    one document of each group of near copies stays, the smallest doc_id; a repeated row goes
substring_dedup  words of a 20-word window that also starts earlier go; n_chars follows the text
pii              personal data becomes its kind in brackets; n_chars follows the text
packing          tokenised documents as pieces of sequences of at most 4096 tokens

Stages are functions of the whole table that they are given; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, minhash, packing, pii, substring
from brindle.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return language.predict(docs, language.fit(docs), COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.xxhash64("doc_id", "text_hash").alias("_row")
    chosen = minhash.near_duplicates(docs).filter("kept").select(row)
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).select(*COLUMNS, row)
    return docs.join(chosen, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)  # one shuffle of the texts for both


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(docs, with_text=True, keep=("lang", "source"))
    return _counted(kept.withColumnRenamed("kept", "text"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Classifiers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
