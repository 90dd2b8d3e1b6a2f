"""The registered queries of the operators in this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import alignment, divergence, embedding_dedup, language, lm_score, minhash, nearest, packing, pieces, pii, sharding, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    predicted = language.predict(docs, language.fit(docs))
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("found")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_lm_scores": op2_lm_scores,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_nearest": op6_nearest,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_sharding": op13_sharding,
}

_WORDS = r"""
docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs))"""

_VECTORS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64 AND len(list_filter(embedding, lambda c: c <> 0)) > 0)"""

SQL: dict[str, str] = {
    "op2_lm_scores": f"""
WITH {_WORDS},
g AS (SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT w, count(*) AS c FROM g GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
  SELECT g.doc_id, log10(CASE WHEN c3.c >= 2 THEN c3.c / x2.c WHEN c2.c >= 2 THEN c2.c / x1.c ELSE c1.c / n.n END * CASE WHEN g.u IS NULL OR c3.c >= 2 THEN 1 ELSE 0.4::DOUBLE END * CASE WHEN g.v IS NULL OR c2.c >= 2 THEN 1 ELSE 0.4::DOUBLE END) AS s
  FROM g JOIN one c1 ON g.w = c1.w LEFT JOIN one x1 ON g.v = x1.w LEFT JOIN two c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN two x2 ON g.u = x2.v AND g.v = x2.w
  LEFT JOIN three c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w CROSS JOIN (SELECT count(*) AS n FROM words) n)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 4) AS log10_score, round(sum(s) / len(ws), 6) AS mean_log10
FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id, len(ws)""",
    "op5_substring_dedup": f"""
WITH {_WORDS},
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM docs WHERE len(ws) >= 20),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM windows WHERE n > 1),
marked AS (SELECT w.doc_id, w.i, w.w, g.i IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(count(m.i) FILTER (WHERE m.removed) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.i) FILTER (WHERE NOT m.removed), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, len(ws)""",
    "op1_embedding_dedup": f"""
WITH RECURSIVE {_VECTORS},
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a""",
    "op6_nearest": f"""
WITH {_VECTORS},
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m, count(*) AS c FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN c > 1 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h""",
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs),
kept AS (SELECT lang, w, count(*) AS total FROM words GROUP BY lang, w HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, w, count(*) AS c FROM words GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.w, k.total, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
n AS (SELECT lang, source, sum(c) AS n FROM filled GROUP BY lang, source),
scored AS (SELECT f.lang, f.source, f.w, f.c, CAST(1 + (1000000000::HUGEINT * (f.c + 1)) // (n.n + s.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (f.total + 1)) // (s.n + s.v) AS BIGINT) AS q
  FROM filled f JOIN n ON f.lang = n.lang AND f.source = n.source JOIN sizes s ON s.lang = f.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM scored a JOIN scored b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, w AS item, (p - q) * (p - q) // q AS value FROM scored WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
