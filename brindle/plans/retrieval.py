"""Vector and keyword search, fusion, evaluation, topics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import relational, retrieval as R
from brindle.operators import topics as T
from brindle.operators.graph_search import graph_search
from brindle.operators.web_search import web_search
from brindle.plans.registry import query
from brindle.plans.tables import RECORDS_SQL, records
from brindle.sources.files import table

_PAIRS_SQL = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 100 = 0),
cos AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), query), 6) AS score FROM embeddings, q)"""


def _queries(spark, sf):
    """The query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


@query("knn_cosine", f"WITH {_PAIRS_SQL} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos) WHERE rank <= 10")
def knn_cosine(spark, sf):
    return R.nearest(_vectors(spark, sf), _queries(spark, sf), 10)


@query("knn_threshold", f"WITH {_PAIRS_SQL} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cos) WHERE rank <= 10 AND score >= 0.3")
def knn_threshold(spark, sf):
    return R.above(R.nearest(_vectors(spark, sf), _queries(spark, sf), 10), 0.3)


@query("knn_l2", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 100 = 0),
l2 AS (SELECT query_id, vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), query) ^ 2, 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM l2) WHERE rank <= 10""")
def knn_l2(spark, sf):
    return R.nearest(_vectors(spark, sf), _queries(spark, sf), 10, "l2")


@query("knn_per_source", f"WITH {_PAIRS_SQL} SELECT query_id, vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM cos) WHERE rank <= 3")
def knn_per_source(spark, sf):
    return R.nearest(_vectors(spark, sf), _queries(spark, sf), 3, within=["label"])


@query("index_search")
def index_search(spark, sf):
    """Every hundredth vector in an index of all; of the hits, those with a label that few rows have come from the exact search."""
    from brindle.operators import vector_index
    from brindle.sources.shared import fresh_path

    path = fresh_path(spark, "index")
    vector_index.build_index(_vectors(spark, sf), path)
    every = vector_index.search_index(spark, path, _queries(spark, sf), 10, probes=16).withColumn("kind", F.lit("all"))
    some = vector_index.search_index(spark, path, _queries(spark, sf), 10, probes=2, where=F.col("vec_id") % 25 == 3).withColumn("kind", F.lit("few"))
    return every.unionByName(some)


_LISTS_SQL = """ranked AS (SELECT source, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS a, row_number() OVER (ORDER BY n_chars % 101, doc_id) - 1 AS b FROM documents),
votes AS (SELECT source, doc_id, a AS rank, 0 AS list FROM ranked WHERE a < 50 UNION ALL SELECT source, doc_id, b, 1 FROM ranked WHERE b < 50),
fused AS (SELECT source, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM votes GROUP BY 1, 2)"""


def _lists(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    first = d.orderBy(F.desc("n_chars"), "doc_id").limit(50)
    second = d.orderBy(F.col("n_chars") % 101, "doc_id").limit(50)
    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)  # noqa: E731  the fifty rows of a list
    return [rank(first, F.desc("n_chars"), "doc_id"), rank(second, F.col("n_chars") % 101, "doc_id")]


@query("rrf_fuse", f"WITH {_LISTS_SQL} SELECT source, doc_id, score FROM fused ORDER BY score DESC, first, source, doc_id LIMIT 20")
def rrf_fuse(spark, sf):
    return R.fuse(_lists(spark, sf), ["source", "doc_id"], limit=20)


@query("rrf_fuse_total_order", f"WITH {_LISTS_SQL} SELECT source, doc_id, score FROM fused")
def rrf_fuse_total_order(spark, sf):
    return R.fuse(_lists(spark, sf), ["source", "doc_id"])


@query("best_hit_per_record", f"WITH {_PAIRS_SQL}, h AS (SELECT label, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank, query_id FROM cos WHERE vec_id <> query_id), b AS (SELECT label, score, rank, row_number() OVER (PARTITION BY label ORDER BY score DESC, rank) AS rn FROM h WHERE rank <= 3) SELECT label, score, CAST(rank AS INTEGER) AS rank FROM b WHERE rn = 1 ORDER BY score DESC, label LIMIT 6")
def best_hit_per_record(spark, sf):
    near = R.nearest(_vectors(spark, sf), _queries(spark, sf), 4, within=["label"]).filter("vec_id <> query_id")
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "vec_id")
    hits = near.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("label", "rank", "score")
    return R.best_hit(hits, "label", 6)


@query("hydrate_ranked", "SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def hydrate_ranked(spark, sf):
    d = table(spark, sf, "documents")
    top = d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    ranked = top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return relational.hydrate(ranked, d.select("doc_id", "source"), "doc_id")


_BM25_SQL = """q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark WHERE item_id % 100 = 0),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean FROM d),
p AS (SELECT term, doc_id, any_value(size) AS size, count(*) AS tf FROM (SELECT doc_id, len(ws) AS size, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), stats GROUP BY 1, 2)"""


@query("keyword_bm25", f"WITH {_BM25_SQL} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def keyword_bm25(spark, sf):
    questions = table(spark, sf, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(table(spark, sf, "documents").select("doc_id", "text"), questions, 10)


def web_questions(spark, sf):
    """Of every text whose id is divisible by 100: its fourth and fifth word as a phrase and its second one, or its sixth and ninth, without its fortieth."""
    w = F.split(F.regexp_replace("text", r"[^\p{L}\p{N}\s]", ""), r"\s+")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    asked = F.concat(F.lit('"'), at(3), F.lit(" "), at(4), F.lit('" '), at(1), F.lit(" or "), at(5), F.lit(" "), at(8), F.lit(" -"), at(39))
    return table(spark, sf, "documents").filter("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), asked.alias("query"))


@query("keyword_web_search")
def keyword_web_search(spark, sf):
    return web_search(table(spark, sf, "documents").select("doc_id", "text"), web_questions(spark, sf), 10)


@query("hybrid_search", f"""WITH {_BM25_SQL},
x AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 100 = 0),
c AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), query), 6) AS score FROM embeddings, x),
v AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM s),
z AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score FROM v WHERE rank <= 10 GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 10""")
def hybrid_search(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, sf, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("doc_id"), "text").join(e, "doc_id").select(F.col("doc_id").alias("query_id"), "text", F.col("embedding").alias("query"))
    return R.retrieve("hybrid", {"vectors": e, "texts": table(spark, sf, "documents").select("doc_id", "text")}, asked, 10)


# Graph retrieval: suppliers and parts (modulo 97) as nodes of the graphs of the three return flags, orders as mentions of documents; sources of
# documents have vectors only.


def graph_corpus(spark, sf):
    """What ``graph_search`` reads, of the tables."""
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string")).alias("dst"), (F.col("l_orderkey") % 977).alias("chunk"), "l_quantity")
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), "text")
    number = F.regexp_replace("node", "^.", "").cast("long")
    nodes = line.select("source_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("vec_id", F.when(F.col("node").startswith("p"), number).otherwise(number + 97))
    mentions = line.select("source_id", F.col("src").alias("node"), "chunk").distinct()
    graphed = line.select("source_id", "chunk").distinct().join(d.drop("source_id"), "chunk")
    sources = line.select("source_id").unionByName(d.select("source_id")).distinct().filter("source_id is not null").select("source_id", F.crc32("source_id").alias("place"))
    return {
        "sources": sources, "nodes": nodes.join(e.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id"), "edges": line.groupBy("source_id", "src", "dst").agg(F.sum("l_quantity").alias("weight")), "links": mentions,
        "chunks": graphed.select("source_id", "chunk", "name", "text").unionByName(d), "vectors": d.join(e.select(F.col("vec_id").alias("chunk"), "embedding"), "chunk").select("source_id", "chunk", "embedding"),
    }


@query("graphrag_search")
def graphrag_search(spark, sf):
    return graph_search(graph_corpus(spark, sf), _queries(spark, sf), 92, tokens=4000)


# Evaluation: expected items are those of a customer's priorities, retrieved ones follow its orders.

_EVAL_SQL = """e AS (SELECT o_custkey AS q, list(o_orderkey % 10 ORDER BY o_orderkey) AS retrieved, list(DISTINCT o_orderkey % 10) FILTER (o_orderstatus = 'F') AS x FROM orders GROUP BY 1),
ev AS (SELECT q, retrieved, coalesce(x, []) AS expected FROM e)"""


def _evaluated(spark, sf):
    item = (F.col("o_orderkey") % 10).alias("item")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", item)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"])
    return o.groupBy(F.col("o_custkey").alias("q")).agg(listed.alias("retrieved"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("item"))).alias("expected"))


@query("recall_at_5", f"WITH {_EVAL_SQL} SELECT q, round(CASE WHEN len(expected) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(expected), list_distinct(retrieved[1:5]))) / len(expected) END, 6) AS recall FROM ev")
def recall_at_5(spark, sf):
    return _evaluated(spark, sf).select("q", F.round(R.recall_at(F.col("expected"), F.col("retrieved"), 5), 6).alias("recall"))


@query("ndcg_at_10", f"""WITH {_EVAL_SQL}, h AS (SELECT q, expected, unnest(retrieved[1:10]) AS item, generate_subscripts(retrieved[1:10], 1) AS i FROM ev),
f AS (SELECT q, item, any_value(expected) AS expected, min(i) AS i FROM h GROUP BY 1, 2), r AS (SELECT q, item, expected, row_number() OVER (PARTITION BY q ORDER BY i) AS rank FROM f),
g AS (SELECT q, sum(CASE WHEN list_contains(expected, item) THEN 1 / log2(rank + 1) ELSE 0 END) AS gain, any_value(len(expected)) AS n FROM r GROUP BY 1)
SELECT q, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM g""")
def ndcg_at_10(spark, sf):
    return _evaluated(spark, sf).select("q", F.round(R.ndcg_at(F.col("expected"), F.col("retrieved"), 10), 6).alias("ndcg"))


@query("citation_precision", f"WITH {_EVAL_SQL} SELECT q, round(len(list_intersect(list_distinct(retrieved), expected)) / len(list_distinct(retrieved)), 6) AS score FROM ev")
def citation_precision(spark, sf):
    return _evaluated(spark, sf).select("q", F.round(R.citation_precision(F.col("expected"), F.col("retrieved")), 6).alias("score"))


@query("answer_points", r"""WITH p AS (SELECT item_id, trim(regexp_replace(lower(text), '[\x20\t\r\n\f]+', ' ', 'g')) AS point FROM benchmark)
SELECT item_id, count(doc_id) AS hits FROM p LEFT JOIN (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x20\t\r\n\f]+', ' ', 'g')) AS t FROM documents) ON contains(t, point) GROUP BY 1""")
def answer_points(spark, sf):
    from brindle.functions.text import collapse

    points = table(spark, sf, "benchmark").select("item_id", collapse(F.col("text")).alias("point"))
    docs = table(spark, sf, "documents").select("doc_id", collapse(F.coalesce("text", F.lit(""))).alias("t"))
    hits = R.points_found(docs, points).groupBy("item_id").agg(F.count("*").alias("hits"))
    return points.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("lexical_score", """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS ws, lead(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, turn, round(len(list_intersect(ws, r)) / greatest(len(ws), 1), 6) AS score FROM w WHERE r IS NOT NULL""")
def lexical_score(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("q"), F.lead(text).over(w).alias("r")).filter("r is not null")
    return c.select("conv_id", "turn", F.round(R.lexical_score(F.col("q"), F.col("r")), 6).alias("score"))


@query("prescreen_filter", "SELECT doc_id FROM documents WHERE coalesce(contains(lower(text), 'the'), TRUE) ORDER BY doc_id LIMIT 30")
def prescreen_filter(spark, sf):
    hits = table(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("rank"))
    return R.prescreen(hits, F.lower("text").contains("the"), 30).select("doc_id")


@query("rerank_noop_topn", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10")
def rerank_noop_topn(spark, sf):
    return R.rerank(table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("rank")), None, 10).select("doc_id")


# Topics and comparison.


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS total FROM embeddings")
def vector_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").select("vec_id", V.normalize(F.col("embedding")).alias("x"))
    return unit.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("topic_clusters")
def topic_clusters(spark, sf):
    return T.clusters(table(spark, sf, "embeddings"))


@query("cluster_labels", r"""
WITH r AS (SELECT source AS cluster, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_''-]*')) AS raw FROM documents),
w AS (SELECT cluster, regexp_replace(raw, '[''_-]+$', '') AS word FROM r),
c AS (SELECT cluster, word, count(*) AS n FROM w WHERE word <> '' AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + """) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS rank FROM c)
SELECT cluster, string_agg(word, ' / ' ORDER BY rank) AS label FROM k WHERE rank <= 5 GROUP BY 1""")
def cluster_labels(spark, sf):
    return T.labels(table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("text").alias("title")))


@query("topic_trends", f"""WITH {RECORDS_SQL} SELECT label AS cluster, repository, strftime(coalesce(published, created), '%Y-%m') AS month, count(*) AS n FROM records JOIN (SELECT vec_id, label FROM embeddings) ON vec_id = id GROUP BY ALL""")
def topic_trends(spark, sf):
    members = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    month = F.date_format(F.coalesce("published", "created"), "yyyy-MM").alias("month")
    return records(spark, sf).select("id", "repository", month).join(members, "id").groupBy("cluster", "repository", "month").agg(F.count("*").alias("n"))


_POSITIVE, _NEGATIVE = ("support", "available", "enabled", "works", "and"), ("not supported", "unsupported", "missing", "without", "cannot", "von")


@query("comparison_matrix", """
WITH r AS (SELECT doc_id AS id, source AS repository, CASE WHEN doc_id % 2 = 0 THEN 'release' ELSE 'issue' END AS source_type, lower(coalesce(text, '')) AS t, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS day FROM documents),
d AS (SELECT unnest(['english', 'german']) AS dimension, unnest(['the', 'der']) AS term),
c AS (SELECT dimension, repository, source_type, day, CASE WHEN NOT regexp_matches(t, '(^|[^a-z0-9_])' || term || '($|[^a-z0-9_])') THEN NULL
  WHEN regexp_matches(t, '(?s)(^|[^a-z0-9_])' || term || '($|[^a-z0-9_]).{0,59}?(not supported|unsupported|missing|without|cannot|von)|(^|[^a-z0-9_])' || term || '(not supported|unsupported|missing|without|cannot|von)|(not supported|unsupported|missing|without|cannot|von)(.{0,59}?[^a-z0-9_])?' || term || '($|[^a-z0-9_])') THEN 'negative'
  WHEN source_type = 'release' OR regexp_matches(t, 'support|available|enabled|works|and') THEN 'positive' END AS found FROM r, d),
g AS (SELECT dimension, repository, count(*) FILTER (found = 'positive') AS p, count(*) FILTER (found = 'negative') AS n FROM c GROUP BY 1, 2)
SELECT dimension, repository, CASE WHEN p > 0 AND n > 0 THEN 'unknown' WHEN p > 0 THEN 'supported' WHEN n > 0 THEN 'not_supported' ELSE 'unknown' END AS status, p + n AS evidence FROM g""")
def comparison_matrix(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("repository"), F.when(F.col("doc_id") % 2 == 0, "release").otherwise("issue").alias("source_type"), F.coalesce("text", F.lit("")).alias("text"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("day"),
    )
    return T.comparison_matrix(rows, {"english": ["the"], "german": ["der"]}, list(_POSITIVE), list(_NEGATIVE)).select("dimension", "repository", "status", "evidence")
