"""Retrieval dispatch, index upkeep, ownership, graph upkeep and normalisers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import aggregates as A
from brindle.operators import chunking
from brindle.operators import graph as G
from brindle.operators import relational as R
from brindle.operators import retrieval as V
from brindle.operators import topics as T
from brindle.operators import windows as W
from brindle.plans.registry import query
from brindle.plans.tables import EDGES_SQL, RECORDS_SQL, edges, records
from brindle.sources import files as S
from brindle.sources.files import table

# Retrieval.

_HITS_SQL = """h AS (SELECT lang AS query_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'hybrid' ELSE 'classic' END AS retriever, doc_id AS doc, CAST(ceil(coalesce(n_chars, 0) / 4.0) AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
hits AS (SELECT * FROM h WHERE rank <= 10)"""


def _hits(spark, sf):
    """The ten longest documents of every source, by language: what a search of each source found."""
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("query_id"), "source", F.when(F.col("source").isin("src1", "src2"), "hybrid").when(F.col("source") == "src3", "unknown").otherwise("classic").alias("retriever"), F.col("doc_id").alias("doc"),
        F.ceil(F.coalesce("n_chars", F.lit(0)) / F.lit(4)).cast("long").alias("tokens"), "n_chars",
    )
    return W.newest(d, ["query_id", "source"], [F.desc("n_chars"), F.asc("doc")], 10, "rank").drop("n_chars")


@query("dispatch_merge", f"""WITH RECURSIVE {_HITS_SQL},
g AS (SELECT query_id, retriever, row_number() OVER (PARTITION BY query_id ORDER BY min(source)) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM hits GROUP BY 1, 2),
s AS (SELECT query_id, retriever, i, 6001 // n + CASE WHEN i < 6001 % n THEN 1 ELSE 0 END AS share FROM g),
o AS (SELECT query_id, retriever, i, share, doc, tokens, row_number() OVER (PARTITION BY query_id, retriever ORDER BY source, rank) AS r FROM hits JOIN s USING (query_id, retriever)),
w AS (SELECT query_id, i, retriever, doc, tokens, r, share, CASE WHEN tokens < share THEN tokens ELSE 0 END AS used, tokens < share AS kept FROM o WHERE r = 1 UNION ALL
  SELECT o.query_id, o.i, o.retriever, o.doc, o.tokens, o.r, o.share, CASE WHEN w.used + o.tokens < o.share THEN w.used + o.tokens ELSE w.used END, w.used + o.tokens < o.share FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i AND o.r = w.r + 1),
m AS (SELECT query_id, retriever, doc, tokens, row_number() OVER (PARTITION BY query_id ORDER BY i, r) AS r FROM w WHERE kept),
f AS (SELECT query_id, retriever, doc, r, CASE WHEN tokens < 5400 THEN tokens ELSE 0 END AS used, tokens < 5400 AS kept FROM m WHERE r = 1 UNION ALL
  SELECT m.query_id, m.retriever, m.doc, m.r, CASE WHEN f.used + m.tokens < 5400 THEN f.used + m.tokens ELSE f.used END, f.used + m.tokens < 5400 FROM f JOIN m ON m.query_id = f.query_id AND m.r = f.r + 1)
SELECT query_id, retriever, doc, CAST(used AS BIGINT) AS used FROM f WHERE kept""")
def dispatch_merge(spark, sf):
    return W.dispatch(_hits(spark, sf), ("classic", "hybrid"), 6001)


@query("per_source_split", f"WITH {_HITS_SQL} SELECT query_id, source, doc FROM hits WHERE rank <= greatest(1, 40 // (SELECT count(DISTINCT source) FROM hits)) * 2")
def per_source_split(spark, sf):
    return V.per_source(_hits(spark, sf), 40, over=2).select("query_id", "source", "doc")


@query("hits_ceiling", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= greatest(12, (SELECT count(DISTINCT source) FROM documents))")
def hits_ceiling(spark, sf):
    d = table(spark, sf, "documents")
    return V.ceiling(d.select("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("rank")), 12, d.select("source").distinct().count()).select("doc_id")


@query("post_stages", f"WITH {_HITS_SQL} SELECT query_id, doc, tokens FROM hits WHERE tokens BETWEEN 1 AND 500 AND rank <= 3")
def post_stages(spark, sf):
    stages = [lambda hits, context: hits.filter(F.col("tokens").between(1, context["most"])), lambda hits, context: hits.filter("rank <= 3")]
    return V.run_stages(_hits(spark, sf), stages, {"most": 500}).select("query_id", "doc", "tokens")


@query("graph_seeds", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id = 0),
s AS (SELECT 'n' || vec_id AS node, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), x), 6) AS score FROM embeddings, q WHERE vec_id % 7 <> 3)
SELECT node, greatest(score, 0) AS weight FROM s ORDER BY score DESC, node LIMIT 10""")
def graph_seeds(spark, sf):
    e = table(spark, sf, "embeddings")
    nodes = e.select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("node"), F.when(F.col("vec_id") % 7 != 3, F.col("embedding")).alias("embedding"))
    return V.seeds(nodes, e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))


@query("graph_segments", """WITH s AS (SELECT source AS source_id, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM documents)), g AS (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND doc_id % 11 = 0),
k AS (SELECT *, source_id IN (SELECT source FROM g) AS has_graph FROM s), f AS (SELECT *, CASE WHEN has_graph OR coalesce(lag(has_graph) OVER (ORDER BY place), TRUE) THEN 1 ELSE 0 END AS fresh FROM k)
SELECT source_id, CAST(place AS INTEGER) AS place, has_graph, CAST(sum(fresh) OVER (ORDER BY place) - 1 AS BIGINT) AS segment FROM f""")
def graph_segments(spark, sf):
    d = table(spark, sf, "documents")
    sources = d.select(F.col("source").alias("source_id")).distinct().withColumn("place", F.row_number().over(Window.orderBy("source_id")))  # sources are few
    return G.segments(sources, d.filter("lang = 'de' AND doc_id % 11 = 0").select(F.col("source").alias("source_id")))


# Graph upkeep.


@query("edge_insert", """WITH e AS (SELECT l_returnflag AS source_id, 's' || l_suppkey AS src, 's' || (l_partkey % 97) AS dst FROM lineitem), n AS (SELECT source_id, src AS node FROM e UNION ALL SELECT source_id, dst FROM e WHERE src <> dst) SELECT source_id, node, count(*) AS degree FROM n GROUP BY 1, 2""")
def edge_insert(spark, sf):
    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    line = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source_id"), node(F.col("l_suppkey")).alias("src"), node(F.col("l_partkey") % 97).alias("dst"), F.lit(1.0).alias("weight"), "l_linenumber")
    return G.merge_edges(line.filter("l_linenumber < 3"), line.filter("l_linenumber >= 3"))[1]


@query("link_node_chunk", "SELECT DISTINCT l_returnflag AS source_id, l_suppkey AS node, l_orderkey AS chunk FROM lineitem")
def link_node_chunk(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source_id"), F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chunk"))
    return G.link_chunks(links, links)


@query("pending_chunks", "SELECT source AS source_id, doc_id AS chunk FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) ORDER BY source, doc_id LIMIT 100")
def pending_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk"))
    progress = d.filter("chunk % 3 = 0").withColumn("status", F.when(F.col("chunk") % 2 == 0, "completed").otherwise("failed"))
    return G.pending(d, progress, 100)


_APPLY_SQL = r"""
WITH w AS (SELECT source AS source_id, doc_id AS chunk, list_transform(string_split(text, ' ')[1:7], lambda x: nullif(regexp_replace(x, '^\s+|\s+$', '', 'g'), '')) AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT source_id, chunk, lower(ws[i]) AS n FROM w, range(1, 7) t(i) WHERE ws[i] IS NOT NULL),
r AS (SELECT source_id, chunk, lower(ws[i]) AS a, lower(ws[i + 1]) AS b FROM w, range(1, 7) t(i) WHERE i < len(ws)),
x AS (SELECT DISTINCT source_id, chunk, n FROM (SELECT source_id, chunk, a AS n FROM r UNION ALL SELECT source_id, chunk, b FROM r) WHERE n IS NOT NULL AND (source_id, chunk, n) NOT IN (SELECT source_id, chunk, n FROM e)),
f AS (SELECT source_id, n, count(*) AS doc_freq FROM (SELECT * FROM e UNION ALL SELECT * FROM x) GROUP BY 1, 2),
d AS (SELECT source_id, n, count(*) AS degree FROM (SELECT source_id, unnest(list_distinct([a, b])) AS n FROM r WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1, 2),
l AS (SELECT source_id, n, count(DISTINCT chunk) AS chunks FROM e GROUP BY 1, 2)
SELECT f.source_id, f.n AS normalized_name, doc_freq, coalesce(degree, 0) AS degree, coalesce(chunks, 0) AS chunks FROM f LEFT JOIN d ON d.source_id = f.source_id AND d.n = f.n LEFT JOIN l ON l.source_id = f.source_id AND l.n = f.n"""


def extractions(spark, sf):
    """Of every text: its first six words as entities, and a relation between each of its first seven and the next."""
    d = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("source_id"), F.col("doc_id").alias("chunk"), F.slice(F.split("text", " "), 1, 7).alias("ws"), "lang", "n_chars")
    entity = lambda w: F.struct(w.alias("name"), F.col("lang").alias("type"), F.concat(F.lit("in "), F.col("lang")).alias("description"))
    weight = F.when(F.col("n_chars") % 5 > 0, (F.col("n_chars") % 5).cast("string")).otherwise("heavy")
    relation = lambda w, i: F.struct(w.alias("source"), F.get("ws", i + 1).alias("target"), F.lit("next").alias("type"), F.lit(None).cast("string").alias("description"), weight.alias("weight"))
    return d.select("source_id", "chunk", F.transform(F.slice("ws", 1, 6), entity).alias("entities"), F.transform(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), relation).alias("relationships"))


@query("graph_apply", _APPLY_SQL)
def graph_apply(spark, sf):
    """Half of the chunks applied, then all of them: the others are added, those that are done are not applied again."""
    from brindle.operators import graph_build

    chunks = extractions(spark, sf)
    graph = graph_build.apply_chunks(graph_build.empty_graph(spark), chunks.filter("chunk % 2 = 0"))
    graph = graph_build.apply_chunks(graph, chunks)
    counted = graph["links"].groupBy("source_id", "node").agg(F.count("*").alias("chunks"))
    return graph["nodes"].join(counted, ["source_id", "node"], "left").select("source_id", "normalized_name", "doc_freq", "degree", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("expand_induced", f"""WITH {EDGES_SQL}, one AS (SELECT DISTINCT src AS node FROM edges WHERE dst = 's1' UNION SELECT 's1'), two AS (SELECT node, CASE WHEN node = 's1' THEN 0 ELSE 1 END AS hop FROM one UNION ALL SELECT DISTINCT dst, 2 FROM edges WHERE src IN (SELECT node FROM one) AND dst <> 's1'),
n AS (SELECT node FROM two ORDER BY hop, node LIMIT 500) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) ORDER BY src, dst LIMIT 2000""")
def expand_induced(spark, sf):
    e = edges(spark, sf)
    return G.induced(e, G.expand(e, spark.range(1).select(F.lit("s1").alias("node"))).select("node"))


# Index upkeep.

_INDEX_SQL = "i AS (SELECT source, doc_id, n_chars FROM documents)"


@query("replace_chunks", f"WITH {_INDEX_SQL} SELECT source, doc_id, n_chars FROM i WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source, doc_id + 1000000, n_chars FROM i WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0")
def replace_chunks(spark, sf):
    i = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    fresh = i.filter("source IN ('src1', 'src2') AND doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000000)
    return R.replace_by_path(i, fresh, ["source"])


@query("delete_chunks", f"WITH {_INDEX_SQL} SELECT * FROM i WHERE source <> 'src5'")
def delete_chunks(spark, sf):
    i = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return R.delete_by_path(i, i.filter("source = 'src5'"), ["source"])


@query("mark_seen", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS seen_at FROM documents")
def mark_seen(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("seen_at"))
    return R.mark_seen(d, d.filter("doc_id % 3 = 0"), "doc_id", "2024-02-01")


@query("topic_snapshot_upsert", "SELECT lang AS project, source AS snapshot, 'v1' AS version, CASE WHEN source < 'src3' THEN -1 ELSE count(*) END AS n FROM documents GROUP BY 1, 2")
def topic_snapshot_upsert(spark, sf):
    keys = ["project", "snapshot", "version"]
    runs = table(spark, sf, "documents").groupBy(F.col("lang").alias("project"), F.col("source").alias("snapshot")).agg(F.count("*").alias("n")).withColumn("version", F.lit("v1"))
    return R.upsert_by_key(runs, runs.filter("snapshot < 'src3'").withColumn("n", F.lit(-1).cast("long")), keys).select(*keys, "n")


@query("topic_snapshot_id")
def topic_snapshot_id(spark, sf):
    """The id of a clustering whose clusters are the labels of the vectors, with the mean of a few as centroid."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return T.snapshot_id(e.groupBy(F.col("label").alias("cluster")).agg(F.collect_list("vec_id").alias("members"), F.array(F.min("x"), F.max("y")).alias("centroid")))


@query("changed_first", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang, doc_id % 4 = 0 AS changed FROM documents")
def changed_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return R.changed_first(d.filter("doc_id % 4 = 0").withColumn("lang", F.lit("new")), d, "doc_id")


# Ownership and filters.


@query("owns_all", "SELECT count(*) FILTER (c_nationkey IS NOT NULL AND c_acctbal > -10000) = count(*) AS ok FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def owns_all(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.owns_all(table(spark, sf, "customer"), asked, "c_custkey", F.col("c_acctbal") > -10000)


@query("journal_owner_check", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def journal_owner_check(spark, sf):
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("user_id"))
    return R.owned_by(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), owners, "l_orderkey", "1-URGENT")


@query("left_label_dimension", "SELECT coalesce(n_name, 'none') AS label, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1")
def left_label_dimension(spark, sf):
    labels = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    rows = R.with_label(table(spark, sf, "customer").select("c_nationkey"), labels, "c_nationkey", True)
    return rows.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query("left_case_progress", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'failed' WHEN n_chars % 3 < 2 THEN 'processing' ELSE 'done' END AS state FROM documents")
def left_case_progress(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    progress = d.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("running").alias("status"), (F.col("n_chars") % 3).alias("done"), F.lit(2).alias("total"))
    return R.with_progress(d.select("doc_id"), progress, "doc_id")


@query("fixture_filter", f"WITH {RECORDS_SQL} SELECT id FROM records WHERE lower(repository) IN ('src1', 'src4') AND lower(source_type) IN ('en', 'fr') AND published >= DATE '2024-02-01' AND published <= DATE '2024-10-01'")
def fixture_filter(spark, sf):
    return R.fixture_filter(records(spark, sf).withColumn("day", F.col("published")), ["SRC1", "Src4"], ["EN", "fr"], "2024-02-01", "2024-10-01").select("id")


@query("overlap_difference", """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS ws FROM conversations), p AS (SELECT *, lead(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM w)
SELECT conv_id, turn, CAST(len(list_filter(ws, lambda x: NOT list_contains(nx, x))) AS INTEGER) AS missing, CAST(len(list_intersect(ws, nx)) AS INTEGER) AS shared FROM p WHERE nx IS NOT NULL""")
def overlap_difference(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.words(F.coalesce("text", F.lit("")))).alias("ws")).withColumn("nx", F.lead("ws").over(w)).filter("nx is not null")
    return c.select("conv_id", "turn", F.size(F.array_except("ws", "nx")).alias("missing"), F.size(F.array_intersect("ws", "nx")).alias("shared"))


# Aggregates and orders.


@query("schedule_outcomes", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS skipped FROM events GROUP BY 1")
def schedule_outcomes(spark, sf):
    e = table(spark, sf, "events").select(A.bucket_of(F.col("ts"), "day").alias("bucket"), "event_type")
    return e.groupBy("bucket").agg(*(F.count_if(F.col("event_type") == kind).alias(name) for kind, name in (("purchase", "success"), ("error", "failed"), ("signup", "skipped"))))


for _order, _sql in (("value_asc", "value, dimension"), ("period_asc", "dimension")):
    query(
        f"agg_order_{_order}",
        f"WITH {RECORDS_SQL}, g AS (SELECT strftime(coalesce(published, created), '%Y-%m') AS dimension, CAST(count(*) AS DOUBLE) AS value FROM records GROUP BY 1) SELECT dimension, value, (SELECT count(*) FROM g) AS total_groups, (SELECT count(*) FROM g) > 5 AS capped FROM g ORDER BY {_sql} LIMIT 5",
    )(lambda spark, sf, o=_order: A.aggregate(records(spark, sf), "count", "month", o, 5))


@query("sorted_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def sorted_page(spark, sf):
    return W.sorted_page(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), {"name": "c_name", "balance": "c_acctbal"}, "balance", True, "c_custkey", 25, 50).select("c_custkey", "c_name")


@query("half_even_round", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN l_quantity // 2 WHEN (CAST(l_quantity AS BIGINT) // 2) % 2 = 0 THEN floor(l_quantity / 2) ELSE ceil(l_quantity / 2) END AS DOUBLE) AS half FROM lineitem")
def half_even_round(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.round_half_even(F.col("l_quantity") / 2).cast("double").alias("half"))


# Normalisers.


@query("timestamps_utc", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate - CASE o_orderkey % 4 WHEN 1 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM orders""")
def timestamps_utc(spark, sf):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(raw, F.lit("Z"))).when(kind == 1, F.concat(raw, F.lit("+01:30"))).when(kind == 2, raw).otherwise("not a time")
    return table(spark, sf, "orders").select("o_orderkey", X.iso_z(X.utc(text)).alias("at"))


@query("label_names", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ',x' WHEN 1 THEN lang WHEN 2 THEN '' ELSE '' END AS names FROM documents""")
def label_names(spark, sf):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('[{"name":'), q(F.col("source")), F.lit('},"x",""]'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("["), q(F.concat(F.lit(" "), F.col("lang"), F.lit(" "))), F.lit(',{"id":1}]')))
        .when(F.col("doc_id") % 4 == 2, F.lit('{"name":"no list"}'))
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.label_names(raw), ",").alias("names"))


_ISSUES_SQL = """i AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'pr' END AS pull_request, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS created_at, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 + 30 AS INTEGER)) END AS updated_at FROM documents)"""


@query("issue_scan", f"WITH {_ISSUES_SQL} SELECT id FROM i WHERE pull_request IS NULL AND (created_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30' OR coalesce(updated_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30', FALSE)) ORDER BY id LIMIT 1000")
def issue_scan(spark, sf):
    day = lambda more: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300 + more).cast("int"))
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, "pr").alias("pull_request"), day(0).alias("created_at"), F.when(F.col("doc_id") % 2 == 0, day(30)).alias("updated_at"))
    return S.issues(raw, "2024-03-01", "2024-06-30").select("id")


@query("release_window", f"WITH {_ISSUES_SQL} SELECT id FROM i WHERE coalesce(updated_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30', FALSE) OR created_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-30'")
def release_window(spark, sf):
    day = lambda more: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300 + more).cast("int"))
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), day(0).alias("created_at"), F.when(F.col("doc_id") % 2 == 0, day(30)).alias("published_at"))
    return S.releases(raw, "2024-03-01", "2024-06-30").select("id")


@query("hashes_and_names", r"SELECT page_id, md5(coalesce(html, '')) AS md5, regexp_replace(regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM pages")
def hashes_and_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.coalesce("html", F.lit(""))).alias("md5"), X.safe_filename(X.basename(F.col("url"))).alias("name"))


@query("repository_slugs", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '/' || source WHEN 1 THEN lang || '/' || source ELSE NULL END AS slug, doc_id % 4 = 0 AS is_html FROM documents""")
def repository_slugs(spark, sf):
    name = F.concat_ws("/", F.upper("lang"), "source")
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://GitHub.com/"), name, F.lit(".git"))).when(F.col("doc_id") % 4 == 1, name).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("https://api.github.com/repos/"), name)).otherwise("plain")
    return table(spark, sf, "documents").select("doc_id", X.repository_slug(url).alias("slug"), X.is_html_url(url).alias("is_html"))


@query("drop_nul", "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents")
def drop_nul(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.drop_nul(F.concat(F.lit("\0"), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\0 "))))).cast("long").alias("n"))


@query("tokenizer_windows")
def tokenizer_windows(spark, sf):
    """Windows of tokens of a public tokenizer; they join to the text again."""
    import public_tokenizers

    rows = chunking.tokenizer_windows(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 64, 128)
    return rows.select("doc_id", "part", "tokens", F.sha2("chunk", 256).alias("chunk_sha"))


@query("record_chunks")
def record_chunks(spark, sf):
    """Sections at headings, each packed by paragraph, line and word."""
    md = F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", "\n# ")
    return chunking.record_chunks(table(spark, sf, "documents").select("doc_id", md.alias("text"))).select("doc_id", "part", F.sha2("chunk", 256).alias("chunk_sha"))
