"""Filters, joins, sets and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.text import ilike, in_document_scope
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.plans.tables import RECORDS_SQL, edges, records
from brindle.sources.files import table

# Filters and projections.


@query("scope_filter", f"""WITH {RECORDS_SQL} SELECT id, repository FROM records WHERE repository IN ('src1', 'src2', 'src3') AND source_type IN ('en', 'de')
  AND coalesce(published, created) BETWEEN DATE '2024-02-01' AND DATE '2024-09-30'""")
def scope_filter(spark, sf):
    at = F.coalesce("published", "created")
    rows = records(spark, sf).filter(F.col("repository").isin("src1", "src2", "src3") & F.col("source_type").isin("en", "de"))
    return rows.filter(at.between(F.lit("2024-02-01").cast("date"), F.lit("2024-09-30").cast("date"))).select("id", "repository")


@query("metadata_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY")
def metadata_filter(spark, sf):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-21"))
    return table(spark, sf, "events").filter(F.col("event_type").isin("click", "view") & (F.col("ts") >= low) & (F.col("ts") < high)).select("event_id", "event_type")


@query("any_ts_window", f"""WITH {RECORDS_SQL} SELECT id FROM records WHERE coalesce(published BETWEEN DATE '2024-03-01' AND DATE '2024-03-31', FALSE) OR created BETWEEN DATE '2024-03-01' AND DATE '2024-03-31'""")
def any_ts_window(spark, sf):
    low, high = (F.lit(d).cast("date") for d in ("2024-03-01", "2024-03-31"))
    return records(spark, sf).filter(F.exists(F.array_compact(F.array("published", "created")), lambda x: x.between(low, high))).select("id")


@query("ilike_escape", r"SELECT page_id FROM pages WHERE url ILIKE '%PAGE=2%' ESCAPE '\' OR url ILIKE '%\_%' ESCAPE '\' OR html ILIKE '%50\%%' ESCAPE '\'")
def ilike_escape(spark, sf):
    wanted = ilike(F.col("url"), "PAGE=2") | ilike(F.col("url"), "_") | ilike(F.col("html"), "50%")
    return table(spark, sf, "pages").filter(wanted).select("page_id")


@query("coalesce_not_in", "SELECT doc_id FROM documents WHERE coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END, 'agent_stream') NOT IN ('src1', 'schedule', 'agent_stream')")
def coalesce_not_in(spark, sf):
    source = F.coalesce(F.when(F.col("doc_id") % 4 != 0, F.col("source")), F.lit("agent_stream"))
    return table(spark, sf, "documents").filter(~source.isin("src1", "schedule", "agent_stream")).select("doc_id")


@query("or_match", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'")
def or_match(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_custkey") == 7) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("case_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_totalprice > 200000 THEN 'failed' ELSE 'processing' END AS status FROM orders")
def case_status(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", None).when(F.col("o_totalprice") > 200000, "failed").otherwise("processing").alias("status"))


@query("array_any", f"WITH {RECORDS_SQL} SELECT id FROM records WHERE list_contains(labels, 'kind1')")
def array_any(spark, sf):
    return records(spark, sf).filter(F.array_contains("labels", "kind1")).select("id")


@query("chunk_browse", """SELECT doc_id FROM documents WHERE (source LIKE '%3' OR contains(lower(text), 'the')) ORDER BY doc_id LIMIT 50 OFFSET 20""")
def chunk_browse(spark, sf):
    rows = table(spark, sf, "documents").filter(F.col("source").endswith("3") | F.lower("text").contains("the"))
    return rows.select("doc_id").orderBy("doc_id").offset(20).limit(50)


@query("path_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://m.')")
def path_prefix(spark, sf):
    return table(spark, sf, "pages").filter(F.col("url").startswith("https://m.")).select("page_id")


@query("any_of_contains", "SELECT page_id FROM pages WHERE contains(lower(url), 'fr') OR contains(lower(html), 'lang=\"fr\"')")
def any_of_contains(spark, sf):
    return table(spark, sf, "pages").filter(F.lower("url").contains("fr") | F.lower("html").contains('lang="fr"')).select("page_id")


@query("null_safe_eq", f"WITH {RECORDS_SQL} SELECT id, state IS NOT DISTINCT FROM CASE WHEN id % 2 = 0 THEN 'open' END AS same FROM records")
def null_safe_eq(spark, sf):
    return records(spark, sf).select("id", F.col("state").eqNullSafe(F.when(F.col("id") % 2 == 0, "open")).alias("same"))


@query("excerpt_left", "SELECT doc_id, left(text, 500) AS excerpt FROM documents")
def excerpt_left(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("excerpt"))


@query("coalesce_occurred_at", f"WITH {RECORDS_SQL} SELECT id, strftime(coalesce(published, created), '%Y-%m-%d') AS occurred FROM records")
def coalesce_occurred_at(spark, sf):
    return records(spark, sf).select("id", F.date_format(F.coalesce("published", "created"), "yyyy-MM-dd").alias("occurred"))


_PATHS_SQL = """paths AS (SELECT doc_id, ['README.md', './readme', 'docs/' || source || '/a.rst', 'docs/x.png', '/docs/a.md', 'docs/../a.md', 'src/docs/a.md', 'DOCS/' || lang || '.TXT', 'readme.old.md', 'notreadme.md'][doc_id % 10 + 1] AS path FROM documents)"""


def _paths(spark, sf):
    names = F.array(F.lit("README.md"), F.lit("./readme"), F.concat(F.lit("docs/"), "source", F.lit("/a.rst")), *map(F.lit, ("docs/x.png", "/docs/a.md", "docs/../a.md", "src/docs/a.md")), F.concat(F.lit("DOCS/"), "lang", F.lit(".TXT")), F.lit("readme.old.md"), F.lit("notreadme.md"))
    return table(spark, sf, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 10).cast("int")).alias("path"))


@query("doc_scope_filter", rf"""WITH {_PATHS_SQL} SELECT doc_id, path FROM paths WHERE doc_id % 10 IN (0, 1, 2, 7, 8) AND path IS NOT NULL""")
def doc_scope_filter(spark, sf):
    return _paths(spark, sf).filter(in_document_scope(F.col("path")))


@query("normalize_union", """
SELECT 'document-' || doc_id AS id, source AS repository, 'documentation' AS source_type, text AS title FROM documents
UNION ALL SELECT 'page-' || page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'release', html FROM pages
UNION ALL SELECT 'message-' || conv_id || '-' || turn, role, 'comment', text FROM conversations
UNION ALL SELECT 'benchmark-' || item_id, 'benchmark', 'issue', text FROM benchmark""")
def normalize_union(spark, sf):
    ident = lambda kind, *cs: F.concat_ws("-", F.lit(kind), *(F.col(c).cast("string") for c in cs)).alias("id")
    title = lambda c: F.col(c).alias("title")
    kind = lambda k: F.lit(k).alias("source_type")
    parts = [
        table(spark, sf, "documents").select(ident("document", "doc_id"), F.col("source").alias("repository"), kind("documentation"), title("text")),
        table(spark, sf, "pages").select(ident("page", "page_id"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("repository"), kind("release"), title("html")),
        table(spark, sf, "conversations").select(ident("message", "conv_id", "turn"), F.col("role").alias("repository"), kind("comment"), title("text")),
        table(spark, sf, "benchmark").select(ident("benchmark", "item_id"), F.lit("benchmark").alias("repository"), kind("issue"), title("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Joins.


@query("join_inner_scope", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def join_inner_scope(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    scope = n.join(r.filter("r_name = 'EUROPE'"), n.n_regionkey == r.r_regionkey)
    return o.join(c.join(scope, c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey).select("o_orderkey", "n_name")


@query("left_join_on_filter", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1")
def left_join_on_filter(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.left_on(table(spark, sf, "customer"), o, "c_custkey", F.col("o_orderstatus") == "O").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("left_chain", """SELECT l_orderkey, l_linenumber, o_orderpriority, c_mktsegment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'
LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def left_chain(spark, sf):
    line, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    o, c = o.filter("o_orderstatus <> 'P'"), c.filter("c_acctbal > 0")
    return line.join(o, line.l_orderkey == o.o_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left").select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@query("lateral_latest", """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1""")
def lateral_latest(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return R.lateral_first(c, table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("lateral_priority_match", """
WITH hits AS (SELECT conv_id, 0 AS p, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') UNION ALL
  SELECT conv_id, 1, turn FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the') UNION ALL SELECT conv_id, 2, turn FROM conversations WHERE contains(lower(text), 'la'))
SELECT conv_id, CAST(p AS INTEGER) AS priority, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p, turn) AS rn FROM hits) WHERE rn = 1""")
def lateral_priority_match(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.lower("text"))
    has = lambda w: F.col("text").contains(w)
    return R.first_by_priority([c.filter((F.col("role") == "user") & has("the")), c.filter((F.col("role") == "assistant") & has("the")), c.filter(has("la"))], "conv_id", ["turn"])


@query("explode_labels", f"WITH {RECORDS_SQL} SELECT id, unnest(labels) AS label FROM records")
def explode_labels(spark, sf):
    return records(spark, sf).select("id", F.explode("labels").alias("label"))




@query("or_join_membership", """SELECT DISTINCT label AS cluster, doc_id FROM embeddings JOIN documents ON doc_id = vec_id OR doc_id = vec_id * 2 + 1""")
def or_join_membership(spark, sf):
    members = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.array("vec_id").alias("ids"))
    half = F.when(F.col("doc_id") % 2 == 1, ((F.col("doc_id") - 1) / 2).cast("long"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("own"), half.alias("external"))
    return R.either_key(members, "ids", docs, ["own", "external"], ["doc_id"])


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("anti_join_not_exists", """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1998-01-01')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def anti_join_not_exists(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    late, pending = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")), o.filter("o_orderstatus = 'P'")
    for other in (late, pending):
        c = c.join(other.select(F.col("o_custkey").alias("k")), F.col("c_custkey") == F.col("k"), "left_anti")
    return c.select("c_custkey")


@query("self_anti_twin", """SELECT event_id FROM events e WHERE NOT (event_type = 'view' AND EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.props = e.props))""")
def self_anti_twin(spark, sf):
    e = table(spark, sf, "events")
    twins = e.filter("event_type = 'error'").select("user_id", "props", F.lit("view").alias("event_type")).distinct()
    return e.join(twins, ["user_id", "props", "event_type"], "left_anti").select("event_id")


@query("scalar_subquery_counts", """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS shared FROM nation""")
def scalar_subquery_counts(spark, sf):
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    members = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    shared = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("shared"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.join(members, "n_nationkey", "left").join(shared, "n_nationkey", "left").select("n_nationkey", zero("members"), zero("shared"))


@query("join_version_pointer", """WITH v AS (SELECT l_orderkey, max(l_linenumber) AS current FROM lineitem GROUP BY 1) SELECT l.l_orderkey, l.l_partkey FROM v JOIN lineitem l ON l.l_orderkey = v.l_orderkey AND l.l_linenumber = v.current""")
def join_version_pointer(spark, sf):
    line = table(spark, sf, "lineitem")
    pointer = line.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return line.join(pointer, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey")


@query("join_dim_twice", """SELECT DISTINCT cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey""")
def join_dim_twice(spark, sf):
    line, o, c, s, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    pairs = line.join(o, line.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, line.l_suppkey == s.s_suppkey).select("c_nationkey", "s_nationkey").distinct()
    of = lambda key, name: n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return pairs.join(of("c_nationkey", "customer_nation"), "c_nationkey").join(of("s_nationkey", "supplier_nation"), "s_nationkey").select("customer_nation", "supplier_nation")


@query("exists_any", "SELECT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND value > 90) AS found")
def exists_any(spark, sf):
    found = table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("value") > 90)).limit(1)  # the first that is found ends the scan
    return found.agg((F.count("*") > 0).alias("found"))


# Sets.


@query("timeline_union", """
SELECT 'event-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events WHERE value > 80
UNION ALL SELECT 'order-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderstatus = 'F' THEN 'info' ELSE 'warning' END FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'line-' || l_orderkey || '-' || l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'info' END FROM lineitem WHERE l_quantity > 49""")
def timeline_union(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    ident = lambda kind, *cs: F.concat_ws("-", F.lit(kind), *(F.col(c).cast("string") for c in cs)).alias("id")
    level = lambda c, a, b: F.when(c, a).otherwise(b).alias("level")
    e = table(spark, sf, "events").filter("value > 80").select(ident("event", "event_id"), day("ts"), level(F.col("event_type") == "error", "error", "info"))
    o = table(spark, sf, "orders").filter("o_totalprice > 300000").select(ident("order", "o_orderkey"), day("o_orderdate"), level(F.col("o_orderstatus") == "F", "info", "warning"))
    li = table(spark, sf, "lineitem").filter("l_quantity > 49").select(ident("line", "l_orderkey", "l_linenumber"), day("l_shipdate"), level(F.col("l_returnflag") == "R", "error", "info"))
    return e.unionByName(o).unionByName(li)


@query("union_distinct", "SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def union_distinct(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_partkey").alias("id")).union(line.select("l_suppkey")).distinct()


@query("array_distinct_ordered", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def array_distinct_ordered(spark, sf):
    seen = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "o_orderpriority")))
    return seen.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["o_orderpriority"]), ",").alias("priorities"))


@query("dedupe_prefix200", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY left(text, 200) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_prefix200(spark, sf):
    return R.dedupe_by(table(spark, sf, "documents"), F.substring("text", 1, 200), ["source", "doc_id"], ["doc_id", "source"])


_SNAPSHOTS_SQL = """
old AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, doc_id % 11 <> 0 AS active FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('changed' || coalesce(text, '')) ELSE sha256(coalesce(text, '')) END AS content_hash FROM documents WHERE doc_id % 13 <> 0)"""


def _snapshots(spark, sf):
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents")
    old = d.filter("doc_id % 5 <> 0").select("doc_id", F.sha2(text, 256).alias("content_hash"), (F.col("doc_id") % 11 != 0).alias("active"))
    new = d.filter("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.lit("changed"), text), 256)).otherwise(F.sha2(text, 256)).alias("content_hash"))
    return old, new


@query("file_diff", f"""WITH {_SNAPSHOTS_SQL} SELECT doc_id, 'added' AS change FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old) UNION ALL SELECT doc_id, 'removed' FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def file_diff(spark, sf):
    return R.difference(*_snapshots(spark, sf), "doc_id")


@query("id_set_algebra", """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, list_sort(list_intersect(p, q)) AS both, list_sort(list_filter(p, lambda x: NOT list_contains(q, x))) AS only_first, list_sort(list_distinct(list_concat(p, q))) AS either FROM a JOIN b USING (o_custkey)""")
def id_set_algebra(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("p"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("q"))
    o = o.filter((F.size("p") > 0) & (F.size("q") > 0))
    return o.select("o_custkey", F.sort_array(F.array_intersect("p", "q")).alias("both"), F.sort_array(F.array_except("p", "q")).alias("only_first"), F.sort_array(F.array_union("p", "q")).alias("either"))


# Merges.


@query("upsert_changed", f"""WITH {_SNAPSHOTS_SQL} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.content_hash, o.content_hash) AS content_hash, n.doc_id IS NOT NULL OR coalesce(o.active, FALSE) AS active,
  n.doc_id IS NOT NULL AND (o.doc_id IS NULL OR o.content_hash <> n.content_hash OR NOT o.active) AS changed FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def upsert_changed(spark, sf):
    return R.upsert(*_snapshots(spark, sf), "doc_id").drop("seen")


@query("missing_anti_join", f"WITH {_SNAPSHOTS_SQL} SELECT doc_id FROM old WHERE active AND doc_id NOT IN (SELECT doc_id FROM new)")
def missing_anti_join(spark, sf):
    old, new = _snapshots(spark, sf)
    return old.filter("active").join(new, "doc_id", "left_anti").select("doc_id")


@query("incremental_sync", f"""WITH {_SNAPSHOTS_SQL}, s AS (SELECT doc_id, active, CAST(doc_id % 2 AS BIGINT) AS missing FROM old)
SELECT s.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 0 WHEN active THEN missing + 1 ELSE missing END AS missing, active AND (n.doc_id IS NOT NULL OR missing + 1 < 2) AS active FROM s LEFT JOIN new n ON s.doc_id = n.doc_id""")
def incremental_sync(spark, sf):
    old, new = _snapshots(spark, sf)
    return R.confirm_missing(old.select("doc_id", "active", (F.col("doc_id") % 2).alias("missing")), new, "doc_id")


@query("orphan_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) OR l_suppkey = 1")
def orphan_delete(spark, sf):
    line, p = table(spark, sf, "lineitem"), table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    kept = line.join(p.withColumn("known", F.lit(True)), "l_partkey", "left").filter("known or l_suppkey = 1")
    return kept.select("l_orderkey", "l_linenumber")


@query("null_safe_resume", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 5 END AS attempt, n_chars % 100 AS done FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 10 END AS attempt FROM documents)
SELECT p.doc_id, CASE WHEN p.attempt IS NOT DISTINCT FROM a.attempt THEN p.done ELSE 0 END AS done FROM p JOIN a ON p.doc_id = a.doc_id""")
def null_safe_resume(spark, sf):
    d = table(spark, sf, "documents")
    p = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5).alias("attempt"), (F.col("n_chars") % 100).alias("done"))
    a = d.select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 10).alias("attempt"))
    return R.keep_or_reset(p, a, "doc_id")


@query("index_complete", "SELECT source, count(*) AS total, count(text) AS embedded, count(text) = count(*) AS complete FROM documents GROUP BY 1")
def index_complete(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count("text").alias("embedded"), (F.count("text") == F.count("*")).alias("complete"))


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("cutoff"))
    return e.crossJoin(F.broadcast(newest)).filter("ts >= cutoff").select("event_id")


@query("array_keep_last_n", "SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_orderkey), -3, -1) AS last FROM orders GROUP BY 1")
def array_keep_last_n(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    top = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 3")
    return top.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("last"))


@query("array_append_remove", f"WITH {RECORDS_SQL} SELECT id, list_sort(list_append(list_filter(labels, lambda x: x IS NOT NULL AND x <> 'kind1'), 'pinned')) AS labels FROM records")
def array_append_remove(spark, sf):
    return records(spark, sf).select("id", F.sort_array(F.array_append(F.filter("labels", lambda x: x.isNotNull() & (x != "kind1")), "pinned")).alias("labels"))


@query("graph_node_merge", """
WITH m AS (SELECT l_suppkey AS source_id, lower(l_returnflag) AS normalized_name, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus END AS type, l_linestatus || l_linenumber % 3 AS description FROM lineitem),
d AS (SELECT source_id, normalized_name, description, min(place) AS first FROM m GROUP BY ALL)
SELECT n.*, t.description FROM (SELECT source_id, normalized_name, count(*) AS doc_freq, arg_min(type, place) FILTER (type IS NOT NULL) AS type FROM m GROUP BY 1, 2) n
JOIN (SELECT source_id, normalized_name, string_agg(description, ' ' ORDER BY first) AS description FROM d GROUP BY 1, 2) t USING (source_id, normalized_name)""")
def graph_node_merge(spark, sf):
    mentions = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.lower("l_returnflag").alias("normalized_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("type"), F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("description"),
    )
    return R.merge_nodes(mentions)


@query("sql_passthrough", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def sql_passthrough(spark, sf):
    return spark.sql("SELECT r_name, count(*) AS nations FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY 1", region=table(spark, sf, "region"), nation=table(spark, sf, "nation"))


# Graph.


@query("graph_degree", "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), ends AS (SELECT src, dst, src AS node FROM e UNION SELECT src, dst, dst FROM e) SELECT node, count(*) AS degree FROM ends GROUP BY 1")
def graph_degree(spark, sf):
    from brindle.operators.graph import degrees

    return degrees(edges(spark, sf))


@query("graph_one_hop", "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem) SELECT DISTINCT CASE WHEN src = 's1' THEN dst ELSE src END AS node FROM e WHERE src = 's1' OR dst = 's1'")
def graph_one_hop(spark, sf):
    from brindle.operators.graph import one_hop

    e = edges(spark, sf)
    return one_hop(e, spark.range(1).select(F.lit("s1").alias("node")))


_RING_SQL = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 's' || (l_partkey % 97) AS dst FROM lineitem)"


@query("graph_overview", f"""WITH {_RING_SQL}, n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE dst <> src), t AS (SELECT node FROM n GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 50)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""")
def graph_overview(spark, sf):
    from brindle.operators.graph import overview

    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    e = table(spark, sf, "lineitem").select(node(F.col("l_suppkey")).alias("src"), node(F.col("l_partkey") % 97).alias("dst")).distinct()
    return overview(e, 50)


@query("chunk_rank_by_mass", """WITH m AS (SELECT 's' || l_suppkey AS node, round(sum(l_quantity) / 1000, 9) AS mass FROM lineitem GROUP BY 1) SELECT l_orderkey AS chunk, round(sum(mass), 6) AS score FROM lineitem JOIN m ON node = 's' || l_suppkey GROUP BY 1
ORDER BY score DESC, chunk LIMIT 20""")
def chunk_rank_by_mass(spark, sf):
    from brindle.operators.graph import rank_by_mass

    node = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node")
    line = table(spark, sf, "lineitem")
    mass = line.groupBy(node).agg(F.round(F.sum("l_quantity") / 1000, 9).alias("mass"))
    return rank_by_mass(line.select(F.col("l_orderkey").alias("chunk"), node), mass, 20)


@query("ppr_scores")
def ppr_scores(spark, sf):
    from brindle.operators.graph import damp_hubs, degrees, personalized_pagerank
    from brindle.sources.shared import cut

    seeds = spark.createDataFrame([("s1", 1.0), ("s2", 0.5)], "node string, weight double")
    e = cut(edges(spark, sf), "edges")
    freq = degrees(e).withColumnRenamed("degree", "doc_freq")
    return damp_hubs(personalized_pagerank(e.withColumn("weight", F.lit(1.0)), seeds), freq)


@query("entity_normalize", """SELECT DISTINCT lower(trim(c_name)) AS normalized_name, coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 1.0) AS weight FROM customer WHERE trim(c_name) <> ''""")
def entity_normalize(spark, sf):
    from brindle.operators.graph import normalize_entities

    return normalize_entities(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("weight"))).select("normalized_name", "weight")
