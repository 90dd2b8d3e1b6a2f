"""Entity graphs from what was extracted of chunks: nodes merged by name, relations resolved, each chunk applied once.

A graph is four tables: nodes (source_id, node, normalized_name, name, type, description, doc_freq, degree), edges (source_id, src, dst, type,
description, weight, chunk), links (source_id, node, chunk) and progress (source_id, chunk, status). A node's id follows from
its source and its name in lower case, so relations find their nodes without a look-up, and a lost task makes the same ids again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import cut

_KEY = ["source_id", "normalized_name"]
_ENTITY = "array<struct<name:string,type:string,description:string>>"
_RELATION = "array<struct<source:string,target:string,type:string,description:string,weight:string>>"


def empty_graph(spark: SparkSession, source: str = "string", chunk: str = "long") -> dict[str, DataFrame]:
    """A graph without anything in it."""
    kinds = {
        "nodes": f"source_id {source}, node string, normalized_name string, name string, type string, description string, doc_freq long, degree long",
        "edges": f"source_id {source}, src string, dst string, type string, description string, weight double, chunk {chunk}",
        "links": f"source_id {source}, node string, chunk {chunk}", "progress": f"source_id {source}, chunk {chunk}, status string",
    }
    return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}


def node_id(source: Column, normalized: Column) -> Column:
    return F.sha1(F.concat(F.coalesce(source.cast("string"), F.lit("")), F.lit("\u0000"), normalized).cast("binary"))


def clean(name: Column) -> Column:
    """Without white space at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(name, r"^\s+|\s+$", ""), F.lit(""))


def weight_of(weight: Column) -> Column:
    """A number; what is none, and 0, is 1."""
    number = weight.try_cast("double")
    return F.when(number != 0, number).otherwise(1.0)


def _extended(said: Column, more: Column) -> Column:
    """What was said and, in order, what of the rest it does not hold yet."""
    add = lambda acc, d: F.when(F.contains(acc, d), acc).when(acc == "", d).otherwise(F.concat(acc, F.lit(" "), d))
    return F.nullif(F.aggregate(more, F.coalesce(said, F.lit("")), add), F.lit(""))


def apply_chunks(graph: dict[str, DataFrame], extracted: DataFrame) -> dict[str, DataFrame]:
    """The graph after the extractions (source_id, chunk, entities, relationships) of some chunks.

    A chunk that is done is left out, however often it is sent; one whose lists are null has failed, adds nothing and may come
    again. Nameless entities and relations without an end are dropped. Every mention of an entity adds 1 to its ``doc_freq`` and so does a chunk
    that names it only in a relation, without a link to the chunk; the first type stays, descriptions are put together
    unless they are there. Chunks are merged in order of their ids. Degrees grow by the new edges alone (a loop counts once).
    """
    known = graph["progress"].filter("status = 'done'").select("source_id", "chunk").distinct()
    typed = extracted.select("source_id", "chunk", F.col("entities").cast(_ENTITY).alias("entities"), F.col("relationships").cast(_RELATION).alias("relationships")).filter("chunk is not null")
    once = typed.groupBy("source_id", "chunk").agg(F.min(F.struct("entities", "relationships")).alias("x")).select("source_id", "chunk", "x.*")
    fresh = cut(once.join(known, ["source_id", "chunk"], "left_anti"), "chunks")
    good = fresh.filter("entities is not null and relationships is not null")

    named = good.select("source_id", "chunk", F.posexplode("entities").alias("at", "e")).select("source_id", "chunk", F.lit(0).alias("part"), "at", clean(F.col("e.name")).alias("name"), F.nullif("e.type", F.lit("")).alias("type"), F.nullif("e.description", F.lit("")).alias("description")).filter("name is not null")
    named = named.withColumn("normalized_name", F.lower("name"))
    relations = good.select("source_id", "chunk", F.posexplode("relationships").alias("at", "r")).select("source_id", "chunk", "at", clean(F.col("r.source")).alias("source"), clean(F.col("r.target")).alias("target"), F.nullif("r.type", F.lit("")).alias("type"), F.nullif("r.description", F.lit("")).alias("description"), weight_of(F.col("r.weight")).alias("weight"))
    whole = cut(relations.filter("source is not null and target is not null"), "relations")
    # an end that is no entity of its chunk is a node too, once a chunk; either end counts, even where the other one is missing
    ends = relations.select("source_id", "chunk", F.posexplode(F.array("source", "target")).alias("side", "name"), (F.col("at") * 2).alias("at")).filter("name is not null").withColumn("normalized_name", F.lower("name")).withColumn("at", F.col("at") + F.col("side"))
    ends = ends.join(named.select("source_id", "chunk", "normalized_name").distinct(), ["source_id", "chunk", "normalized_name"], "left_anti").groupBy("source_id", "chunk", "normalized_name").agg(F.min(F.struct("at", "name")).alias("x"))
    ends = ends.select("source_id", "chunk", F.lit(1).alias("part"), F.col("x.at").alias("at"), F.col("x.name").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description"), "normalized_name")
    mentions = cut(named.unionByName(ends), "mentions")

    place = F.struct("chunk", "part", "at")
    same = mentions.groupBy(*_KEY, "description").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.min(F.when(F.col("type").isNotNull(), F.struct("chunk", "part", "at", "type"))).alias("t"), F.min(F.struct("chunk", "part", "at", "name")).alias("m"))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("description").isNotNull(), F.struct("place", "description")))), lambda x: x["description"])
    found = same.groupBy(*_KEY).agg(F.sum("n").alias("_n"), F.min("t").alias("_t"), F.min("m").alias("_m"), said.alias("_said"))

    new_edges = whole.select("source_id", node_id(F.col("source_id"), F.lower("source")).alias("src"), node_id(F.col("source_id"), F.lower("target")).alias("dst"), "type", "description", "weight", "chunk")
    grown = new_edges.select("source_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("source_id", "node").agg(F.count("*").alias("_degree"))
    joined = graph["nodes"].join(found, _KEY, "full").withColumn("node", F.coalesce("node", node_id(F.col("source_id"), F.col("normalized_name")))).join(grown, ["source_id", "node"], "left")
    zero = F.lit(0).cast("long")
    nodes = joined.select(
        "source_id", "node", "normalized_name", F.coalesce("name", "_m.name").alias("name"), F.coalesce(F.nullif("type", F.lit("")), "_t.type").alias("type"),
        F.when(F.col("_said").isNull(), F.col("description")).otherwise(_extended(F.col("description"), F.col("_said"))).alias("description"),
        (F.coalesce("doc_freq", zero) + F.coalesce("_n", zero)).alias("doc_freq"), (F.coalesce("degree", zero) + F.coalesce("_degree", zero)).alias("degree"),
    )
    links = named.select("source_id", node_id(F.col("source_id"), F.col("normalized_name")).alias("node"), "chunk").distinct()
    status = fresh.select("source_id", "chunk", F.when(F.col("entities").isNotNull() & F.col("relationships").isNotNull(), "done").otherwise("failed").alias("status"))
    earlier = graph["progress"].join(status.select("source_id", "chunk"), ["source_id", "chunk"], "left_anti")
    return {
        "nodes": cut(nodes, "nodes"), "edges": cut(graph["edges"].unionByName(new_edges), "edges"), "links": cut(graph["links"].unionByName(links).distinct(), "links"),
        "progress": cut(earlier.unionByName(status), "progress"),
    }
