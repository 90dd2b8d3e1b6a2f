"""Scans: Parquet tables, directories of files, CSV and JSON as text rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import cell_to_text
from brindle.sources.shared import cut


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table under ``root``; filters and columns are pushed down by the reader."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), hidden: bool = False, limit: int | None = None) -> DataFrame:
    """path, extension, text of every file below ``path``; hidden files, those in hidden folders and unwanted extensions are left out.

    ``limit`` takes the first by path.
    """
    below = r"^.*?\Q" + path.rstrip("/").split(":", 1)[-1].lstrip("/") + r"/\E"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("content").cast("string").alias("text"), name.alias("name"))
    if extensions:
        rows = rows.filter(F.col("extension").isin(*(e.lower().lstrip(".") for e in extensions)))
    if not hidden:
        rows = rows.filter(~F.regexp_replace("path", below, "").rlike(r"(^|/)\.[^/]"))
    rows = rows.drop("name")
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def csv_rows(spark: SparkSession, path: str, separator: str = ", ") -> DataFrame:
    """Every CSV row as one text: its cells joined; the header names the columns."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(F.concat_ws(separator, *(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns)).alias("text"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """One text per item of JSON files; an object counts as a list of one."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(F.to_json(F.struct("*")).alias("text"))


def rows_to_text(df: DataFrame, columns: list[str], separator: str = ", ") -> DataFrame:
    """Rendered cells joined into ``text``."""
    types = dict(df.dtypes)
    return df.select("*", F.concat_ws(separator, *(cell_to_text(F.col(c), types[c]) for c in columns)).alias("text"))


def with_header(index: Column, header: Column, text: Column, period: int = 20) -> Column:
    """The text, with the header above it on every ``period``-th row."""
    return F.when(index % period == 0, F.concat(header, F.lit("\n"), text)).otherwise(text)


def openapi_paths(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per path of an OpenAPI document: path and its JSON."""
    paths = F.from_json(F.get_json_object(column, "$.paths"), "map<string,string>")
    return docs.select("*", F.explode(paths).alias("path", "operations"))


def sitemap_urls(docs: DataFrame, column: str = "text", limit: int | None = None) -> DataFrame:
    """The urls of sitemaps, one a row; index files list further sitemaps as is_index. ``limit`` takes the first by url."""
    locs = F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    rows = docs.select(F.explode(locs).alias("url"), F.col(column).contains("<sitemapindex").alias("is_index"))
    return rows.orderBy("url").limit(limit) if limit is not None else rows


def expand_sitemaps(roots: DataFrame, fetched: DataFrame, limit: int | None = None, depth: int = 5) -> DataFrame:
    """url: the pages that sitemaps list, those of index files' sitemaps too, as far as ``fetched`` (url, text) holds them.

    An index that names itself or another that was seen adds nothing; ``depth`` levels of indexes are followed.
    """
    seen = level = roots.select("url").distinct()
    pages = None
    for _ in range(depth + 1):
        found = sitemap_urls(fetched.join(level, "url", "left_semi"))
        own = found.filter(~F.col("is_index")).select("url")
        pages = own if pages is None else pages.unionByName(own)
        level = cut(found.filter("is_index").select("url").distinct().join(seen, "url", "left_anti"), "sitemaps")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    pages = pages.distinct()
    return pages.orderBy("url").limit(limit) if limit is not None else pages


#: Suffixes by how their files are read; others are plain text.
SUFFIXES = {"md": "markdown", "mdx": "markdown", "rst": "rst", "html": "html", "htm": "html", "csv": "csv", "json": "json", "jsonl": "lines"}


def mixed(spark: SparkSession, path: str, suffixes: dict[str, str] | None = None) -> DataFrame:
    """path, part, text: every file below ``path`` by its suffix, whatever is in the folder.

    Markdown and reStructuredText give a text a section (under its heading), HTML its visible text, CSV a text a row (cells joined),
    JSON one an item, JSON lines one a line, anything else the whole file. Suffixes may be added or read otherwise.
    """
    from brindle.functions.text import html_visible_text
    from brindle.operators.chunking import markdown_sections, rst_sections

    kinds = SUFFIXES | (suffixes or {})
    files = directory(spark, path).withColumn("kind", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("extension")), F.lit("plain")))
    some = lambda kind: files.filter(F.col("kind") == kind)
    headed = F.concat_ws("\n", F.nullif("header", F.lit("")), F.nullif("text", F.lit("")))
    sections = lambda kind, split: split(some(kind).withColumnRenamed("path", "doc_id")).select(F.col("doc_id").alias("path"), "part", headed.alias("text"))
    whole = lambda kind, text: some(kind).select("path", F.lit(0).alias("part"), text.alias("text"))
    each = lambda kind, parts: some(kind).select("path", F.posexplode(parts).alias("part", "text"))
    items = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    rows = F.filter(F.split("text", r"\r?\n"), lambda line: line != "")
    cells = F.transform(rows, lambda line: F.array_join(F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))), ", "))
    parts = [
        sections("markdown", markdown_sections), sections("rst", rst_sections), whole("html", html_visible_text(F.col("text"))), each("csv", cells), each("json", items), each("lines", rows), whole("plain", F.col("text")),
    ]
    return reduce(DataFrame.unionByName, parts)


def issues(raw: DataFrame, since: str, until: str, limit: int = 1000) -> DataFrame:
    """Issues (no pull requests) created or updated within the window, both ends included; the first ``limit`` by id (the limit is the feature)."""
    low, high = (F.lit(x).cast("timestamp") for x in (since, until))
    inside = lambda c: F.coalesce(F.col(c).cast("timestamp").between(low, high), F.lit(False))
    return raw.filter(F.col("pull_request").isNull() & (inside("created_at") | inside("updated_at"))).orderBy("id").limit(max(limit, 0))


def text_files(files: DataFrame, extensions: tuple[str, ...], skip: tuple[str, ...] = (), column: str = "path") -> DataFrame:
    """Repository paths worth reading: one of the extensions, below none of the skipped folders."""
    wanted = F.lower(column).rlike(r"\.(?:" + "|".join(extensions) + ")$")
    unwanted = F.col(column).rlike("(?:^|/)(?:" + "|".join(skip) + ")/") if skip else F.lit(False)
    return files.filter(wanted & ~unwanted)


def releases(raw: DataFrame, since: str, until: str) -> DataFrame:
    """Releases published or created within the window, both ends included; a missing time is none."""
    low, high = (F.lit(x).cast("timestamp") for x in (since, until))
    inside = lambda c: F.coalesce(F.col(c).cast("timestamp").between(low, high), F.lit(False))
    return raw.filter(inside("published_at") | inside("created_at"))
