"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def excerpt(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def cell_to_text(value: Column, kind: str) -> Column:
    """A table cell as text: nothing for null and NaN, whole doubles without a fraction, no NUL characters."""
    if kind in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(value.isNull() | F.isnan(value), "").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    if kind == "date":
        return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.coalesce(drop_nul(value.cast("string")), F.lit(""))


def drop_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def content_hash(body: Column, metadata: Column) -> Column:
    """sha256 of the trimmed body, a line break and canonical JSON."""
    return F.sha2(F.concat(F.trim(body), F.lit("\n"), metadata), 256)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_visible_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles, templates, comments or tags; basic entities decoded; white space folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|title)\b[^>]*>.*?</(script|style|noscript|template|title)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[\x20\t\r\n\f]+", " "))


def html_to_markdown(html: Column) -> Column:
    """Headings, emphasis, links, list items and paragraphs as Markdown; data URIs dropped, blank lines folded."""
    md = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|title)\b[^>]*>.*?</(script|style|noscript|template|title)>|<!--.*?-->", "")
    md = F.regexp_replace(md, r"(?is)<img\b[^>]*\bsrc=[\"']data:[^>]*>", "")
    for level in range(1, 7):
        md = F.regexp_replace(md, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    md = F.regexp_replace(md, r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    md = F.regexp_replace(md, r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "*$1*")
    md = F.regexp_replace(md, r"(?is)<a\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    md = F.regexp_replace(md, r"(?is)<li\b[^>]*>", "\n- ")
    md = F.regexp_replace(md, r"(?is)</p>|<p\b[^>]*>|</?(?:div|article|section|ul|ol|table|tr|nav|header|footer)\b[^>]*>|<br\s*/?>", "\n\n")
    md = F.regexp_replace(md, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        md = F.replace(md, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(md, r"\n\s*\n\s*(?:\n\s*)+|\n[ \t]*\n", "\n\n"), r"^[\x20\t\r\n]+|[\x20\t\r\n]+$", "")


def cut_at_line(text: Column, n: int) -> Column:
    """At most ``n`` characters, without the line that the cut tears (if there is a whole one)."""
    head = F.substring(text, 1, n)
    whole = F.regexp_replace(head, r"[^\n]*\z", "")  # $ would also stand before a line break at the end
    return F.when(F.length(text) <= n, text).when(whole == "", head).otherwise(whole)


def markdown_plain(text: Column) -> Column:
    """Links become their label, embedded images go."""
    return F.regexp_replace(F.regexp_replace(text, r"\[(.*?)\]\((.*?)\)", "$1"), r"!\[\[(.*)\]\]", "")


def rst_clean(text: Column) -> Column:
    """Images, link targets, directives, roles, grid rules, white-space and character runs."""
    for pattern, by in (
        (r"\.\. image:: (.*)", ""), (r"`(.*?) <(.*?)>`_", "$1"), (r"`\.\.([^:]+)::", ""), (r":([A-Za-z0-9_]+):", ""),
        (r"(?m)^\+[-]+\+[-]+\+$", ""), (r"[\x20\t\r\n\f]{2,}", "  "),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


def fold_character_runs(text: Column) -> Column:
    """Runs of one character longer than three become three."""
    return F.regexp_replace(text, r"([^\x20\t\r\n\f\x0B])\1{2,}", "$1$1$1")


def first_h1(text: Column, otherwise: Column) -> Column:
    """The first Markdown heading of level one, else a fallback."""
    found = F.regexp_extract(text, r"(?m)^[\x20\t]{0,3}#[\x20\t]+(.+?)[\x20\t]*#*[\x20\t]*$", 1)
    return F.when(found != "", found).otherwise(otherwise)


def approx_tokens(text: Column, chars: int = 4) -> Column:
    """ceil(length / chars), none for an empty text."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(chars)).cast("int")


def approx_token_split(text: Column, max_tokens: int, chars: int = 4) -> Column:
    """Consecutive pieces of at most ``max_tokens`` approximate tokens; they join to the text again."""
    size = max(1, max_tokens) * chars
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def truncate_middle(text: Column, n: int, marker: str = "\n...\n") -> Column:
    """The first and the last two fifths of ``n`` characters around a marker, where the text is longer than ``n``."""
    side = n * 2 // 5
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, side), F.lit(marker), F.substring(text, -side, side)))


def truncate_head_tail(text: Column, n: int) -> Column:
    """Half of the budget from either end."""
    half = n // 2
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, half), F.substring(text, -half, half)))


def page_select(text: Column, pages: list[int]) -> Column:
    """The pages (from 1, as form feeds part them) that are asked for, in that order, repeats kept, missing ones left out."""
    parts = F.split(text, "\f")
    return F.array_join(F.filter(F.array(*(F.get(parts, F.lit(p - 1)) for p in pages)), lambda x: x.isNotNull()), "\f")


def parse_pages(spec: str, limit: int = 10_000) -> list[int]:
    """1-3,5 as [1, 2, 3, 5]; order and repeats are kept."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
        if len(out) > limit:
            raise ValueError(f"more than {limit} pages")
    return out


def url_to_path(url: Column) -> Column:
    """host and path of a url as a file path; a folder's page is index."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    return F.concat(host, F.lit("/"), F.when(path == "", "index").otherwise(path), F.lit(".md"))


def match_snippet(text: Column, term: str, radius: int = 60) -> Column:
    """The first match with ``radius`` characters around it; null without a match."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(term) + radius))


def json_in_text(text: Column, schema: str) -> Column:
    """The first to the last brace of a text, parsed; null if it is no JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def ilike(text: Column, term: Column | str) -> Column:
    """True where the text holds the term, whatever the case; % and _ in the term stand for themselves."""
    pattern = F.regexp_replace(F.lit(term) if isinstance(term, str) else term, r"([\\%_])", r"\\$1")
    return F.call_function("ilike", text, F.concat(F.lit("%"), pattern, F.lit("%")))


def utc(text: Column) -> Column:
    """An ISO-8601 text as a timestamp, one without a zone as UTC; null if it is none. The session's zone must be UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))


def iso_z(at: Column) -> Column:
    """A timestamp as ISO-8601 in UTC, ending in Z, microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("Z"))


def label_names(labels: Column) -> Column:
    """Names of a JSON list of labels, each an object with a name or a string; empty ones go, and what is no list has none."""
    items = F.from_json(labels, "array<string>")
    name = lambda x: F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    return F.coalesce(F.filter(F.transform(items, name), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def in_document_scope(path: Column, extensions: tuple[str, ...] = ("md", "mdx", "rst", "txt")) -> Column:
    """True for a README at the root or a text file below docs/; paths that are absolute or climb are not."""
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    ends = "|".join(extensions)
    fine = ~p.rlike(r"^/|(?:^|/)\.\.(?:/|$)")
    return F.coalesce(fine & p.rlike(rf"(?i)^readme(?:\.(?:[^/]*\.)?(?:{ends}))?$|^docs/(?:.*/)?[^/]+\.(?:{ends})$"), F.lit(False))


def is_html_url(url: Column, host: str = "github.com") -> Column:
    """True for an https url of the host itself."""
    return F.coalesce(F.lower(url).rlike(rf"^https://{host.replace('.', '[.]')}(?:[/?#]|$)"), F.lit(False))


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def repository_slug(text: Column) -> Column:
    """owner/name of a repository url or slug, lower case; null if it is neither."""
    found = F.regexp_extract(F.lower(F.trim(text)), r"^(?:https?://github\.com/)?([a-z0-9_.-]+/[a-z0-9_.-]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)


def label_of(title: Column, filename: Column, source: Column) -> Column:
    """Title, else file name, else the last part of the source."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(title), filled(basename(filename)), filled(basename(source)), F.lit("unknown"))


def collapse(text: Column) -> Column:
    """Lower case, white space folded to one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\t\r\n\f]+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stream_id_key(stream_id: Column) -> Column:
    """An ``ms-seq`` id as a pair of numbers that compares in order."""
    parts = F.split(stream_id, "-")
    return F.struct(F.get(parts, F.lit(0)).cast("long").alias("ms"), F.coalesce(F.get(parts, F.lit(1)).cast("long"), F.lit(0)).alias("seq"))
