"""Tables drawn with dots or spaces become Markdown tables; chunks with overlapping ends are joined."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.aggregates import reassemble

# What makes a row. A numeric cell (money, percentages, negative numbers in brackets, a dash for none),
# a label with dot leaders before its values, and a label before values that begin at a digit, a dollar sign or a bracket.
NUMBER = r"(?:\$*\(?-?\d[\d,.]*\)?%?|—)"
LEADER = r"^(.*?)\s*\.{3,}\s*(.+)$"
TRAILING = r"^(.*?[^\s\d,.])\s+([\d$(].*)$"


#: Where a line stands in a table.
OUTSIDE, FIRST, INNER, LAST, ONLY = range(5)


def _places(widths: list[int], min_rows: int) -> list[int]:
    """Of each line its place in a table, by the numbers of its values (0 for what is no row)."""
    found: list[int] = []
    for is_row, run in groupby(widths, bool):
        own = list(run)
        if is_row and len(own) >= min_rows and len(set(own)) == 1:
            found += [FIRST, *[INNER] * (len(own) - 2), LAST] if len(own) > 1 else [ONLY]
        else:
            found += [OUTSIDE] * len(own)
    return found


def tableize(docs: DataFrame, min_rows: int = 3) -> DataFrame:
    """doc_id, text: runs of at least ``min_rows`` lines that are a label and equally many numbers become tables.

    A line with dot leaders needs one number, another one two. Runs are islands of consecutive lines
    within a document, found within its row, so nothing is shuffled or sorted; everything else stays as it is. A null text stays null.
    """

    def parsed(raw):
        bare = F.trim(raw)
        leader = bare.rlike(LEADER)
        of = lambda group: F.when(leader, F.regexp_extract(bare, LEADER, group)).otherwise(F.regexp_extract(bare, TRAILING, group))
        values = F.split(F.trim(F.regexp_replace(of(2), r"\$\s+", r"\$")), r"\s+")
        return F.struct(raw.alias("raw"), leader.alias("leader"), F.regexp_replace(of(1), r"^[ .]+|[ .]+$", "").alias("label"), values.alias("values"))

    def width(x):
        ok = (x["label"] != "") & ~x["label"].rlike(f"^{NUMBER}$") & F.forall(x["values"], lambda v: v.rlike(f"^{NUMBER}$")) & (x["leader"] | (F.size(x["values"]) >= 2))
        return F.when(ok, F.size(x["values"])).otherwise(0)

    def out(x, place):
        n = F.size(x["values"]) + 1
        cells = F.concat(F.lit("| "), F.array_join(F.concat(F.array(F.replace(x["label"], F.lit("|"), F.lit("\\|"))), x["values"]), " | "), F.lit(" |"))
        head = F.concat(F.lit("\n|"), F.repeat(F.lit("   |"), n), F.lit("\n|"), F.repeat(F.lit(" --- |"), n), F.lit("\n"))
        row = F.concat(F.when(place.isin(FIRST, ONLY), head).otherwise(F.lit("")), cells, F.when(place.isin(LAST, ONLY), F.lit("\n")).otherwise(F.lit("")))
        return F.when(place == OUTSIDE, x["raw"]).otherwise(row)

    places = F.arrow_udf(lambda widths: pa.array([_places(w, min_rows) for w in widths.to_pylist()], pa.list_(pa.int32())), "array<int>")
    lines = docs.filter("text is not null").select("doc_id", F.transform(F.split("text", "\n"), parsed).alias("lines"))
    marked = lines.select("doc_id", "lines", places(F.transform("lines", width)).alias("places"))
    done = marked.select("doc_id", F.array_join(F.zip_with("lines", "places", out), "\n").alias("text"))
    return done.unionByName(docs.filter("text is null").select("doc_id", "text"))


def overlap(before: str, text: str, least: int = 32) -> int:
    """The longest beginning of ``text``, of at least so many characters, that ``before`` ends with."""
    start = text[:least]
    at = before.find(start, max(0, len(before) - len(text))) if len(start) == least else -1
    while at >= 0:
        if text.startswith(before[at:]):
            return len(before) - at
        at = before.find(start, at + 1)
    return 0


def join_chunks(chunks: DataFrame, key: str, order: str, text: str, least: int = 32) -> DataFrame:
    """key, page: the chunks of each key in order, two line breaks between, without what repeats the end of the one before.

    Chunks stream through a task sorted; it holds one chunk at a time.
    """

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = None, ""
        for batch in batches:
            out = []
            for k, t in zip(batch[key].to_pylist(), batch[text].to_pylist()):
                t = t or ""
                if k != current:
                    current, before = k, ""
                t = t[overlap(before, t, least) :]
                before = t or before
                out.append(t or None)
            yield pa.RecordBatch.from_arrays([batch[key], batch[order], pa.array(out, pa.string())], names=[key, order, text])

    rows = chunks.select(key, order, text)
    trimmed = rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(trim, rows.schema)
    return reassemble(trimmed.filter(F.col(text).isNotNull()).withColumn("hint", F.lit(0)), key, "hint", order, text, "\n\n")
