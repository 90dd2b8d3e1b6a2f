"""Cuts of a text in bytes of UTF-8; a character that a cut tears is left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _goes_on(data: Column, at: Column) -> Column:
    """Whether the byte at a place (from 0) continues a character; behind the end it does not."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")


def floor_boundary(data: Column, at: Column) -> Column:
    """The last place not behind ``at`` where a character begins (or the data ends)."""
    back = at - 3
    for k in (2, 1, 0):
        back = F.when(_goes_on(data, at - k), back).otherwise(at - k)
    return back


def ceiling_boundary(data: Column, at: Column) -> Column:
    """The first place not before ``at`` where a character begins (or the data ends)."""
    ahead = at + 3
    for k in (2, 1, 0):
        ahead = F.when(_goes_on(data, at + k), ahead).otherwise(at + k)
    return ahead


def _part(data: Column, begin: Column, end: Column) -> Column:
    return F.decode(F.substring(data, begin + 1, end - begin), "UTF-8")


def head_tail(text: Column, most: int) -> Column:
    """A text of more than ``most`` bytes: half of them from either end around a line that says how many are missing. Without a limit (0 or less), the text."""
    if most <= 0:
        return text
    data, size = F.encode(text, "UTF-8"), F.octet_length(text)
    head = most // 2
    first = _part(data, F.lit(0), floor_boundary(data, F.lit(head)))
    last = _part(data, ceiling_boundary(data, size - (most - head)), size)
    between = F.concat(F.lit("\n\n...[truncated "), (size - most).cast("string"), F.lit(" bytes]...\n\n"))
    return F.when(size <= most, text).otherwise(F.concat(first, between, last))


def head_lines(text: Column, most: int) -> Column:
    """At most ``most`` bytes, up to the end of the last whole line, if that leaves more than half of them; else up to the last whole character."""
    data = F.encode(text, "UTF-8")
    head = _part(data, F.lit(0), floor_boundary(data, F.lit(most)))
    torn = F.substring_index(head, "\n", -1)
    lines = F.octet_length(head) - F.octet_length(torn)
    return F.when(F.octet_length(text) <= most, text).when(lines - 1 > most // 2, _part(data, F.lit(0), lines)).otherwise(head)
