"""JSON as text: a structural pass that changes values and leaves all else as it stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a key a credential (a part of it, or all of it; case aside), and what stands for its value.
SECRET_PARTS = (
    "api_key", "apikey", "api_token", "access_token", "refresh_token", "auth_token", "id_token", "session_token",
    "secret", "password", "passwd", "passphrase", "private_key", "credential", "authorization", "bearer",
)
SECRET_WHOLE = ("token",)
REDACTED = "[REDACTED]"

#: An escaped character, a stretch of others that mean nothing to the structure, or one that does. No part repeats
#: a group, so a match needs no stack, however long a string is.
_TOKEN = r'(?s)\\.|[^\\"{}\[\],:]+|.'


def is_secret(key: Column) -> Column:
    """Whether a key names a credential; counts of tokens (prompt_tokens, token_budget) do not."""
    k = F.lower(key)
    return k.isin(*SECRET_WHOLE) | reduce(lambda a, b: a | b, (k.contains(p) for p in SECRET_PARTS))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used in a function of every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_values(text: Column, secret=is_secret, marker: str = REDACTED) -> Column:
    """A JSON text in which the whole value of every key that ``secret`` picks is ``marker``, however deep either lies.

    The text falls into tokens; a fold over them knows the depth, whether it is within a string, and the last
    string, which is a key if a colon follows. What it yields is the stretches of tokens to be replaced, few as a rule, from which
    the text is put together once. Keys count as what their escapes stand for. White space and the order of keys
    stay; a value that is not closed is replaced up to the end; null stays null, and a text without objects is returned as it is.
    """
    ranges = "array<struct<first:int,last:int>>"
    # depth; opened: first token of the string at hand or the last one, closed: its last; since: first token of a value that goes
    start = F.struct(*(F.lit(v).alias(c) for c, v in (("i", 0), ("depth", 0), ("opened", -1), ("closed", -1), ("since", -1), ("level", 0))), F.lit(False).alias("inside"), F.lit(False).alias("armed"), F.array().cast(ranges).alias("out"))

    def of(tokens: Column) -> Column:
        def step(s: Column, t: Column) -> Column:
            quote, blank = t == '"', F.trim(F.translate(t, "\t\r\n", "   ")) == ""
            inside = s["inside"] != quote
            free = ~s["inside"] & ~quote
            depth = s["depth"] + F.when(free & t.isin("{", "["), 1).when(free & t.isin("}", "]"), -1).otherwise(0)
            begins = s["armed"] & ~blank
            since = F.when(begins, s["i"]).otherwise(s["since"])
            level = F.when(begins, s["depth"]).otherwise(s["level"])
            ends = (since >= 0) & (depth <= level) & ~inside
            plain = s["since"] < 0
            key = F.array_join(F.slice(tokens, s["opened"] + 2, F.greatest(s["closed"] - s["opened"] - 1, F.lit(0))), "")
            key = F.when(key.contains("\\"), F.coalesce(F.get_json_object(F.concat(F.lit('{"k":"'), key, F.lit('"}')), "$.k"), key)).otherwise(key)
            asked = plain & ~begins & free & (t == ":") & (s["closed"] > s["opened"])
            return F.struct(
                (s["i"] + 1).alias("i"), depth.alias("depth"), F.when(plain & quote & ~s["inside"], s["i"]).otherwise(s["opened"]).alias("opened"), F.when(plain & quote & s["inside"], s["i"]).otherwise(s["closed"]).alias("closed"),
                F.when(ends, -1).otherwise(since).alias("since"), level.alias("level"), inside.alias("inside"), F.when(asked, secret(key)).otherwise(s["armed"] & blank).alias("armed"),
                F.when(ends, F.concat(s["out"], F.array(F.struct(since.alias("first"), s["i"].alias("last"))))).otherwise(s["out"]).alias("out"),
            )

        def finish(s: Column) -> Column:
            return F.when(s["since"] >= 0, F.concat(s["out"], F.array(F.struct(s["since"].alias("first"), (s["i"] - 1).alias("last"))))).otherwise(s["out"])

        def joined(found: Column) -> Column:
            behind = lambda i: F.when(i > 0, F.element_at(found, F.greatest(i, F.lit(1)))["last"]).otherwise(-1)  # noqa: E731  last token of the stretch before
            pieces = F.transform(found, lambda r, i: F.concat(F.array_join(F.slice(tokens, behind(i) + 2, r["first"] - behind(i) - 1), ""), F.lit(f'"{marker}"')))
            last = F.element_at(found, -1)["last"]
            return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.array_join(F.slice(tokens, last + 2, F.size(tokens)), "")))

        return _let(F.aggregate(tokens, start, step, finish), joined)

    return F.when(text.isNotNull(), _let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), of))
