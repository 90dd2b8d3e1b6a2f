"""Redaction in nested JSON against a walk over the parsed value."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from brindle.functions.json_text import REDACTED, SECRET_PARTS, replace_values

KEYS = ["k", "name", "password", "Password", "user_api_key", "prompt_tokens", "token", "TOKEN", "token_budget", "tokens", "secrets", "x-authorization", "passwd", "a\"b", "se\\cret", "bearer:", "é", "", "private_key", "credential{", "[secret]"]
VALUES = ["plain", "", "with \"quotes\" and \\ and , : { } [ ]", "línea\n\tü 日本 😀", "\"password\":1", 0, -1.5e-7, 12345678901234567890, True, False, None]


def value(rng, depth):
    kind = rng.random()
    if depth > 0 and kind < 0.35:
        return {rng.choice(KEYS) + (str(i) if rng.random() < 0.2 else ""): value(rng, depth - 1) for i in range(rng.randrange(5))}
    if depth > 0 and kind < 0.6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(VALUES)


def walk(v):
    if isinstance(v, dict):
        return {k: REDACTED if k.lower() == "token" or any(p in k.lower() for p in SECRET_PARTS) else walk(x) for k, x in v.items()}
    return [walk(x) for x in v] if isinstance(v, list) else v


def redacted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return [r["t"] for r in df.select("i", replace_values(F.col("text")).alias("t")).orderBy("i").collect()]


def test_random_documents(spark):
    rng = random.Random(4)
    values = [value(rng, rng.randrange(6)) for _ in range(400)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]), separators=rng.choice([None, (",", ":"), (" , ", " : ")])) for v in values]
    for text, v, got in zip(texts, values, redacted(spark, texts)):
        assert json.loads(got) == walk(v), text
        if walk(v) == v:
            assert got == text


def test_lists_objects_and_escaped_keys(spark):
    texts = ['{"secrets":["a","b"],"password":{"x":"hid","y":"den"}}', '{"p\\u0061ssword" : [ {"k" : 1} ] , "k":2}', '{"prompt_tokens":3,"token_budget":4,"token":null}', None, "", "[]", "no json, password: x", '{"password":"cut off', '{"secret":[{"a":"b"}']
    want = ['{"secrets":"[REDACTED]","password":"[REDACTED]"}', '{"p\\u0061ssword" : "[REDACTED]" , "k":2}', '{"prompt_tokens":3,"token_budget":4,"token":"[REDACTED]"}', None, "", "[]", "no json, password: x", '{"password":"[REDACTED]"', '{"secret":"[REDACTED]"']
    assert redacted(spark, texts) == want


def test_long_strings_and_many_secrets(spark):
    escapes = json.dumps({"body": "\"\\" * 50_000, "password": "\\\"" * 50_000, "rest": "x" * 200_000})
    many = json.dumps([{"password": i, "k": i} for i in range(3000)])
    got = redacted(spark, [escapes, many])
    assert json.loads(got[0]) == {"body": "\"\\" * 50_000, "password": REDACTED, "rest": "x" * 200_000}
    assert json.loads(got[1]) == [{"password": REDACTED, "k": i} for i in range(3000)]
