"""The schema subset against a plain checker, and the canonical form against the standard library."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import json_schema

SCHEMA = {
    "title": "of no effect",
    "type": ["object", "array"],
    "required": ["a", "no such"],
    "properties": {
        "a": {"type": "integer", "minimum": 2, "exclusiveMaximum": 100},
        "b": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^[a-z\U0001f600]+$"},
        "c d": {"items": {"type": "object", "properties": {"x": {"enum": [1, "1", None, 1.5, [1]]}}, "additionalProperties": False}, "minItems": 1, "maxItems": 2, "uniqueItems": True},
        "e": {"anyOf": [{"type": "boolean"}, {"type": "number", "maximum": 0}]},
        "never": False,
    },
    "additionalProperties": {"type": "number", "exclusiveMinimum": 0},
    "items": {"const": {"k": 1}},
}


def kind(v, name):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}[name]


def same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or (kind(a, "number") and kind(b, "number") and a == b)


def plain(v, s, path="$"):
    if isinstance(s, bool):
        return [] if s else [(path, "false")]
    out, number, text = [], kind(v, "number"), isinstance(v, str)
    tests = {
        "type": lambda w: any(kind(v, n) for n in ([w] if isinstance(w, str) else w)), "enum": lambda w: any(same(v, x) for x in w), "const": lambda w: same(v, w),
        "minimum": lambda w: not number or v >= w, "exclusiveMinimum": lambda w: not number or v > w, "maximum": lambda w: not number or v <= w, "exclusiveMaximum": lambda w: not number or v < w,
        "minLength": lambda w: not text or len(v) >= w, "maxLength": lambda w: not text or len(v) <= w, "pattern": lambda w: not text or re.search(w, v),
        "minItems": lambda w: not isinstance(v, list) or len(v) >= w, "maxItems": lambda w: not isinstance(v, list) or len(v) <= w,
        "uniqueItems": lambda w: not isinstance(v, list) or not any(same(x, y) for i, x in enumerate(v) for y in v[:i]), "anyOf": lambda w: any(not plain(v, x) for x in w),
    }
    out += [(path, word) for word, test in tests.items() if word in s and not test(s[word])]
    if isinstance(v, dict):
        out += [(path, f"required:{n}") for n in s.get("required", []) if n not in v]
        known, rest = s.get("properties", {}), s.get("additionalProperties", True)
        for k, x in v.items():
            at = f"{path}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) or k not in known else f"{path}[{json.dumps(k)}]"
            out += plain(x, known[k], at) if k in known else [(path, f"additional:{k}")] if rest is False else plain(x, rest, at)
    if isinstance(v, list):
        out += [b for i, x in enumerate(v) for b in plain(x, s.get("items", True), f"{path}[{i}]")]
    return out


def test_against_a_plain_checker(spark):
    rng = np.random.default_rng(3)
    leaves = [0, 1, 2, 99, 100, -3, 1.5, 2.0, 100.5, True, False, None, "", "a", "ab", "abcd", "A1", "\U0001f600", "1", [], {}, [1], {"k": 1}, {"k": 2}]

    def value(depth):
        if depth == 0 or rng.random() < 0.3:
            return leaves[rng.integers(len(leaves))]
        if rng.random() < 0.3:
            return [value(depth - 1) for _ in range(rng.integers(0, 4))]
        return {k: value(depth - 1) for k in rng.choice(["a", "b", "c d", "e", "x", "never", "other"], rng.integers(0, 6), replace=False).tolist()}

    inner = lambda: [{"x": leaves[rng.integers(len(leaves))]} for _ in range(rng.integers(0, 4))]
    values = [value(2) for _ in range(400)] + [{"a": 5, "c d": inner()} for _ in range(150)] + [{"a": 5, "b": x} for x in leaves]
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, values))), "i int, t string")
    got = {r["i"]: sorted((b["path"], b["rule"]) for b in r["b"]) for r in rows.select("i", json_schema.breaches(F.col("t"), SCHEMA).alias("b")).collect()}
    for i, v in enumerate(values):
        assert got[i] == sorted(plain(v, SCHEMA)), v
    seen = {rule.split(":")[0] for b in got.values() for _, rule in b}
    assert seen >= {"type", "required", "minimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "enum", "const", "anyOf", "additional", "exclusiveMinimum", "false"}


def test_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, '{"a": 1, "a": 2}'), (3, "{"), (4, "1e2"), (5, "100")], "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["b"]] for r in rows.select("i", json_schema.breaches(F.col("t"), {"type": "integer", "enum": [100]}).alias("b")).collect()}
    assert got == {0: [], 1: [("$", "json")], 2: [("$", "json")], 3: [("$", "json")], 4: [], 5: []}
    assert rows.limit(0).select(json_schema.breaches(F.col("t"), SCHEMA)).count() == 0
    for bad in ({"$ref": "#"}, {"type": "date"}):
        with pytest.raises(ValueError):
            json_schema.breaches(F.col("t"), bad)


def test_canonical_form(spark):
    texts = ['{"b": 1.50, "a": [1, true, null, "x\\u00e9/\\n"]}', '{"a":[1,true,null,"xé/\\n"],"b":1.5}', '{"z": {"y": 1, "x": []}, "Z": "", "10": 0, "9": {}}', "[]", '"\U0001f600"']
    rows = [r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(json_schema.canonical(F.col("t")).alias("c")).collect()]
    assert rows == [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts] and rows[0] == rows[1]
