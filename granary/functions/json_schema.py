"""A subset of JSON Schema over texts, compiled to columns on Variant, and a canonical form with its hash.

``breaches(text, schema)`` gives every place that breaks the schema as (path, rule); a schema is read once, when the plan
is built, and rows see built-in functions only. Known keywords: type, enum, const, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, minLength, maxLength, pattern (ECMA patterns that Java reads alike), required, properties,
additionalProperties (false or a schema), items, minItems, maxItems, uniqueItems, anyOf. Others stop the compilation, but
for title, description and $schema, which say nothing about values. Lengths count code points; a number without a
fraction is an integer, and true is not 1.

A null text has no value and no breach; a text that is no JSON, or repeats a key of an object, breaks the rule "json" at $.
Paths are $.name, $["other name"] and $[3]; arrays are walked whole.

The canonical form has the keys of every object in order, no spaces, and plain numbers without trailing zeros (1.50 as
1.5, 1.0 as 1). A number with an exponent is a double and spelled as one (1e2 as 100.0), so it has another hash than 100;
enum, const and uniqueItems take the two as equal. Keys are ordered by UTF-16 units, which is code point order below
U+10000.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
#: What schema_of_variant says of each type.
_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "number": _NUMBER}
_SILENT = {"title", "description", "$schema", "$id", "default", "examples"}
_KNOWN = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "anyOf"}
_NONE = "cast(array() as array<struct<path:string,rule:string>>)"


def _seen(value: Column, schema: dict | bool, path: Column) -> Column:
    """Breaches of a value; the value and its shape are computed once for a row, however often the rules name them."""
    pair = F.struct(value.alias("v"), F.schema_of_variant(value).alias("shape"))
    return F.get(F.transform(F.array(pair), lambda x: _joined(_check(x, schema, path))), F.lit(0))


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _canonical(value: Column) -> Column:
    return F.to_json(value)


def _form(value: Column) -> Column:
    """What equal values share: the canonical form, with whole doubles spelled as integers."""
    x = _as(value, "double")
    whole = F.schema_of_variant(value).isin("DOUBLE", "FLOAT") & (x == F.floor(x)) & (F.abs(x) < 2.0**53)
    return F.when(whole, x.cast("long").cast("string")).otherwise(_canonical(value))


def _is(value: Column, name: str) -> Column:
    shape = value["shape"]
    if name == "integer":
        number = _as(value["v"], "double")
        return F.when(shape.rlike(_NUMBER), number == F.floor(number)).otherwise(False)
    if name not in _TYPES:
        raise ValueError(f"no such type: {name}")
    return shape.rlike(_TYPES[name])


def _step(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}" if re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]*", name) else f"[{json.dumps(name, ensure_ascii=False)}]"))


def _check(value: Column, schema: dict | bool, path: Column) -> list[Column]:
    """Arrays of breaches of a value (v) of a shape, which is there."""
    if isinstance(schema, bool):
        return [] if schema else [F.array(F.struct(path.alias("path"), F.lit("false").alias("rule")))]
    unknown = schema.keys() - _KNOWN - _SILENT
    if unknown:
        raise ValueError(f"keywords that are not known: {sorted(unknown)}")
    none = F.expr(_NONE)

    def breach(bad: Column, rule: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(none)

    out = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out.append(breach(~reduce(Column.__or__, [_is(value, n) for n in names]), "type"))
    for word, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            out.append(breach(~_form(value["v"]).isin([_spelled(x) for x in allowed]), word))
    number, text = F.when(_is(value, "number"), _as(value["v"], "double")), F.when(_is(value, "string"), _as(value["v"], "string"))
    for word, bad in {"minimum": Column.__lt__, "maximum": Column.__gt__, "exclusiveMinimum": Column.__le__, "exclusiveMaximum": Column.__ge__}.items():
        if word in schema:
            out.append(breach(bad(number, F.lit(float(schema[word]))), word))
    if "minLength" in schema:
        out.append(breach(F.char_length(text) < schema["minLength"], "minLength"))
    if "maxLength" in schema:
        out.append(breach(F.char_length(text) > schema["maxLength"], "maxLength"))
    if "pattern" in schema:
        out.append(breach(~text.rlike(schema["pattern"]), "pattern"))
    out += _check_object(value, schema, path, breach) + _check_array(value, schema, path, breach)
    if "anyOf" in schema:
        fits = [F.size(_joined(_check(value, s, path))) == 0 for s in schema["anyOf"]]
        out.append(breach(~reduce(Column.__or__, fits), "anyOf"))
    return out


def _check_object(value: Column, schema: dict, path: Column, breach) -> list[Column]:
    if not schema.keys() & {"required", "properties", "additionalProperties"}:
        return []
    members = F.when(_is(value, "object"), _as(value["v"], "map<string,variant>"))
    names, out, none = F.map_keys(members), [], F.expr(_NONE)
    out += [breach(~F.array_contains(names, n), f"required:{n}") for n in schema.get("required", [])]
    for name, inner in schema.get("properties", {}).items():
        found = _seen(F.element_at(members, name), inner, _step(path, name))
        out.append(F.when(F.coalesce(F.array_contains(names, name), F.lit(False)), found).otherwise(none))
    rest = schema.get("additionalProperties", True)
    if rest is not True:
        named = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        others = F.map_filter(members, lambda k, _: ~F.array_contains(named, k))
        if rest is False:
            out.append(F.coalesce(F.transform(F.array_sort(F.map_keys(others)), lambda k: F.struct(path.alias("path"), F.concat(F.lit("additional:"), k).alias("rule"))), none))
        else:
            each = F.transform(F.map_entries(others), lambda e: _seen(e["value"], rest, F.concat(path, F.lit("."), e["key"])))
            out.append(F.coalesce(F.flatten(each), none))
    return out


def _check_array(value: Column, schema: dict, path: Column, breach) -> list[Column]:
    if not schema.keys() & {"items", "minItems", "maxItems", "uniqueItems"}:
        return []
    elements, out = F.when(_is(value, "array"), _as(value["v"], "array<variant>")), []
    if "minItems" in schema:
        out.append(breach((F.size(elements) < schema["minItems"]) & elements.isNotNull(), "minItems"))
    if "maxItems" in schema:
        out.append(breach(F.size(elements) > schema["maxItems"], "maxItems"))
    if schema.get("uniqueItems"):
        spelled = F.transform(elements, _form)
        out.append(breach(F.size(F.array_distinct(spelled)) < F.size(spelled), "uniqueItems"))
    if "items" in schema:
        each = F.transform(elements, lambda x, i: _seen(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.coalesce(F.flatten(each), F.expr(_NONE)))
    return out


def _joined(found: list[Column]) -> Column:
    return F.concat(*found) if found else F.expr(_NONE)


def _spelled(value) -> str:
    """A value of the schema as the canonical form spells it."""

    def whole(x):
        if isinstance(x, float) and x.is_integer():
            return int(x)
        return [whole(y) for y in x] if isinstance(x, list) else {k: whole(y) for k, y in x.items()} if isinstance(x, dict) else x

    value = whole(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def breaches(text: Column, schema: dict) -> Column:
    """Array of (path, rule) for a JSON text; empty if it keeps the schema."""
    value = F.try_parse_json(text)
    wrong = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))
    return F.when(text.isNull(), F.expr(_NONE)).when(value.isNull(), wrong).otherwise(_seen(value, schema, F.lit("$")))


def canonical(text: Column) -> Column:
    """The canonical form of a JSON text; null if it is none or repeats a key."""
    return _canonical(F.try_parse_json(text))


def canonical_sha256(text: Column) -> Column:
    """Lowercase hex sha256 of the canonical form."""
    return F.sha2(canonical(text).cast("binary"), 256)
