"""Contexts of requests: maps from a field's name to a JSON literal, such as ``"work"``, ``5`` or ``true``.

Literals keep their kind, so a boolean never equals a number, and numbers compare by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(literal: Column) -> Column:
    return F.when(literal.startswith('"'), "string").when(literal.isin("true", "false"), "boolean").when(literal.rlike("^-?[0-9]+$"), "integer").otherwise("number")


def number(literal: Column) -> Column:
    return F.when(kind(literal).isin("integer", "number"), literal.try_cast("double"))


def string(literal: Column) -> Column:
    """The text of a string literal, null for other kinds."""
    return F.when(literal.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v"))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(number(a) == number(b), a == b)


def has(context: Column, field: Column) -> Column:
    return F.coalesce(F.map_contains_key(context, field), F.lit(False))


def matches(condition: Column, context: Column) -> Column:
    """A condition struct (field, operator, values); a missing value fails all operators but ``absent``."""
    there, operator = has(context, condition["field"]), condition["operator"]
    value = F.try_element_at(context, condition["field"])
    hit = F.coalesce(F.exists(condition["values"], lambda v: same(value, v)), F.lit(False))
    return F.when(operator == "present", there).when(operator == "absent", ~there).otherwise(there & F.when(operator.isin("not_equals", "not_in"), ~hit).otherwise(hit))


def valid(field: Column, literal: Column) -> Column:
    """Whether a literal has the kind, one of the allowed values and the bounds that a field asks for."""
    k, text, n = kind(literal), string(literal), number(literal)
    asked = field["kind"]
    fits = (
        F.when(asked == "string", k == "string")
        .when(asked == "identifier", F.coalesce(text.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$") & (F.char_length(text) <= 80), F.lit(False)))
        .when(asked == "date", F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False)))
        .when(asked == "number", k.isin("integer", "number"))
        .otherwise(k == asked)
    )
    listed = (F.coalesce(F.size(field["allowed"]), F.lit(0)) <= 0) | F.exists(field["allowed"], lambda v: same(literal, v))
    low = F.coalesce(n >= field["minimum"], F.lit(True)) & F.coalesce(n <= field["maximum"], F.lit(True))
    long = F.coalesce(F.char_length(text) >= field["min_length"], F.lit(True)) & F.coalesce(F.char_length(text) <= field["max_length"], F.lit(True))
    return fits & F.coalesce(listed, F.lit(False)) & low & long


def consistent(rule: Column, context: Column) -> Column:
    """A rule struct (left_field, operator, right_field) on two values; true where one is missing, false for an order of unlike kinds."""
    a, b = F.try_element_at(context, rule["left_field"]), F.try_element_at(context, rule["right_field"])
    operator = rule["operator"]
    order = F.when(number(a).isNotNull() & number(b).isNotNull(), F.signum(number(a) - number(b)))
    order = order.when(kind(a) == kind(b), F.when(a < b, -1.0).when(a > b, 1.0).otherwise(0.0))
    met = (
        F.when(operator == "equals", same(a, b)).when(operator == "not_equals", ~same(a, b))
        .when(operator == "lt", order < 0).when(operator == "lte", order <= 0).when(operator == "gt", order > 0).when(operator == "gte", order >= 0)
    )
    return F.when(a.isNull() | b.isNull(), F.lit(True)).otherwise(F.coalesce(met, F.lit(False)))


def violated(context: Column, fields: Column, consistency: Column) -> Column:
    """Whether a context holds an undeclared or invalid value or breaks a consistency rule."""
    bad = F.exists(F.map_entries(context), lambda e: ~F.exists(fields, lambda f: (f["name"] == e["key"]) & valid(f, e["value"])))
    return F.coalesce(bad, F.lit(False)) | F.coalesce(F.exists(consistency, lambda r: ~consistent(r, context)), F.lit(False))


def missing(context: Column, fields: Column, conditional: Column) -> Column:
    """Names of required fields that the context lacks, those that conditions ask for too, sorted."""
    always = F.transform(F.filter(fields, lambda f: f["required"] & ~has(context, f["name"])), lambda f: f["name"])
    asked = F.filter(conditional, lambda c: F.forall(c["when"], lambda w: matches(w, context)))
    then = F.flatten(F.transform(asked, lambda c: F.filter(c["required_fields"], lambda n: ~has(context, n))))
    none = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.concat(F.coalesce(always, none), F.coalesce(then, none))))
