"""Documents against a JSON schema: the schema becomes one column expression over VARIANT that gives all faults of a document."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path: string, rule: string>>"
#: Keywords that say nothing about validity.
NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"}


def schema_faults(document: Column, schema: dict | bool) -> Column:
    """An array of (path, rule): what a document (VARIANT) breaks. Paths are JSON pointers, the empty one is the document.

    Known are the keywords of types, objects, arrays, strings and numbers, enum and const, references to $defs, and allOf, anyOf, oneOf, not, if-then-else; any
    other keyword is an error, as is a definition that refers to itself. Missing members are only faults where they are required; a null document has the fault `no JSON`.
    """
    return F.when(document.isNull(), _one(F.lit(""), "no JSON")).otherwise(_check(document, F.lit(""), schema, schema, ()))


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _none() -> Column:
    return F.array().cast(FAULT)


def _types(v: Column) -> dict[str, Column]:
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": number, "integer": (kind == "BIGINT") | (number & (F.try_variant_get(v, "$", "double") % 1 == 0)),
    }


def _check(v: Column, path: Column, schema: dict | bool, root: dict | bool, within: tuple[str, ...]) -> Column:
    """The faults of one value, as an expression; `within` are the references on the way here."""
    if isinstance(schema, bool):
        return _none() if schema else _one(path, "nothing allowed")
    types = _types(v)
    sub = lambda value, at, part: _check(value, at, part, root, within)
    fails = lambda part: F.size(sub(v, path, part)) > 0
    if_bad = lambda bad, rule: F.when(F.coalesce(bad, F.lit(False)), _one(path, rule)).otherwise(_none())
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    of_string = lambda bad, rule: if_bad(types["string"] & bad, rule)
    of_number = lambda bad, rule: if_bad(types["number"] & bad, rule)
    of_array = lambda bad, rule: if_bad(types["array"] & bad, rule)
    in_object = lambda faults: F.when(types["object"], faults).otherwise(_none())
    named = schema.get("properties", {})
    at = lambda k: F.concat(path, F.lit("/"), k)

    def reference(name: str) -> Column:
        if name in within:
            raise ValueError(f"a definition that refers to itself: {name}")
        part = root
        for key in name.removeprefix("#/").split("/"):
            part = part[key]
        return _check(v, path, part, root, (*within, name))

    def required(names: list[str]) -> Column:
        gone = F.array_except(F.array(*map(F.lit, names)), F.map_keys(members)) if names else F.array().cast("array<string>")
        return in_object(F.transform(gone, lambda k: F.struct(path.alias("path"), F.concat(F.lit("required: "), k).alias("rule"))))

    def properties(parts: dict) -> Column:
        each = [F.when(F.array_contains(F.map_keys(members), k), sub(members[k], at(F.lit(k)), part)).otherwise(_none()) for k, part in parts.items()]
        return in_object(F.concat(*each)) if each else _none()

    def additional(part: dict | bool) -> Column:
        known = F.array(*map(F.lit, named)).cast("array<string>")
        if part is False:
            return in_object(F.transform(F.array_except(F.map_keys(members), known), lambda k: F.struct(at(k).alias("path"), F.lit("additionalProperties").alias("rule"))))
        rest = F.filter(F.map_entries(members), lambda e: ~F.array_contains(known, e["key"]))
        return in_object(F.flatten(F.transform(rest, lambda e: sub(e["value"], at(e["key"]), part))))

    def every(part: dict | bool) -> Column:
        return F.when(types["array"], F.flatten(F.transform(items, lambda x, i: sub(x, at(i.cast("string")), part)))).otherwise(_none())

    def matching(parts: list) -> Column:
        return sum((F.when(fails(p), 0).otherwise(1) for p in parts), F.lit(0))

    one_of = lambda values: F.to_json(v).isin(*[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in values])
    rules: dict[str, Callable[[object], Column]] = {
        "$ref": reference,
        "type": lambda t: if_bad(~_any([types[x] for x in ([t] if isinstance(t, str) else t)]), f"type: {t if isinstance(t, str) else ', '.join(t)}"),
        "enum": lambda values: if_bad(~one_of(values), "enum"),
        "const": lambda value: if_bad(~one_of([value]), "const"),
        "required": required, "properties": properties, "additionalProperties": additional, "items": every,
        "minItems": lambda n: of_array(F.size(items) < n, "minItems"), "maxItems": lambda n: of_array(F.size(items) > n, "maxItems"),
        "uniqueItems": lambda wanted: of_array(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), "uniqueItems") if wanted else _none(),
        "minLength": lambda n: of_string(F.length(text) < n, "minLength"), "maxLength": lambda n: of_string(F.length(text) > n, "maxLength"),
        "pattern": lambda p: of_string(~text.rlike(p), "pattern"), "format": lambda f: of_string(~text.rlike(FORMATS[f]), f"format: {f}") if f in FORMATS else _none(),
        "minimum": lambda n: of_number(number < n, "minimum"), "maximum": lambda n: of_number(number > n, "maximum"),
        "exclusiveMinimum": lambda n: of_number(number <= n, "exclusiveMinimum"), "exclusiveMaximum": lambda n: of_number(number >= n, "exclusiveMaximum"),
        "allOf": lambda parts: F.concat(*[sub(v, path, p) for p in parts]),
        "anyOf": lambda parts: if_bad(matching(parts) == 0, "anyOf"), "oneOf": lambda parts: if_bad(matching(parts) != 1, "oneOf"),
        "not": lambda part: if_bad(~fails(part), "not"),
        "if": lambda part: F.when(fails(part), sub(v, path, schema.get("else", True))).otherwise(sub(v, path, schema.get("then", True))),
        "then": lambda _: _none(), "else": lambda _: _none(),
    }
    unknown = set(schema) - set(rules) - NOTES
    if unknown:
        raise ValueError(f"keywords of the schema that are not known: {', '.join(sorted(unknown))}")
    found = [rules[k](x) for k, x in schema.items() if k in rules and k not in ("then", "else")]
    return F.concat(*found) if found else _none()


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def violations(documents: DataFrame, schema: dict | bool, *, key: str = "id", text: str = "document") -> DataFrame:
    """key, path, rule: a row for each fault of each JSON text."""
    faults = schema_faults(F.try_parse_json(F.col(text)), schema)
    return documents.select(F.col(key), F.inline(faults))
