"""JSON schemas as column expressions, against a plain validator written for the test."""

from __future__ import annotations

import json
import random
import re

import pytest

from boundarylens.operators import schemas

DEFS = {"place": {"type": "object", "required": ["file"], "properties": {"file": {"type": "string"}, "step": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
SCHEMA = {
    "$schema": "x", "title": "a chain", "type": "object", "required": ["version", "facts", "where"],
    "properties": {
        "version": {"enum": ["0.2.0", "0.3.0", 3, None]}, "kind": {"const": True}, "where": {"type": "array", "items": {"$ref": "#/$defs/place"}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "facts": {"type": "object", "additionalProperties": {"enum": ["true", "false", "unknown"]}}, "at": {"type": "string", "format": "date"}, "n": {"type": ["number", "null"], "maximum": 10, "exclusiveMinimum": -2},
        "any": {"anyOf": [{"type": "string", "maxLength": 3}, {"type": "integer"}]}, "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "no": {"not": {"type": "string"}}, "a'b c": {"type": "boolean"},
    },
    "additionalProperties": False, "allOf": [{"if": {"properties": {"version": {"const": "0.3.0"}}, "required": ["version"]}, "then": {"required": ["at"]}, "else": {"required": ["n"]}}], "$defs": DEFS,
}


def is_a(x, t):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "number": number, "integer": number and x % 1 == 0}[t]


def plain(x, s, path=""):
    if isinstance(s, bool):
        return [] if s else [(path, "nothing allowed")]
    if "$ref" in s:
        return plain(x, DEFS[s["$ref"].split("/")[-1]], path)
    out = []
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    if types and not any(is_a(x, t) for t in types):
        out.append((path, "type: " + ", ".join(types)))
    if "enum" in s and not any(same(x, v) for v in s["enum"]):
        out.append((path, "enum"))
    if "const" in s and not same(x, s["const"]):
        out.append((path, "const"))
    if isinstance(x, dict):
        out += [(path, f"required: {k}") for k in s.get("required", []) if k not in x]
        for k, v in x.items():
            if k in s.get("properties", {}):
                out += plain(v, s["properties"][k], f"{path}/{k}")
            elif s.get("additionalProperties") is False:
                out.append((f"{path}/{k}", "additionalProperties"))
            elif isinstance(s.get("additionalProperties"), dict):
                out += plain(v, s["additionalProperties"], f"{path}/{k}")
    if isinstance(x, list):
        if "items" in s:
            out += [f for i, v in enumerate(x) for f in plain(v, s["items"], f"{path}/{i}")]
        out += [(path, k) for k, bad in (("minItems", len(x) < s.get("minItems", 0)), ("maxItems", len(x) > s.get("maxItems", 99)), ("uniqueItems", s.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in x}) < len(x))) if bad]
    if isinstance(x, str):
        out += [(path, "maxLength")] if len(x) > s.get("maxLength", 99) else []
        out += [(path, "format: date")] if s.get("format") == "date" and not re.match(r"^\d{4}-\d{2}-\d{2}$", x) else []
    if is_a(x, "number"):
        out += [(path, k) for k, bad in (("minimum", x < s.get("minimum", -99)), ("maximum", x > s.get("maximum", 99)), ("exclusiveMinimum", x <= s.get("exclusiveMinimum", -99))) if bad]
    for part in s.get("allOf", []):
        out += plain(x, part, path)
    fits = lambda parts: sum(not plain(x, p, path) for p in parts)
    if "anyOf" in s and not fits(s["anyOf"]):
        out.append((path, "anyOf"))
    if "oneOf" in s and fits(s["oneOf"]) != 1:
        out.append((path, "oneOf"))
    if "not" in s and not plain(x, s["not"], path):
        out.append((path, "not"))
    if "if" in s:
        out += plain(x, s.get("else" if plain(x, s["if"], path) else "then", True), path)
    return out


def some_document(r):
    value = lambda: r.choice([None, True, False, 0, -3, 2.5, 3.0, 11, "a", "long text", "0.3.0", [], {}, ["x"], {"k": 1}])
    place = lambda: {k: v for k, v in (("file", r.choice(["f", "g", 3])), ("step", r.choice([0, 2, -1, 1.5, "1"])), ("more", 1)) if r.random() < (0.9 if k != "more" else 0.1)}
    document = {
        "version": r.choice(["0.2.0", "0.3.0", "0.3.0", 3, None, "9"]), "facts": {k: r.choice(["true", "false", "unknown", "maybe", True]) for k in r.sample("abc", 2)}, "where": [place() for _ in range(r.randrange(5))],
        "at": r.choice(["2026-01-02", "soon"]), "n": r.choice([1, 10, 11, -2, None, "1"]), "kind": r.choice([True, False]), "any": value(), "one": value(), "no": value(), "a'b c": r.choice([True, "true"]), "surplus/x": 1,
    }
    return r.choice([value(), document, document, document, document]) if r.random() < 0.3 else {k: v if r.random() < 0.9 else value() for k, v in document.items() if r.random() < (0.85 if k != "surplus/x" else 0.1)}


def test_faults_equal_a_plain_validator(spark):
    r = random.Random(12)
    documents = [some_document(r) for _ in range(300)]
    documents += [{"version": "0.3.0", "facts": {"a": "true"}, "where": [{"file": "f", "step": 2.0}], "at": "2026-01-02", "one": 2.5, "any": "abc"}, {"version": 3, "facts": {}, "where": [{"file": "f"}, {"file": "g"}], "n": None}]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)] + [(-1, "{"), (-2, None), (-3, "")]
    got = sorted(tuple(x) for x in schemas.violations(spark.createDataFrame(rows, "id int, document string"), SCHEMA).collect())
    wanted = sorted([(i, *f) for i, d in enumerate(documents) for f in plain(d, SCHEMA)] + [(i, "", "no JSON") for i in (-1, -2, -3)])
    assert got == wanted
    assert len({f[2] for f in got}) > 15 and any(not plain(d, SCHEMA) for d in documents)


def test_schemas_that_are_refused():
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="dependentRequired"):
        schemas.schema_faults(F.lit(None), {"dependentRequired": {}})
    with pytest.raises(ValueError, match="refers to itself"):
        schemas.schema_faults(F.lit(None), {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}})
