"""Documents made of orders, some of them with faults, against a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundarylens.operators import schemas as J
from boundarylens.plans.queries import register_on
from boundarylens.sources.binding import table

SCHEMA = {
    "type": "object",
    "required": ["id", "status", "customer", "tags"],
    "properties": {
        "id": {"type": "string", "pattern": "^o-[0-9]+$"}, "status": {"enum": ["F", "O"]}, "customer": {"$ref": "#/$defs/customer"}, "total": {"type": "number", "minimum": 20000},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}}, "note": {"type": ["string", "null"]},
    },
    "additionalProperties": False,
    "allOf": [{"if": {"properties": {"status": {"const": "O"}}, "required": ["status"]}, "then": {"required": ["note"]}}],
    "$defs": {"customer": {"type": "object", "required": ["key"], "properties": {"key": {"type": "integer"}}, "additionalProperties": {"type": "string"}}},
}
_DOCUMENT = """concat('{"id":"', CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE concat('o-', o_orderkey) END, '","status":"', o_orderstatus, '"',
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(',"customer":{"key":', o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN '.5' ELSE '' END, CASE WHEN o_orderkey % 19 = 0 THEN ',"more":1' ELSE ',"more":"1"' END, '}') END,
  ',"total":', cast(floor(o_totalprice) AS bigint), ',"tags":["', substring(o_orderpriority, 1, 1), '","', substring(o_orderpriority, 3), '",', CASE WHEN o_orderkey % 13 = 0 THEN '7' ELSE '"ok"' END, ']',
  CASE o_orderkey % 3 WHEN 0 THEN ',"note":null' WHEN 1 THEN ',"note":"n"' ELSE '' END, CASE WHEN o_orderkey % 17 = 0 THEN ',"extra":{}' ELSE '' END, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '}' END)"""


@register_on("op_t4_schema_faults", "", """WITH o AS (SELECT *, o_orderkey AS id FROM orders WHERE o_orderkey % 101 <> 0)
SELECT o_orderkey AS id, '' AS path, 'no JSON' AS rule FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT id, '/id', 'pattern' FROM o WHERE id % 7 = 0
UNION ALL SELECT id, '/status', 'enum' FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT id, '', 'required: customer' FROM o WHERE id % 5 = 0
UNION ALL SELECT id, '/customer/key', 'type: integer' FROM o WHERE id % 5 <> 0 AND id % 11 = 0
UNION ALL SELECT id, '/customer/more', 'type: string' FROM o WHERE id % 5 <> 0 AND id % 19 = 0
UNION ALL SELECT id, '/total', 'minimum' FROM o WHERE floor(o_totalprice) < 20000
UNION ALL SELECT id, '/tags/0', 'minLength' FROM o
UNION ALL SELECT id, '/tags/2', 'type: string' FROM o WHERE id % 13 = 0
UNION ALL SELECT id, '/extra', 'additionalProperties' FROM o WHERE id % 17 = 0
UNION ALL SELECT id, '', 'required: note' FROM o WHERE o_orderstatus = 'O' AND id % 3 = 2""")
def _(spark, sf_dir):
    return J.violations(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_DOCUMENT).alias("document")), SCHEMA)
