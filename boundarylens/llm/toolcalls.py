"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are joined by conversation and identifier, ordered so that every call stands after
all that it names as predecessors, checked against the schemas of the tools, and written as canonical
JSON: keys sorted, no spaces. There is one row per call and different result, so neither a conversation
nor the results of one identifier are ever gathered in one place. A call's order is the longest way to it:
ways through calls with one predecessor are shortened by pointer doubling, in a logarithm of their length;
what is left are the calls with several, which are solved level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.llm.common import durable
from boundarylens.operators.schemas import schema_faults

#: tool -> argument -> (JSON type, required), or tool -> JSON schema of its arguments
Schemas = dict[str, dict]
_TYPES = {
    "string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "null": ("VOID",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"), "object": ("OBJECT",), "array": ("ARRAY",),
}


def _flat_errors(parsed: Column, arguments: Column, wanted: dict[str, tuple[str, bool]]) -> Column:
    no, checks = F.array().cast("array<string>"), []
    for argument, (kind, required) in wanted.items():
        value = F.try_variant_get(parsed, f"$['{argument}']", "variant")
        fits = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1).isin(*_TYPES[kind])
        missing = F.lit(f"{argument}: missing") if required else F.lit(None).cast("string")
        checks.append(F.when(value.isNull(), missing).when(~fits, F.lit(f"{argument}: not {kind}")))
    unknown = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(a) for a in wanted])), lambda k: F.concat(k, F.lit(": unknown")))
    return F.concat(F.filter(F.array(*checks), lambda e: e.isNotNull()) if checks else no, F.coalesce(unknown, no))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, sorted: an array of strings, empty for a valid call.

    A tool's arguments are told by name, type and whether they are required, or by a JSON schema, which
    may be nested; its errors are the path in the arguments, if any, and the rule that is broken.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, wanted in schemas.items():
        if all(isinstance(v, tuple) for v in wanted.values()):
            errors = _flat_errors(parsed, arguments, wanted)
        else:
            errors = F.transform(schema_faults(parsed, wanted), lambda f: F.trim(F.concat_ws(" ", f.path, f.rule)))
        out = F.when(name == tool, F.when(~is_object, F.array(F.lit("not a JSON object"))).otherwise(F.array_sort(errors))).otherwise(out)
    return out


def _depths(calls: DataFrame) -> DataFrame:
    """conv, id, depth: the longest way from a call without predecessors; null for calls in a circle or behind one.

    calls: conv, id, after (array of ids); a predecessor that is no call of the conversation holds nobody up. Rounds: a logarithm of
    the calls, and then as many as calls with several predecessors stand one behind the other.
    """
    asked = calls.select("conv", "id", F.explode(F.array_distinct("after")).alias("up"))
    edges = durable(asked.join(calls.select("conv", F.col("id").alias("up")), ["conv", "up"]), "calls-edges")
    ups = durable(edges.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("n_up"), F.min("up").alias("up")), "calls-ups")
    one = F.coalesce(F.col("n_up") == 1, F.lit(False))
    # Every call points to the one it follows; those without one, or with several, are ends.
    step = durable(calls.select("conv", "id").join(ups, ["conv", "id"], "left").select(
        "conv", "id", F.when(one, F.col("up")).otherwise(F.col("id")).alias("top"), F.when(one, 1).otherwise(0).cast("long").alias("dist"), (~one).alias("ended")
    ), "calls-depth")
    rounds, n = 0, step.count()
    while 2**rounds <= n and not step.where("NOT ended").isEmpty():
        above = step.select("conv", F.col("id").alias("top"), F.col("top").alias("top2"), F.col("dist").alias("more"), F.col("ended").alias("ended2"))
        moved = step.where("NOT ended").join(above, ["conv", "top"]).select("conv", "id", F.col("top2").alias("top"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ended2").alias("ended"))
        step = durable(step.where("ended").unionByName(moved), "calls-depth")
        rounds += 1
    joints = ups.where("n_up > 1").select("conv", "id")
    if joints.isEmpty():
        return step.select("conv", "id", F.when(F.col("ended"), F.col("dist")).alias("depth"))
    solved = _joint_depths(edges.join(joints, ["conv", "id"], "left_semi"), step, joints)
    behind = step.join(solved.select("conv", F.col("id").alias("top"), "base", F.lit(True).alias("joint")), ["conv", "top"], "left")
    return behind.select("conv", "id", F.when(F.col("ended"), F.col("dist") + F.when(F.col("joint"), F.col("base")).otherwise(F.lit(0))).alias("depth"))


def _joint_depths(edges: DataFrame, step: DataFrame, joints: DataFrame) -> DataFrame:
    """conv, id, base: the depth of each call with several predecessors, null if it is in a circle or behind one."""
    tops = step.select("conv", F.col("id").alias("up"), "top", (F.col("dist") + 1).alias("way"), "ended")
    is_joint = joints.select("conv", F.col("id").alias("top"), F.lit(True).alias("joint"))
    ways = edges.join(tops, ["conv", "up"]).join(is_joint, ["conv", "top"], "left")
    start = F.when(F.col("ended") & F.col("joint").isNull(), F.lit(0).cast("long"))
    ways = durable(ways.select("conv", "id", "top", "way", start.alias("from")), "calls-ways")
    waiting = F.count_if(F.col("from").isNull())
    depths = lambda w: w.groupBy("conv", "id").agg(F.when(waiting == 0, F.max(F.col("from") + F.col("way"))).alias("base"))
    open_before, still_open = -1, ways.where("from IS NULL").count()
    while still_open and still_open != open_before:
        found = depths(ways).where("base IS NOT NULL").select("conv", F.col("id").alias("top"), "base")
        later = ways.where("from IS NULL").join(found, ["conv", "top"], "left").select("conv", "id", "top", "way", F.col("base").alias("from"))
        ways = durable(ways.where("from IS NOT NULL").unionByName(later), "calls-ways")
        open_before, still_open = still_open, ways.where("from IS NULL").count()
    return depths(ways)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv, id, name, call_order, valid, errors, n_calls, n_results, json: one row per call identifier and different result.

    calls: conv long, id string, name string, arguments string (JSON), after string or array of strings
    (ids or null). results: conv long, id string, content string.
    Calls without conversation or id can't be linked and are left out, as are results without a call.
    Rows of one identifier that are equal are one call, n_calls says how many there were; if they differ, the
    smallest counts and has the error `several calls`. Equal results of a call are one, n_results says how
    many there were; each different one has its own row. A call without result has null in its place and
    n_results 0; calls in a circle or behind one have a null order. Null arguments are no JSON object.
    Empty tables give an empty result. Other columns are not read.
    """
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.array("after")
    one = F.struct(F.coalesce("name", F.lit("")).alias("name"), "arguments", F.array_sort(F.array_compact(F.coalesce(after, F.array().cast("array<string>")))).alias("after"))
    once = calls.where("conv IS NOT NULL AND id IS NOT NULL").groupBy("conv", "id").agg(
        F.min(one).alias("c"), (~F.min(one).eqNullSafe(F.max(one))).alias("several"), F.count(F.lit(1)).alias("n_calls")
    ).select("conv", "id", "c.*", "several", "n_calls")
    once = durable(once, "calls-once")
    given = results.where("conv IS NOT NULL AND id IS NOT NULL").groupBy("conv", "id", "content").agg(F.count(F.lit(1)).alias("n_results"))
    wrong = argument_errors(F.col("name"), F.col("arguments"), schemas)
    wrong = F.when(F.col("several"), F.array_append(wrong, "several calls")).otherwise(wrong)
    placed = durable(once.join(_depths(once), ["conv", "id"]).select("conv", "id", "name", "arguments", "n_calls", F.col("depth").alias("call_order"), wrong.alias("wrong")), "calls-placed")
    # Two joins, not one outer join: of an inner join the side with many results of one identifier may be split.
    none = placed.join(given.select("conv", "id").distinct(), ["conv", "id"], "left_anti").select("*", F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("n_results"))
    checked = placed.join(given, ["conv", "id"]).unionByName(none)
    # Objects of the variant type keep their keys sorted, at every level.
    body = F.to_json(
        F.struct(
            F.try_parse_json(F.col("arguments")).alias("arguments"), F.col("id").alias("id"), F.col("name").alias("name"),
            F.col("call_order").alias("order"), F.col("content").alias("result"), (F.size("wrong") == 0).alias("valid"),
        ),
        {"ignoreNullFields": "false"},
    )
    return checked.select(
        "conv", "id", "name", "call_order", (F.size("wrong") == 0).alias("valid"), F.array_join("wrong", ";").alias("errors"), "n_calls", "n_results", body.alias("json")
    )


#: Conversations as calls: a user turn asks the model, the next turn answers; a system turn instructs it.
REPLY: Schemas = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True)},
    "instruct": {
        "type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False,
    },
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text).

    User and system turns are calls, an assistant turn t + 1 is the result of call t. Call t comes after call t - 1 if there is
    one, else after call t - 2. Turns of other roles, and those without conversation or turn, are neither; a null text is an argument that is missing.
    Equal rows stay as they are: linking makes them one. Other columns are not read; an empty table gives empty ones.
    """
    key = lambda t: F.concat(F.lit("t"), t.cast("string"))
    read = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    read = read.where("conv IS NOT NULL AND turn IS NOT NULL")
    asked = read.where("role IN ('user', 'system')")
    before = asked.select("conv", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows")).distinct()
    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = asked.join(before, ["conv", "turn"], "left").select(
        "conv", key(F.col("turn")).alias("id"), F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"),
        F.when(F.col("role") == "user", prompt).otherwise(F.to_json(F.struct("text", "turn"))).alias("arguments"),
        key(F.col("turn") - F.when(F.col("follows"), 1).otherwise(2)).alias("after"),
    )
    return calls, read.where("role = 'assistant'").select("conv", key(F.col("turn") - 1).alias("id"), F.col("text").alias("content"))
