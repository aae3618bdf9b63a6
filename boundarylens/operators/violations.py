"""What is wrong with the inputs, as rows (rule, entity, detail) instead of a stop at the first fault; `strict` makes it a stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boundarylens.operators import chains as C
from boundarylens.operators import evaluation as E
from boundarylens.operators import model as M
from boundarylens.operators import pairing as P
from boundarylens.sources.shared import stored


class Violations(ValueError):
    """Raised in strict mode; the message names the first few."""


def strict(found: DataFrame, shown: int = 20) -> None:
    """Raises if there is any violation."""
    first = found.orderBy("rule", "entity", "detail").limit(shown).collect()
    if first:
        raise Violations("; ".join(f"{r.rule}: {r.entity}: {r.detail}" for r in first))


def kept(found: DataFrame, stop: bool) -> DataFrame:
    """The violations, stored once. They are counted as they are written, so that where there are none nothing is read again; with stop any raises."""
    counted = Observation()
    rows = stored(found.observe(counted, F.count(F.lit(1)).alias("n")), "violations")
    if stop and counted.get["n"]:
        strict(rows)
    return rows


def _rows(df: DataFrame, rule: str, entity: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def of_table(table: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The table: wanted workflows (column workflow) without rows, workflows without a header row, properties without exactly one event or without a dot, permissions without a colon, lines that are no number.

    One scan and one aggregation: a workflow's events, property names and odd rows come together in its row, and its faults are computed there.
    """
    is_, name = lambda kind: F.col("kind") == kind, F.col("name")
    fault = lambda rule, detail, entity="workflow": F.struct(F.lit(rule).alias("rule"), (F.col(entity) if isinstance(entity, str) else entity).alias("entity"), detail.cast("string").alias("detail"))
    of = table.groupBy("workflow").agg(
        F.count_if(is_("workflow")).alias("heads"), F.collect_list(F.when(is_("event"), name)).alias("events"), F.collect_set(F.when(is_("event-property"), name)).alias("properties"),
        F.collect_list(F.when(is_("permission") & (F.instr("detail", ":") == 0), F.struct("job_id", "detail"))).alias("permissions"),
        F.collect_list(F.when(is_("expression") & F.col("line").isNull(), name)).alias("unnumbered"),
    )
    dotted, plain = F.filter("properties", lambda x: x.contains(".")), F.filter("properties", lambda x: ~x.contains("."))
    unclear = F.filter(dotted, lambda x: F.size(F.filter("events", lambda e: e == F.substring_index(x, ".", 1))) != 1)
    faults = F.concat(
        F.when(F.col("heads") == 0, F.array(fault("no workflow row", F.lit(None)))).otherwise(F.array().cast("array<struct<rule: string, entity: string, detail: string>>")),
        F.transform(unclear, lambda x: fault("property without one event", x)), F.transform(plain, lambda x: fault("property without dot", x)),
        F.transform("permissions", lambda x: fault("permission without colon", x["detail"], F.concat_ws(":", "workflow", x["job_id"]))), F.transform("unnumbered", lambda x: fault("line is no number", x)),
    )
    if wanted is None:
        return of.select(F.inline(faults))
    both = of.join(wanted.select("workflow").distinct().withColumn("wanted", F.lit(True)), "workflow", "full")
    return both.select(F.inline(F.when(F.col("heads").isNull(), F.array(fault("no rows", F.lit(None)))).otherwise(faults)))


def of_scenarios(scenario_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scenarios: without exactly one pair, with an ambiguous one, with missing facts, with facts whose kind of source is none of the three."""
    looked = P.found_for(scenario_rows.select("scenario", "producer", "consumer"), pairs)
    told = scenario_rows.select("scenario", F.explode("facts").alias("fact", "given"))
    return _all(
        _rows(looked.where("n_candidates <> 1"), "not one pair", F.col("scenario"), F.col("n_candidates")),
        _rows(looked.where("n_candidates = 1 AND n_unique <> 1"), "ambiguous pair", F.col("scenario")),
        _rows(C.missing_facts(scenario_rows.select(F.col("scenario").alias("id"), "facts")), "missing fact", F.col("scenario"), F.col("fact")),
        _rows(told.where(~F.coalesce(F.col("given.sourceKind").isin(*C.SOURCE_KINDS), F.lit(False))), "source kind of fact", F.col("scenario"), F.col("fact")),
    )


def of_chains(rows: DataFrame) -> DataFrame:
    """Chain rows (id, eleven facts, records): facts that are none of the three values, and faults of the records."""
    faults = rows.select("id", F.inline(C.provenance_faults(F.col("records"))))
    return _all(
        _rows(C.bad_facts(rows), "no such fact value", F.col("id"), F.concat_ws("=", "fact", "value")),
        faults.select(F.concat(F.col("rule"), F.lit(" provenance")).alias("rule"), F.col("id").cast("string").alias("entity"), F.col("element").alias("detail")),
    )


def of_facts(rows: DataFrame) -> DataFrame:
    """Chain rows (id, eleven facts) without records: facts that are none of the three values."""
    return _rows(C.bad_facts(rows), "no such fact value", F.col("id"), F.concat_ws("=", "fact", "value"))


def of_lookups(wanted: DataFrame, operations: DataFrame, table: DataFrame) -> DataFrame:
    """Operations named by hand (producer, producer_op, consumer, consumer_op): not exactly one, workflows without exactly one event, names that differ."""
    side = lambda s: wanted.select(F.col(s).alias("workflow"), F.col(f"{s}_op").alias("op_id")).distinct()
    both = side("producer").union(side("consumer")).distinct()
    n = operations.groupBy("workflow", "op_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    counted = both.join(n, ["workflow", "op_id"], "left")
    single = C.only_event(table).select("workflow")
    names = lambda s: n.select(F.col("workflow").alias(s), F.col("op_id").alias(f"{s}_op"), F.col("name").alias(f"{s}_name"))
    differ = wanted.join(names("producer"), ["producer", "producer_op"]).join(names("consumer"), ["consumer", "consumer_op"]).where("NOT producer_name <=> consumer_name")
    return _all(
        _rows(counted.where("coalesce(n, 0) <> 1"), "not one operation", F.concat_ws("/", "workflow", "op_id"), F.coalesce("n", F.lit(0))),
        _rows(both.select("workflow").distinct().join(single, "workflow", "left_anti"), "not one event", F.col("workflow")),
        _rows(differ, "names differ", F.concat_ws(">", "producer_op", "consumer_op"), F.concat_ws("<>", F.coalesce("producer_name", F.lit("-")), F.coalesce("consumer_name", F.lit("-")))),
    )


def of_cache_choices(choices: DataFrame) -> DataFrame:
    """Cache writes to start from (verdicts.cache_choices): not exactly one, or of another kind."""
    return _all(
        _rows(choices.where("n <> 1"), "not one cache write", F.col("workflow"), F.col("n")),
        _rows(choices.where("n = 1 AND op_kind <> 'cacheWriteIntent'"), "no cache write", F.col("workflow"), F.col("op_id")),
    )


def of_observations(observations: DataFrame, results: DataFrame, operations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Observations (workflow, observation, decision) and results (workflow, observation, op_id, outcome).

    Results of unknown operations, several results of one operation, decisions and outcomes without a
    meaning; several observations of a workflow of which none is named, and named ones (wanted: workflow,
    observation) that are not exactly one.
    """
    named = observations.sparkSession.createDataFrame([], "workflow string, observation string") if wanted is None else wanted
    n = observations.groupBy("workflow", "observation").agg(F.count(F.lit(1)).alias("n"))
    several = observations.groupBy("workflow").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(named, "workflow", "left_anti")
    return _all(
        _rows(M.unknown_observed(operations, results), "unknown operation observed", F.col("workflow"), F.col("op_id")),
        _rows(results.groupBy("workflow", "observation", "op_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several results", F.concat_ws("/", "workflow", "op_id"), F.col("n")),
        _rows(several, "several observations", F.col("workflow"), F.col("n")),
        _rows(named.join(n, ["workflow", "observation"], "left").where("coalesce(n, 0) <> 1"), "not one observation", F.col("workflow"), F.col("observation")),
        _rows(observations.where("NOT coalesce(decision IN ('allowed', 'denied', 'unknown'), false)"), "no such decision", F.col("workflow"), F.col("decision")),
        _rows(results.where("NOT coalesce(outcome IN ('succeeded', 'failed', 'unknown'), false)"), "no such outcome", F.concat_ws("/", "workflow", "op_id"), F.col("outcome")),
    )


def of_outputs(outputs: DataFrame) -> DataFrame:
    """Checker outputs (id, output): without a specification line, or with one that tells no verdict."""
    first = F.get(F.filter(E.lines_of(F.col("output")), lambda x: x.startswith(E.SPEC_LINE)), 0)
    told = outputs.select("id", first.alias("line"), E.verdict(F.col("output")).alias("verdict"))
    return _all(
        _rows(told.where("line IS NULL"), "no specification line", F.col("id")),
        _rows(told.where("line IS NOT NULL AND verdict IS NULL"), "no verdict", F.col("id"), F.col("line")),
    )
