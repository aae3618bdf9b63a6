"""From model documents back to tables: operations, events, observations, facts. A document is known by the path it was read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.operators import verdicts as V


def operations(models: DataFrame, key: str) -> DataFrame:
    """workflow (the given column of models), op_id, op_kind and the rest of an operation."""
    o = models.select(F.col(key).alias("workflow"), F.explode("sharedStateOperations").alias("o"))
    return o.select("workflow", F.col("o.id").alias("op_id"), F.col("o.kind").alias("op_kind"), F.col("o.jobId").alias("job_id"), F.col("o.stepIndex").cast("string").alias("step_index"), "o.key", "o.path", "o.name", F.col("o.runId").alias("run_id"))


def event_rows(models: DataFrame) -> DataFrame:
    """The header and event rows of an extraction table that a model was made of."""
    flag = lambda c, name: F.when(F.col(c), name).otherwise(f"not-{name}")
    named = models.select(F.col("workflow.file").alias("file_path"), F.col("workflow.name").alias("workflow"), F.col("workflow.events").alias("events"))
    rows = [
        named.select("file_path", "workflow", F.lit("workflow").alias("kind"), F.lit("workflow").alias("name"), F.lit("-").alias("detail"), F.lit(0).cast("long").alias("row_seq")),
        named.select("file_path", "workflow", F.posexplode("events").alias("at", "e")).select(
            "file_path", "workflow", F.lit("event").alias("kind"), F.col("e.name").alias("name"),
            F.concat_ws(";", flag("e.externallyTriggerable", "externally-triggerable"), flag("e.privileged", "privileged")).alias("detail"), (F.col("at") + 1).cast("long").alias("row_seq")),
    ]
    return rows[0].unionByName(rows[1])


def observations(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, results) as verdicts.chosen_observations and runtime_facts take them; a model goes by its path."""
    seen = models.select(F.col("path").alias("workflow"), F.explode("runtimeObservations").alias("o"))
    told = seen.select("workflow", F.col("o.id").alias("observation"), F.col("o.platformPolicy.cacheWriteDecision").alias("decision"))
    results = seen.select("workflow", F.col("o.id").alias("observation"), F.explode("o.operationResults").alias("r"))
    return told, results.select("workflow", "observation", F.col("r.operationId").alias("op_id"), F.col("r.outcome").alias("outcome"))


def cache_facts(models: DataFrame, chosen: DataFrame, seen: DataFrame, results: DataFrame) -> DataFrame:
    """workflow and the eight facts of models whose operation and observation are settled.

    chosen: verdicts.cache_choices with one operation; seen: verdicts.chosen_observations, a model that has none is not among them.
    """
    decided = seen.where("n = 1").select("workflow", "observation", "decision")
    of_it = results.join(decided.select("workflow", "observation"), ["workflow", "observation"]).join(chosen.select("workflow", "op_id"), ["workflow", "op_id"])
    runtime = V.runtime_facts(chosen, decided.select("workflow", "decision"), of_it)
    told = {"same_object": "sameObject", "consumer_uses_object": "consumerUsesObject", "integrity_verified": "integrityVerified", "privileged_consumer": "privilegedConsumer", "has_authority": "hasAuthority"}
    facts = models.select(F.col("path").alias("workflow"), *[F.col(f"verificationFacts.{c}").alias(n) for n, c in told.items()])
    return runtime.join(facts, "workflow").select("workflow", "op_id", F.lit("true").alias("write_intent"), *V.CACHE_FACTS[1:])


def bare_path(path: Column) -> Column:
    """A path without the scheme of its file system and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/(\\./|/)*", "/")
