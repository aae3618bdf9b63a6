"""Writers and readers of artifacts across workflows, paired by name and trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.functions import expressions as X
from boundarylens.operators import model

#: Why a pair is one.
MATCH_BASIS = (
    "artifact nameが一致する．",
    "取得側が起動元workflow_runのrun IDを指定する．",
    "workflow_runのworkflows指定が保存側workflow名と一致する．",
)
#: Fixed values end.


def trigger_targets(table: DataFrame) -> DataFrame:
    """workflow, target: the workflows named by workflow_run, where a workflow has exactly one such event; each target once."""
    return model.workflows(table).select("workflow", F.explode("targets").alias("target"))


def sided(workflows: DataFrame, side: str) -> DataFrame:
    """What model.workflows tells of the workflow on one side of a pair; workflows without a header stay out."""
    return workflows.where("file IS NOT NULL").select(F.col("workflow").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("file", "n_events", "event", "external", "privileged")])


def candidates(table: DataFrame, ops: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row per pair of an artifact write and a read that may take its artifact, with the events of both workflows.

    The join's key is artifact name and producing workflow, so that a frequent name is spread over its
    workflows. pairing is 'unique' where the read has one match, else 'ambiguous' on all of them.
    """
    ops = model.operations(table) if ops is None else ops
    known = model.workflows(table) if known is None else known
    writes = ops.where("op_kind = 'artifactWriteIntent' AND name IS NOT NULL").select(
        F.col("workflow").alias("producer"), F.col("op_id").alias("producer_op"), F.col("job_id").alias("producer_job"), F.col("step_index").alias("producer_step"), "name", F.col("path").alias("producer_path")
    )
    reads = ops.where("op_kind = 'artifactReadIntent' AND name IS NOT NULL").where(X.normalized_expression(F.col("run_id")) == X.WORKFLOW_RUN_ID).select(
        F.col("workflow").alias("consumer"), F.col("op_id").alias("consumer_op"), F.col("job_id").alias("consumer_job"), F.col("step_index").alias("consumer_step"), "name",
        F.col("path").alias("consumer_path"), "run_id",
    )
    aimed = known.select(F.col("workflow").alias("consumer"), F.explode("targets").alias("producer"))
    pairs = reads.join(sided(known, "consumer"), "consumer").join(aimed, "consumer").join(writes, ["name", "producer"])
    placed = pairs.join(sided(known, "producer"), "producer")
    matches = F.count(F.lit(1)).over(Window.partitionBy("consumer", "consumer_op"))
    return placed.withColumn("pairing", F.when(matches == 1, "unique").otherwise("ambiguous")).withColumn(
        "id", X.candidate_id(F.col("producer_file"), F.col("producer_op"), F.col("consumer_file"), F.col("consumer_op"))
    )


def catalog(pairs: DataFrame) -> DataFrame:
    """The public document of each candidate as JSON, nulls kept."""
    doc = F.struct(
        "id", F.col("pairing").alias("pairingStatus"),
        F.struct(F.col("producer").alias("workflow"), F.col("producer_file").alias("file"), F.col("producer_op").alias("operationId")).alias("producer"),
        F.struct(F.col("consumer").alias("workflow"), F.col("consumer_file").alias("file"), F.col("consumer_op").alias("operationId")).alias("consumer"),
        F.struct(F.lit("artifact").alias("kind"), "name", X.normalized_expression(F.col("run_id")).alias("consumerRunSelector"), F.col("producer").alias("triggerWorkflow")).alias("sharedObject"),
        F.array(*[F.lit(x) for x in MATCH_BASIS]).alias("matchBasis"),
    )
    return pairs.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def found_for(scenarios: DataFrame, pairs: DataFrame) -> DataFrame:
    """scenario, n_candidates, n_unique, chosen: a scenario names two workflows and needs exactly one pair, a unique one."""
    of = scenarios.join(pairs.select("producer", "consumer", "id", "pairing"), ["producer", "consumer"], "left")
    n_unique = F.count_if(F.col("pairing") == "unique")
    counted = of.groupBy("scenario").agg(F.count("id").alias("n_candidates"), n_unique.alias("n_unique"), F.min("id").alias("first"))
    return counted.select("scenario", "n_candidates", "n_unique", F.when((F.col("n_candidates") == 1) & (F.col("n_unique") == 1), F.col("first")).alias("chosen"))
