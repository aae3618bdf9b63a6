"""From annotation documents and pairs to whole trust chain documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.functions import expressions as X
from boundarylens.operators import chains as C
from boundarylens.operators import pairing as P
from boundarylens.operators.verdicts import CHAIN_FACTS, STAGES
from boundarylens.sources.documents import pretty_column

#: Fixed values of the chain document.
VERSION, PLATFORM, PRODUCER_RUN = "0.3.0", "GitHub Actions", "github.run_id"
EVIDENCE_CLAIM = "CodeQL抽出結果から保存側と取得側を自動結合した．"
TOOL_SOURCE = "tools/discover_artifact_chains.py"
#: Fixed values end.

NULLS = {"ignoreNullFields": "false"}


def scenarios(annotations: DataFrame) -> DataFrame:
    """Annotation documents as rows: scenario, producer, consumer, description, evidence_status, facts and locations (maps)."""
    return annotations.select(F.explode("scenarios").alias("s")).select(
        F.col("s.id").alias("scenario"), F.col("s.producerWorkflow").alias("producer"), F.col("s.consumerWorkflow").alias("consumer"),
        F.col("s.description").alias("description"), F.col("s.evidenceStatus").alias("evidence_status"), F.col("s.facts").alias("facts"), F.col("s.locations").alias("locations"),
    )


def fact_value(facts: Column, name: str) -> Column:
    """The value of an annotated fact; null if it is missing or its kind of source is none of the three."""
    given = facts[name]
    return F.when(given.sourceKind.isin(*C.SOURCE_KINDS), given.value)


def annotated(scenario_rows: DataFrame, pairs: DataFrame, table_source: str, annotation_source: str) -> DataFrame:
    """One row per scenario with exactly one pair, a unique one, and all seven facts: the chain's columns, places and records.

    What keeps a scenario out is told by violations.of_scenarios.
    """
    chosen = P.found_for(scenario_rows.select("scenario", "producer", "consumer"), pairs).where("chosen IS NOT NULL").select("scenario", F.col("chosen").alias("id"))
    whole = F.size(F.array_except(F.array(*[F.lit(n) for n in C.ANNOTATED]), F.map_keys("facts"))) == 0
    given = scenario_rows.where(whole).drop("producer", "consumer").join(chosen, "scenario")
    rows = C.assembled(pairs.join(given, "id"), {n: fact_value(F.col("facts"), n) for n in C.ANNOTATED})
    at = lambda place: F.col("locations")[place]
    authority = at("authorityReached")
    told = [C.record(f"facts.{n}", *(F.col("facts")[n][k] for k in ("sourceKind", "source", "claim"))) for n in C.ANNOTATED]
    told += [C.record(f"traceMap.{s}", *(at(p)[k] for k in ("sourceKind", "source", "claim"))) for s, p in C.PLACES.items()]
    return rows.select(
        "*", C.places(at("objectUsed").stepIndex, at("integrityChecked").stepIndex, (authority.jobId, authority.stepIndex, authority.claim)).alias("places"),
        C.provenance(table_source, annotation_source, TOOL_SOURCE, F.array(*told)).alias("records"),
    )


def _endpoint(side: str, kind: str) -> Column:
    run = F.col("run_id") if side == "consumer" else F.lit(None).cast("string")
    return F.struct(
        F.struct(F.col(side).alias("name"), F.col(f"{side}_file").alias("file"), F.col(f"{side}_event").alias("event")).alias("workflow"),
        F.struct(
            F.col(f"{side}_op").alias("id"), F.lit(kind).alias("kind"), F.col(f"{side}_job").alias("jobId"), F.col(f"{side}_step").cast("int").alias("stepIndex"),
            F.col("name"), F.col(f"{side}_path").alias("path"), run.alias("runId"),
        ).alias("operation"),
    )


def _place(i: int) -> Column:
    at = F.col("places")[i]
    return F.struct(at.file.alias("workflowFile"), at.workflow.alias("workflowName"), at.job_id.alias("jobId"), at.step_index.cast("int").alias("stepIndex"), at.meaning.alias("meaning"))


def chain(table_source: str) -> Column:
    """The nested document of an annotated row."""
    return F.struct(
        F.lit(VERSION).alias("schemaVersion"),
        F.struct(F.col("scenario").alias("id"), F.lit(PLATFORM).alias("platform"), "description", F.col("evidence_status").alias("evidenceStatus")).alias("scenario"),
        _endpoint("producer", "artifactWriteIntent").alias("producer"), _endpoint("consumer", "artifactReadIntent").alias("consumer"),
        F.struct(
            F.lit("artifact").alias("kind"), F.lit(PRODUCER_RUN).alias("producerRunSelector"), F.lit(X.WORKFLOW_RUN_ID).alias("consumerRunSelector"),
            F.array(*[F.lit(b) for b in P.MATCH_BASIS]).alias("identityBasis"), "name",
        ).alias("sharedObject"),
        F.struct(*CHAIN_FACTS).alias("facts"), F.struct(*[_place(i).alias(s) for i, s in enumerate(STAGES)]).alias("traceMap"),
        F.array(F.struct(F.lit("static").alias("kind"), F.lit(table_source).alias("source"), F.lit(EVIDENCE_CLAIM).alias("claim"))).alias("evidence"),
        F.transform("records", lambda r: F.struct(r.element.alias("element"), r.source_kind.alias("sourceKind"), r.source.alias("source"), r.claim.alias("claim"))).alias("provenance"),
    )


def chain_documents(rows: DataFrame, table_source: str) -> DataFrame:
    """scenario, file (where its document goes), document as JSON; only chains whose records are without fault."""
    sound = rows.where(F.size(C.provenance_faults(F.col("records"))) == 0)
    return sound.select("scenario", F.concat(F.lower("scenario"), F.lit(".json")).alias("file"), F.to_json(chain(table_source), NULLS).alias("document"))


def chain_files(rows: DataFrame, table_source: str) -> DataFrame:
    """file, document: the same documents as they are written, each on lines of its own."""
    sound = rows.where(F.size(C.provenance_faults(F.col("records"))) == 0).select(F.concat(F.lower("scenario"), F.lit(".json")).alias("file"), chain(table_source).alias("chain"))
    return sound.select("file", pretty_column(sound, "chain").alias("document"))


def configured_chain() -> Column:
    """The nested document of a configured row: what its configuration tells is taken from there."""
    shared = F.struct(*[F.col(f"sharedObject.{c}").alias(c) for c in ("kind", "producerRunSelector", "consumerRunSelector", "identityBasis")], F.col("name"))
    return F.struct(
        "schemaVersion", F.col("told").alias("scenario"), _endpoint("producer", "artifactWriteIntent").alias("producer"), _endpoint("consumer", "artifactReadIntent").alias("consumer"),
        shared.alias("sharedObject"), F.struct(*CHAIN_FACTS).alias("facts"), F.struct(*[_place(i).alias(s) for i, s in enumerate(STAGES)]).alias("traceMap"), "evidence",
    )


def configured(configs: DataFrame, operations: DataFrame, workflows: DataFrame) -> DataFrame:
    """Chains that a configuration names by hand: one row per config whose two operations exist once, with equal names.

    configs: scenario, producer, consumer, producer_op, consumer_op, facts (map of strings), use_step,
    check_step, authority (struct jobId, stepIndex, meaning). Columns and places are those of `annotated`.
    """
    def side(s: str) -> DataFrame:
        once = operations.groupBy("workflow", "op_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("job_id", "step_index", "name", "path", "run_id")]).where("n = 1")
        named = once.withColumnRenamed("workflow", s).join(P.sided(workflows, s), s)
        return named.select(s, *[c for c in named.columns if c.startswith(f"{s}_")], F.col("op_id").alias(f"{s}_op"), F.col("job_id").alias(f"{s}_job"), F.col("step_index").alias(f"{s}_step"), F.col("name").alias(f"{s}_name"), F.col("path").alias(f"{s}_path"), *([F.col("run_id")] if s == "consumer" else []))

    both = configs.join(side("producer"), ["producer", "producer_op"]).join(side("consumer"), ["consumer", "consumer_op"])
    same = both.where(F.col("producer_name").eqNullSafe(F.col("consumer_name"))).withColumn("name", F.col("producer_name"))
    facts = {n: F.col("facts")[n] for n in (*C.ANNOTATED, "sameObject")}
    return C.assembled(same, facts).select("*", C.places(F.col("use_step"), F.col("check_step"), (F.col("authority.jobId"), F.col("authority.stepIndex"), F.col("authority.meaning"))).alias("places"))
