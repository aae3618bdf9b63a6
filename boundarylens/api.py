"""What a user calls: from files to models, chains, reports and explanations, each in one call.

Every function reads documents from paths and gives DataFrames; with `output` they are written, too. In
strict mode (the default) the first violations of the inputs raise; otherwise they come back as a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boundarylens.operators import chains as C
from boundarylens.operators import documents as D
from boundarylens.operators import evaluation as E
from boundarylens.operators import model as M
from boundarylens.operators import model_documents as MD
from boundarylens.operators import pairing as P
from boundarylens.operators import schemas as J
from boundarylens.operators import upkeep as U
from boundarylens.operators import verdicts as V
from boundarylens.operators import violations as W
from boundarylens.sources import readers as R
from boundarylens.sources.documents import pretty_column, write_documents
from boundarylens.sources.shared import stored


@dataclass(frozen=True)
class Found:
    """The documents of a call and what was wrong with its inputs."""

    documents: DataFrame
    violations: DataFrame


def models(spark: SparkSession, table_path: str, workflows: list[str] | None = None, observations_path: str | None = None, *, output: str | None = None, strict: bool = True) -> Found:
    """One common model per workflow (or per wanted one), with the runtime observations of a file appended to the model of the workflow they name."""
    t = stored(R.read_extraction(spark, table_path), "extraction")
    wanted = None if workflows is None else spark.createDataFrame([(w,) for w in workflows], "workflow string")
    wrong = W.of_table(t if wanted is None else M.workflow_rows(t, wanted), wanted)
    made = M.documents(t if wanted is None else M.workflow_rows(t, wanted), table_path)
    if observations_path is not None:
        o = R.read_json(spark, observations_path, R.OBSERVATION)
        seen = o.select("workflow", F.col("id").alias("observation"), F.col("platformPolicy.cacheWriteDecision").alias("decision"))
        results = o.select("workflow", F.col("id").alias("observation"), F.explode("operationResults").alias("r")).select("workflow", "observation", F.col("r.operationId").alias("op_id"), F.col("r.outcome").alias("outcome"))
        wrong = wrong.unionByName(W.of_observations(seen, results, M.operations(t)))
        made = M.with_observations(made, seen, results)
    return _finished(made, wrong, output, strict)


def update_models(spark: SparkSession, table_path: str, store_path: str, *, strict: bool = True) -> U.Update:
    """Bring a store of models, operations and pairs (operators/upkeep.py) up to date with a table. In strict mode a table with violations changes nothing."""
    t = stored(R.read_extraction(spark, table_path), "extraction")
    W.kept(W.of_table(t), strict)
    return U.update(t, store_path, table_path)


def discover(spark: SparkSession, table_path: str, annotations_path: str | None = None, *, output: str | None = None, strict: bool = True) -> Found:
    """Without annotations the catalog of candidates (id, document), with them one chain document per scenario (scenario, file, document)."""
    t = stored(R.read_extraction(spark, table_path), "extraction")
    pairs = stored(P.candidates(t, stored(M.operations(t), "operations")), "candidates")
    wrong = W.of_table(t)
    if annotations_path is None:
        return _finished(P.catalog(pairs), wrong, output, strict)
    scenarios = D.scenarios(R.read_json(spark, annotations_path, R.ANNOTATIONS))
    rows = stored(D.annotated(scenarios, pairs, table_path, annotations_path), "annotated-chains")
    wrong = wrong.unionByName(W.of_scenarios(scenarios, pairs)).unionByName(W.of_chains(rows))
    made = D.chain_documents(rows, table_path)
    found = _finished(made, wrong, None, strict)
    if output is not None:
        write_documents(D.chain_files(rows, table_path), output)
    return found


def state_models(spark: SparkSession, chains_path: str) -> DataFrame:
    """scenario, text: the state model of every chain document under a path."""
    c = read_chains(spark, chains_path)
    return c.select("scenario", V.chain_model(F.col("path"), F.col("scenario"), C.trace_lines(F.col("places"))).alias("text"))


def cache_models(
    spark: SparkSession, models_path: str, operation_id: str | None = None, observation_id: str | None = None, *, output: str | None = None, strict: bool = True,
) -> Found:
    """path, op_id, file, document: the state model of every model document under a path.

    It starts from the named operation, or the only cache write; what was seen at run time comes from the named observation, or the only one. With output each
    is a file, named as its model document with the ending .smv.
    """
    models_ = stored(R.read_named(spark, models_path, R.MODEL), "models")
    every = models_.select(F.col("path").alias("workflow"))
    ops = MD.operations(models_, "path")
    choices = stored(V.cache_choices(ops, None if operation_id is None else every.withColumn("op_id", F.lit(operation_id))), "choices")
    choices = every.join(choices, "workflow", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen, results = MD.observations(models_)
    named = None if observation_id is None else every.withColumn("observation", F.lit(observation_id))
    picked = stored(V.chosen_observations(seen, named), "observations")
    chosen = choices.where("n = 1 AND op_kind = 'cacheWriteIntent'").select("workflow", "op_id")
    counted = results.join(picked.where("n = 1").select("workflow", "observation"), ["workflow", "observation"], "left_semi").join(chosen, ["workflow", "op_id"], "left_semi")
    wrong = W.of_cache_choices(choices).unionByName(W.of_observations(seen.join(picked.where("n = 1").select("workflow", "observation"), ["workflow", "observation"], "left_semi").unionByName(seen.join(picked.where("n > 1").select("workflow"), "workflow", "left_semi")), counted, ops, named))
    facts = MD.cache_facts(models_, chosen, picked, results).join(picked.where("n > 1").select("workflow"), "workflow", "left_anti")
    if named is not None:
        facts = facts.join(picked.where("n = 1").select("workflow"), "workflow", "left_semi")
    stem = F.regexp_replace(F.regexp_extract("workflow", r"([^/]+)$", 1), r"\.json$", "")
    made = facts.select(F.col("workflow").alias("path"), "op_id", F.concat(stem, F.lit(".smv")).alias("file"), V.cache_model(F.col("workflow")).alias("document"))
    found = _finished(made, wrong, None, strict)
    if output is not None:
        write_documents(made.select("file", "document"), output)
    return found


def configured_chains(spark: SparkSession, configs_path: str, models_path: str, *, root: str = "", output: str | None = None, strict: bool = True) -> Found:
    """scenario, file, document: the chains that configurations name by hand, from the model documents under a path.

    A configuration names its two models by path, relative to root. Each workflow is taken from the models that the configurations name.
    """
    configs = R.read_named(spark, configs_path, R.CONFIG)
    models_ = stored(R.read_named(spark, models_path, R.MODEL).withColumn("bare", MD.bare_path(F.col("path"))).withColumn("name", F.col("workflow.name")), "models")
    at = lambda side: MD.bare_path(F.concat(F.lit(f"{root}/" if root else ""), F.col(f"{side}Model")))
    names = lambda side: models_.select(F.col("bare").alias(f"{side}_at"), F.col("name").alias(side))
    configs = stored(configs.withColumn("producer_at", at("producer")).withColumn("consumer_at", at("consumer")).join(names("producer"), "producer_at", "left").join(names("consumer"), "consumer_at", "left").select(
        "path", F.col("scenario.id").alias("scenario"), F.col("scenario").alias("told"), "schemaVersion", "producer", "consumer", F.col("producerOperationId").alias("producer_op"), F.col("consumerOperationId").alias("consumer_op"), "facts",
        "sharedObject", F.col("useStepIndex").alias("use_step"), F.col("integrityStepIndex").alias("check_step"), "authority", "evidence"), "configs")
    meant = models_.join(configs.select(F.explode(F.array("producer", "consumer")).alias("name")).distinct(), "name", "left_semi")
    ops, rows = MD.operations(meant, "name"), MD.event_rows(meant)
    lost = configs.where("producer IS NULL OR consumer IS NULL").select(F.lit("no such model").alias("rule"), F.col("scenario").alias("entity"), F.lit(None).cast("string").alias("detail"))
    made = D.configured(configs.where("producer IS NOT NULL AND consumer IS NOT NULL"), ops, M.workflows(rows))
    wrong = lost.unionByName(W.of_lookups(configs.where("producer IS NOT NULL AND consumer IS NOT NULL"), ops, rows)).unionByName(W.of_facts(made.withColumn("id", F.col("scenario"))))
    documents = made.select("scenario", F.concat(F.lower("scenario"), F.lit(".json")).alias("file"), D.configured_chain().alias("chain"))
    found = _finished(documents.select("scenario", "file", F.to_json("chain", D.NULLS).alias("document")), wrong, None, strict)
    if output is not None:
        write_documents(documents.select("file", pretty_column(documents, "chain").alias("document")), output)
    return found


def check_documents(spark: SparkSession, documents_path: str, schema_path: str) -> DataFrame:
    """path, at, rule: what the JSON documents under a path break of a schema file."""
    schema = json.loads("\n".join(r.value for r in spark.read.text(schema_path, wholetext=True).collect()))
    documents = spark.read.text(documents_path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("document"))
    return J.violations(documents, schema).select(F.col("id").alias("path"), F.col("path").alias("at"), "rule")


@dataclass(frozen=True)
class Evaluation:
    """Judged cases (id, expected, actual, correct), the report on them, and what was wrong with the inputs."""

    cases: DataFrame
    report: DataFrame
    violations: DataFrame


def evaluate(spark: SparkSession, manifest_path: str, chains_path: str, *, outputs_path: str | None = None, output: str | None = None, strict: bool = True) -> Evaluation:
    """The cases of a manifest against chain documents, or against what a checker printed about them.

    A case names its chain document by file name. With outputs the verdict is that of the output file with the chain's name, whatever its ending; without it is computed from
    the chain's facts.
    """
    manifest = R.read_json(spark, manifest_path, R.MANIFEST).select(F.explode("cases").alias("c")).select(F.col("c.id").alias("id"), F.col("c.expectedVerdict").alias("expected"), _file_name(F.col("c.model")).alias("name"))
    chains = read_chains(spark, chains_path).withColumn("name", _file_name(F.col("path")))
    none = lambda rule, of: of.select(F.lit(rule).alias("rule"), F.col("id").alias("entity"), F.col("name").alias("detail"))
    wrong = none("no such chain", manifest.join(chains.select("name"), "name", "left_anti"))
    if outputs_path is None:
        judged = chains.select("name", F.when(V.chain_unsafe() & V.chain_consistent(), "unsafe").otherwise("safe").alias("actual"))
    else:
        told = stored(_of_outputs(spark, outputs_path)[1], "verdicts")
        cases_told = manifest.withColumn("stem", _stem(F.col("name"))).join(told.withColumnRenamed("name", "stem"), "stem", "left")
        wrong = wrong.unionByName(none("no output", cases_told.where("file IS NULL"))).unionByName(none("no specification line", cases_told.where("file IS NOT NULL AND told IS NULL")))
        wrong = wrong.unionByName(cases_told.where("told IS NOT NULL AND verdict IS NULL").select(F.lit("no verdict").alias("rule"), F.col("id").alias("entity"), F.col("told").alias("detail")))
        judged = chains.select("name", _stem(F.col("name")).alias("stem")).join(told.select(F.col("name").alias("stem"), F.col("verdict").alias("actual")), "stem").drop("stem")
    cases = E.judged(manifest.join(judged, "name", "left").select("id", "expected", "actual"))
    made = E.report(cases)
    wrong = _finished(cases, wrong, None, strict).violations
    if output is not None:
        R.write_text(E.case_documents(cases), "document", f"{output}/cases")
        R.write_text(made, "document", f"{output}/report")
    return Evaluation(cases, made, wrong)


def explain(spark: SparkSession, chains_path: str, outputs: DataFrame | str, *, output: str | None = None) -> DataFrame:
    """scenario, document: what a checker's outputs say about the chain documents under a path.

    outputs: a DataFrame (scenario, output), or a folder with an output file for each chain, named as the chain or its scenario. Files may be large: they are
    read in splits. With output each explanation is a file named as its scenario with the ending .md.
    """
    chains = read_chains(spark, chains_path)
    if isinstance(outputs, str):
        lines, told = _of_outputs(spark, outputs)
        by_name = stored(chains.select("scenario", "places", F.explode(F.array_distinct(F.array(_stem(_file_name(F.col("path"))), F.lower("scenario")))).alias("name")).dropDuplicates(["name"]), "chains")
        stages = E.file_stages(lines).withColumn("name", _stem(_file_name(F.col("file")))).drop("file")
        made = E.file_markdown(by_name, told.drop("file"), stages)
    else:
        made = chains.join(outputs, "scenario").select("scenario", E.markdown(F.col("scenario"), F.col("output"), F.col("places")).alias("document"))
    if output is not None:
        write_documents(made.select(F.concat(F.lower("scenario"), F.lit(".md")).alias("file"), "document"), output)
    return made


def _of_outputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a folder's output files, and per file its name, verdict, specification line and whether it tells of a violation."""
    lines = stored(E.output_lines(R.numbered_lines(spark, path)), "output-lines")
    return lines, E.file_verdicts(lines).withColumn("name", _stem(_file_name(F.col("file"))))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain documents as rows: path, scenario, the eleven facts, and places as in chains.places."""
    raw = spark.read.schema(R.CHAIN).json(path, multiLine=True, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("path"))
    place = lambda i, s: F.struct(
        F.lit(s).alias("stage"), F.lit(i).alias("ord"), *[F.col(f"traceMap.{s}.{k}").cast("string").alias(n) for k, n in (("workflowFile", "file"), ("workflowName", "workflow"), ("jobId", "job_id"), ("stepIndex", "step_index"), ("meaning", "meaning"))])
    return raw.select("path", F.col("scenario.id").alias("scenario"), *[F.col(f"facts.{f}").alias(f) for f in V.CHAIN_FACTS], F.array(*[place(i, s) for i, s in enumerate(V.STAGES)]).alias("places"))


def _file_name(path: Column) -> Column:
    """The name a document goes by: its file's, or that of the folder a partitioned write put it in."""
    return F.lower(F.regexp_extract(path, r"(?:.*/file=|^(?!.*/file=)(?:.*/)?)([^/]+)", 1))


def _finished(made: DataFrame, wrong: DataFrame, output: str | None, strict: bool) -> Found:
    wrong = W.kept(wrong, strict)
    if output is not None:
        R.write_json(made, output)
    return Found(made, wrong)
