"""Every operator as a query over the workflow table, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundarylens.functions import expressions as X
from boundarylens.operators import chains as C
from boundarylens.operators import documents as D
from boundarylens.operators import evaluation as E
from boundarylens.operators import identity as I
from boundarylens.operators import model as M
from boundarylens.operators import pairing as P
from boundarylens.operators import upkeep as U
from boundarylens.operators import verdicts as V
from boundarylens.operators import violations as W
from boundarylens.plans import sql as S
from boundarylens.sources.binding import extraction, table
from boundarylens.sources.readers import of_kind
from boundarylens.sources.shared import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, needs: str, body: str):
    """Registers a query on the workflow table with its SQL."""

    def wrap(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(extraction(spark, sf_dir))
        ORACLE_SQL[name] = S.query(needs, body) if needs else body
        return f

    return wrap


def register_on(name: str, needs: str, body: str):
    """Registers a query that reads other tables too."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE_SQL[name] = S.query(needs, body) if needs else body
        return f

    return wrap


def artifact_operations(t: DataFrame) -> DataFrame:
    """The writes and reads that pairs are made of, derived once for both sides of the join."""
    return stored(M.operations(t).where("op_kind IN ('artifactWriteIntent', 'artifactReadIntent')"), "artifact-operations")


def pairs_of(t: DataFrame) -> DataFrame:
    return P.candidates(t, artifact_operations(t))


def chains_of(t: DataFrame) -> DataFrame:
    """Candidates with the facts and places that the benchmark tables bind to them; one row each, from which all that follows is a projection."""
    step = F.col("consumer_step").cast("int")
    rows = C.assembled(pairs_of(t), {k: F.expr(v) for k, v in S.PAIR_FACTS.items()})
    return rows.withColumn("places", C.places(step + 1, step + 2, (F.when(F.col("pairing") == "unique", F.lit("deploy")), step + 3, F.lit("権限へ到達する．"))))


# Structure of the table

@register("op_q01_workflow_rows", "d1", "SELECT workflow, count(*) AS n, min(row_seq) AS first_seq FROM d1 GROUP BY workflow")
def _(t):
    return t.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.min("row_seq").alias("first_seq"))


@register("op_q02_job_and_step_markers", "d1", "SELECT kind, count(*) FILTER (job_id = '-') AS no_job, count(*) FILTER (step_index = '-') AS no_step, count(*) AS n FROM d1 GROUP BY kind")
def _(t):
    return t.groupBy("kind").agg(F.count_if(F.col("job_id") == "-").alias("no_job"), F.count_if(F.col("step_index") == "-").alias("no_step"), F.count(F.lit(1)).alias("n"))


@register("op_q05_event_labels", "ev", """SELECT workflow, event, CASE WHEN external THEN 'externally-triggerable' ELSE 'not-externally-triggerable' END || ';' ||
  CASE WHEN privileged THEN 'privileged' ELSE 'not-privileged' END AS detail FROM ev""")
def _(t):
    label = lambda c, n: F.when(F.col(c), n).otherwise(f"not-{n}")
    return M.events(t).select("workflow", "event", F.concat_ws(";", label("external", "externally-triggerable"), label("privileged", "privileged")).alias("detail"))


@register("op_q07_extracted_arguments", "d1", f"SELECT name, count(*) AS n FROM d1 WHERE kind = 'uses-argument' AND name IN ({', '.join(repr(a) for a in X.ARGUMENTS)}) GROUP BY name")
def _(t):
    return of_kind(t, "uses-argument").where(F.col("name").isin(*X.ARGUMENTS)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@register("op_q10_property_rows", "d1", "SELECT workflow, name, detail, line FROM d1 WHERE kind = 'event-property'")
def _(t):
    rows = M.event_properties(t).select("workflow", F.concat_ws(".", "event", "property").alias("name"), F.explode(F.arrays_zip("values", "lines")).alias("r"))
    return rows.select("workflow", "name", F.col("r.values").alias("detail"), F.col("r.lines").alias("line"))


@register("op_q11_job_rows", "d1", "SELECT workflow, job_id, detail FROM d1 WHERE kind = 'job'")
def _(t):
    return M.jobs(t).select("workflow", "job_id", F.explode("labels").alias("label")).select("workflow", "job_id", F.concat(F.lit("runs-on="), "label").alias("detail"))


@register("op_q12_uses_rows", "step", "SELECT workflow, job_id, step_index, action || '@' || version AS detail FROM step WHERE type = 'uses' AND action <> ''")
def _(t):
    return M.steps(t).where("type = 'uses' AND action <> ''").select("workflow", "job_id", "step_index", F.concat_ws("@", "action", "version").alias("detail"))


@register("op_q13_argument_rows", "step", """SELECT workflow, job_id, step_index, name, detail FROM step, LATERAL (VALUES ('name', arg_name), ('path', arg_path), ('key', arg_key), ('run-id', arg_run)) a(name, detail)
  WHERE detail IS NOT NULL""")
def _(t):
    return M.steps(t).where("type = 'uses'").select("workflow", "job_id", "step_index", F.explode(M.argument_map()).alias("name", "detail"))


@register("op_q14_run_rows", "step", "SELECT workflow, job_id, step_index, command FROM step WHERE type = 'run'")
def _(t):
    return M.steps(t).where("type = 'run'").select("workflow", "job_id", "step_index", "command")


@register("op_q15_other_steps", "d1", "SELECT workflow, job_id, step_index, count(*) AS n FROM d1 WHERE kind = 'step' GROUP BY ALL")
def _(t):
    return of_kind(t, "step").groupBy("workflow", "job_id", "step_index").agg(F.count(F.lit(1)).alias("n"))


@register("op_q16_permission_rows", "d1", "SELECT workflow, job_id, detail FROM d1 WHERE kind = 'permission'")
def _(t):
    return M.permissions(t).select("workflow", F.coalesce("job_id", F.lit("-")).alias("job_id"), F.concat_ws(": ", "scope", "access").alias("detail"))


@register("op_q17_expression_rows", "d1", "SELECT workflow, name, detail, line FROM d1 WHERE kind = 'expression'")
def _(t):
    return M.expressions(t).select("workflow", F.col("raw").alias("name"), F.col("normalized").alias("detail"), "line")


@register("op_q18_table_as_set", "d1", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT file_path, line, workflow, job_id, step_index, kind, name, detail FROM d1) GROUP BY kind")
def _(t):
    return t.drop("row_seq").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# From the table to the model

@register("op_01_rows_of_workflows", "d1", "SELECT workflow, kind, name, detail, row_seq FROM d1 WHERE workflow IN (SELECT workflow FROM d1 WHERE kind = 'event' AND name = 'workflow_run')")
def _(t):
    wanted = M.events(t).where("event = 'workflow_run'")
    return M.workflow_rows(t, wanted).select("workflow", "kind", "name", "detail", "row_seq")


@register("op_02_event_flags", "ev", "SELECT workflow, event, external, privileged FROM ev")
def _(t):
    return M.events(t).select("workflow", "event", "external", "privileged")


@register("op_03_split_action", "d1", "SELECT regexp_extract(detail, '^(.*)@', 1) AS action, regexp_extract(detail, '@([^@]*)$', 1) AS version, count(*) AS n FROM d1 WHERE kind = 'uses-step' GROUP BY ALL")
def _(t):
    d = F.col("detail")
    return of_kind(t, "uses-step").groupBy(X.action_name(d).alias("action"), X.action_version(d).alias("version")).agg(F.count(F.lit(1)).alias("n"))


@register("op_04_headers", "d1", "SELECT workflow, arg_min(name, row_seq) AS name, arg_min(file_path, row_seq) AS file FROM d1 WHERE kind = 'workflow' GROUP BY workflow")
def _(t):
    return M.headers(t)


@register("op_05_events", "ev", "SELECT event, count(*) AS n, count(*) FILTER (external) AS n_external FROM ev GROUP BY event")
def _(t):
    return M.events(t).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if("external").alias("n_external"))


@register("op_06_event_properties", "d1 ev", """SELECT d.workflow, split_part(name, '.', 1) AS event, split_part(name, '.', 2) AS property, string_agg(detail, ',' ORDER BY d.row_seq) AS values,
  (SELECT count(*) FROM ev e WHERE e.workflow = d.workflow AND e.event = split_part(name, '.', 1)) AS n_events FROM d1 d WHERE kind = 'event-property' GROUP BY ALL""")
def _(t):
    return M.event_properties(t).drop("lines").withColumn("values", F.array_join("values", ","))


@register("op_07_permissions", "d1", "SELECT workflow, nullif(job_id, '-') AS job_id, trim(split_part(detail, ':', 1)) AS scope, trim(split_part(detail, ':', 2)) AS access FROM d1 WHERE kind = 'permission'")
def _(t):
    return M.permissions(t).drop("row_seq")


@register("op_08_jobs", "job", "SELECT workflow, job_id, label, job_seq FROM job")
def _(t):
    return M.jobs(t).drop("labels")


@register("op_09_merged_steps", "step", "SELECT workflow, job_id, step_index, type, action, version FROM step")
def _(t):
    return M.steps(t).select("workflow", "job_id", "step_index", "type", "action", "version")


@register("op_10_arguments", "step", "SELECT workflow, job_id, step_index, arg_name, arg_path, arg_key, arg_run FROM step WHERE type = 'uses'")
def _(t):
    return M.steps(t).where("type = 'uses'").select("workflow", "job_id", "step_index", "arg_name", "arg_path", "arg_key", F.col("`arg_run-id`").alias("arg_run"))


@register("op_11_run_steps", "step", "SELECT type, count(*) AS n, count(command) AS n_commands, count(action) AS n_actions FROM step GROUP BY type")
def _(t):
    return M.steps(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("command").alias("n_commands"), F.count("action").alias("n_actions"))


@register("op_12_ignored_steps", "d1", "SELECT count(*) AS n FROM (SELECT DISTINCT workflow, job_id, step_index FROM d1 WHERE kind = 'step' EXCEPT SELECT workflow, job_id, step_index FROM d1 WHERE kind IN ('uses-step', 'uses-argument', 'run-step'))")
def _(t):
    key = ["workflow", "job_id", "step_index"]
    return of_kind(t, "step").select(*key).distinct().join(M.steps(t).select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


@register("op_13_expressions", "d1", "SELECT name AS raw, detail AS normalized, line, count(*) AS n FROM d1 WHERE kind = 'expression' GROUP BY ALL")
def _(t):
    return M.expressions(t).groupBy("raw", "normalized", "line").agg(F.count(F.lit(1)).alias("n"))


@register("op_14_attached_steps", "step job", "SELECT workflow, job_id, string_agg(step_index || ':' || type, ',' ORDER BY step_index::INT) AS steps FROM step JOIN job USING (workflow, job_id) GROUP BY ALL")
def _(t):
    return M.attached_steps(t).groupBy("workflow", "job_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_order", "step_index", "type"))), lambda x: F.concat_ws(":", x.step_index, x.type)), ",").alias("steps"))


for _nn, _kind, _columns in ((15, "cacheWriteIntent", "key, path"), (16, "cacheReadIntent", "key, path"), (17, "artifactWriteIntent", "name, path"), (18, "artifactReadIntent", "name, path, run_id")):
    register(f"op_{_nn}_{V.snake(_kind)}", "op", f"SELECT workflow, op_id, {_columns} FROM op WHERE op_kind = '{_kind}'")(
        lambda t, k=_kind, c=_columns: M.operations(t).where(F.col("op_kind") == k).select("workflow", "op_id", *c.split(", ")))


@register("op_19_operations", "op", "SELECT workflow, op_id, op_kind, job_id, step_index, key, path, name, run_id FROM op")
def _(t):
    return M.operations(t).drop("job_seq", "step_order")


S.cte("document", "d1 job step op ev head", """
SELECT h.workflow, to_json({'schemaVersion': '0.1.0', 'source': {'type': 'codeqlTable', 'file': 'table', 'staticAnalysisOnly': true}, 'workflow': h.workflow, 'file': h.file,
  'events': coalesce(e.l, []), 'permissions': coalesce(p.l, []), 'jobs': coalesce(j.l, []), 'expressions': coalesce(x.l, []), 'operations': coalesce(o.l, []),
  'verificationFacts': {'sameObject': 'unknown', 'consumerUsesObject': 'unknown', 'integrityVerified': 'unknown', 'privilegedConsumer': 'unknown', 'hasAuthority': 'unknown'}, 'runtimeObservations': []})::VARCHAR AS document
FROM head h
LEFT JOIN (SELECT e.workflow, list({'name': event, 'externallyTriggerable': external, 'privileged': privileged, 'properties': CASE WHEN v.l IS NULL THEN MAP {} ELSE MAP {'workflows': v.l} END} ORDER BY row_seq) AS l
  FROM ev e LEFT JOIN (SELECT workflow, list(detail ORDER BY row_seq) AS l FROM d1 WHERE kind = 'event-property' GROUP BY workflow) v ON v.workflow = e.workflow AND e.event = 'workflow_run' GROUP BY e.workflow) e ON e.workflow = h.workflow
LEFT JOIN (SELECT workflow, list({'jobId': nullif(job_id, '-'), 'scope': trim(split_part(detail, ':', 1)), 'access': trim(split_part(detail, ':', 2))} ORDER BY row_seq) AS l FROM d1 WHERE kind = 'permission' GROUP BY workflow) p ON p.workflow = h.workflow
LEFT JOIN (SELECT j.workflow, list({'id': j.job_id, 'runnerLabels': [label], 'steps': coalesce(s.l, [])} ORDER BY job_seq) AS l FROM job j LEFT JOIN (
  SELECT workflow, job_id, list({'index': step_index::INT, 'type': type, 'action': action, 'version': version, 'arguments': CASE WHEN type = 'uses' THEN map_from_entries(list_filter(
    [{'k': 'path', 'v': arg_path}, {'k': 'key', 'v': arg_key}, {'k': 'name', 'v': arg_name}, {'k': 'run-id', 'v': arg_run}], lambda a: a.v IS NOT NULL)) END, 'command': command} ORDER BY step_index::INT) AS l FROM step GROUP BY ALL) s
  ON s.workflow = j.workflow AND s.job_id = j.job_id GROUP BY j.workflow) j ON j.workflow = h.workflow
LEFT JOIN (SELECT workflow, list({'raw': name, 'normalized': detail, 'line': line} ORDER BY row_seq) AS l FROM d1 WHERE kind = 'expression' GROUP BY workflow) x ON x.workflow = h.workflow
LEFT JOIN (SELECT workflow, list({'id': op_id, 'kind': op_kind, 'jobId': o.job_id, 'stepIndex': step_index::INT, 'key': key, 'path': path, 'name': name, 'runId': run_id}
  ORDER BY job_seq, step_index::INT, CASE op_kind WHEN 'cacheWriteIntent' THEN 1 WHEN 'cacheReadIntent' THEN 2 ELSE 3 END) AS l FROM op o JOIN job USING (workflow, job_id) GROUP BY workflow) o ON o.workflow = h.workflow""")


@register("op_20_documents", "document", "SELECT workflow, sha256(document) AS digest, length(document)::INT AS n FROM document")
def _(t):
    """The whole nested document of each workflow, by its digest."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return M.documents(t).select("workflow", body.alias("d")).select("workflow", F.sha2("d", 256).alias("digest"), F.length("d").alias("n"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observed results of the operations of the job with their id: error is failed, purchase succeeded, all else not known."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("concat('wf-', user_id) AS workflow", "concat('cache-write:', event_id, ':1') AS op_id", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'unknown' END AS outcome")


S.cte("observed", "", "SELECT 'wf-' || user_id AS workflow, 'cache-write:' || event_id || ':1' AS op_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'unknown' END AS outcome FROM events")


@register_on("op_21_unknown_observed", "observed op", "SELECT workflow, op_id, outcome FROM observed o WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.workflow = o.workflow AND op.op_id = o.op_id)")
def _(spark, sf_dir):
    return M.unknown_observed(M.operations(extraction(spark, sf_dir)), observed(spark, sf_dir)).select("workflow", "op_id", "outcome")


# Pairs

@register("op_23_grouped_models", "d1 op", "SELECT d.workflow, count(*) AS n_rows, (SELECT count(*) FROM op o WHERE o.workflow = d.workflow) AS n_ops FROM d1 d GROUP BY d.workflow")
def _(t):
    ops = M.operations(t).groupBy("workflow").agg(F.count(F.lit(1)).alias("n_ops"))
    return t.groupBy("workflow").agg(F.count(F.lit(1)).alias("n_rows")).join(ops, "workflow", "left").na.fill(0)


@register("op_23_updated_pairs", "pair", "SELECT id, producer, consumer, pairing FROM pair")
def _(t):
    """Pairs of a store made of an older table, in which some workflows differ, some are missing and some are more, and then brought up to date."""
    n = "cast(substring(workflow, 4) AS bigint)"
    older = t.where(f"{n} % 31 <> 0").withColumn("detail", F.expr(f"CASE WHEN {n} % 37 = 0 AND kind = 'uses-argument' AND name = 'name' THEN concat(detail, '-old') ELSE detail END"))
    older = older.unionByName(t.where(f"{n} % 29 = 0").withColumn("workflow", F.concat("workflow", F.lit("000000"))))
    store = f"{shared_folder(t.sparkSession)}/store-{uuid.uuid4().hex}"
    U.update(older, store)
    U.update(t, store)
    return U.read(t.sparkSession, store, "pairs").select("id", "producer", "consumer", "pairing")


@register("op_24_normalized_run_ids", "op", "SELECT run_id, regexp_extract(trim(run_id), '^\\$\\{\\{\\s*(.*?)\\s*\\}\\}$', 1) AS normalized, count(*) AS n FROM op WHERE run_id IS NOT NULL GROUP BY ALL")
def _(t):
    return M.operations(t).where("run_id IS NOT NULL").groupBy("run_id", X.normalized_expression(F.col("run_id")).alias("normalized")).agg(F.count(F.lit(1)).alias("n"))


@register("op_25_operations_by_kind", "op", "SELECT op_kind, count(*) AS n, count(DISTINCT workflow) AS n_workflows FROM op GROUP BY op_kind")
def _(t):
    return M.operations(t).groupBy("op_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("workflow").alias("n_workflows"))


@register("op_26_readers_after_runs", "op ev", "SELECT workflow, op_id FROM op WHERE op_kind = 'artifactReadIntent' AND EXISTS (SELECT 1 FROM ev WHERE ev.workflow = op.workflow AND event = 'workflow_run')")
def _(t):
    return M.operations(t).where("op_kind = 'artifactReadIntent'").join(M.events(t).where("event = 'workflow_run'"), "workflow", "left_semi").select("workflow", "op_id")


@register("op_27_trigger_targets", "target", "SELECT workflow, target FROM target")
def _(t):
    return P.trigger_targets(t)


@register("op_28_pairing_join", "pair", "SELECT producer, producer_op, consumer, consumer_op, name FROM pair")
def _(t):
    return pairs_of(t).select("producer", "producer_op", "consumer", "consumer_op", "name")


@register("op_29_pairing_status", "pair", "SELECT pairing, count(*) AS n, count(DISTINCT (consumer, consumer_op)) AS n_reads FROM pair GROUP BY pairing")
def _(t):
    return pairs_of(t).groupBy("pairing").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("consumer", "consumer_op").alias("n_reads"))


@register("op_30_match_basis", "pair", f"SELECT id, '{'|'.join(P.MATCH_BASIS)}' AS basis FROM pair")
def _(t):
    return pairs_of(t).select("id", F.array_join(F.array(*[F.lit(b) for b in P.MATCH_BASIS]), "|").alias("basis"))


@register("op_31_candidate_ids", "pair", "SELECT id, pairing, producer_file, consumer_file FROM pair")
def _(t):
    return pairs_of(t).select("id", "pairing", "producer_file", "consumer_file")


_BASIS = ", ".join(f"'{b}'" for b in P.MATCH_BASIS)


@register("op_32_catalog", "pair", f"""SELECT id, to_json({{'id': id, 'pairingStatus': pairing, 'producer': {{'workflow': producer, 'file': producer_file, 'operationId': producer_op}},
  'consumer': {{'workflow': consumer, 'file': consumer_file, 'operationId': consumer_op}}, 'sharedObject': {{'kind': 'artifact', 'name': name, 'consumerRunSelector': 'github.event.workflow_run.id', 'triggerWorkflow': producer}},
  'matchBasis': [{_BASIS}]}})::VARCHAR AS document FROM pair""")
def _(t):
    return P.catalog(pairs_of(t))


def scenarios(t: DataFrame) -> DataFrame:
    """Every named pair of workflows as a scenario to look up."""
    targets = P.trigger_targets(t)
    return targets.select(F.concat_ws(">", "target", "workflow").alias("scenario"), F.col("target").alias("producer"), F.col("workflow").alias("consumer"))


@register("op_33_scenario_lookup", "target pair", """SELECT target || '>' || workflow AS scenario, count(id) AS n_candidates, count(*) FILTER (pairing = 'unique') AS n_unique,
  CASE WHEN count(id) = 1 AND count(*) FILTER (pairing = 'unique') = 1 THEN min(id) END AS chosen FROM target LEFT JOIN pair ON producer = target AND consumer = workflow GROUP BY scenario""")
def _(t):
    return P.found_for(scenarios(t), pairs_of(t))


# Chains

_FACT_LIST = ", ".join(f'"{f}"' for f in V.CHAIN_FACTS)


@register("op_36_annotated_chains", "chain", f"SELECT id, pairing, {_FACT_LIST} FROM chain")
def _(t):
    return chains_of(t).select("id", "pairing", *V.CHAIN_FACTS)


@register("op_35_missing_facts", "chain", """SELECT scenario, fact FROM (SELECT id AS scenario, unnest(['writeAuthorized', 'writeSucceeded', 'readSucceeded', 'consumerUsesObject', 'integrityCheckPresent', 'integrityCheckPassed', 'hasAuthority']) AS fact,
  "hasAuthority" AS a FROM chain) WHERE fact = 'hasAuthority' AND a = 'unknown'""")
def _(t):
    """A scenario states the facts it knows; here authority is left out where it is unknown."""
    known = [n for n in C.ANNOTATED if n != "hasAuthority"]
    base = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in known])
    more = F.when(F.col("hasAuthority") != "unknown", F.array(F.struct(F.lit("hasAuthority").alias("key"), F.col("hasAuthority").alias("value")))).otherwise(F.array())
    return C.missing_facts(chains_of(t).select("id", F.map_from_entries(F.concat(base, more)).alias("facts")))


@register("op_45_single_events", "ev", "SELECT workflow, min(event) AS event, min(external) AS external, min(privileged) AS privileged FROM ev GROUP BY workflow HAVING count(*) = 1")
def _(t):
    return C.only_event(t)


@register("op_47_producer_trust", "chain", "SELECT \"producerUntrusted\", \"privilegedConsumer\", count(*) AS n FROM chain GROUP BY ALL")
def _(t):
    return chains_of(t).groupBy("producerUntrusted", "privilegedConsumer").agg(F.count(F.lit(1)).alias("n"))


@register("op_44_operation_lookup", "op", """WITH twice AS (SELECT workflow, op_id FROM op UNION ALL SELECT workflow, op_id FROM op WHERE step_index = '2'),
wanted AS (SELECT DISTINCT workflow, op_id || CASE WHEN step_index = '3' THEN '-gone' ELSE '' END AS op_id FROM op)
SELECT w.workflow, w.op_id, count(t.op_id) AS n FROM wanted w LEFT JOIN twice t ON w.workflow = t.workflow AND w.op_id = t.op_id GROUP BY ALL""")
def _(t):
    """How many operations each name stands for: some stand twice, and some names are of none."""
    ops = stored(M.operations(t).select("workflow", "op_id", "step_index"), "operations")
    wanted = ops.select("workflow", F.concat("op_id", F.when(F.col("step_index") == "3", "-gone").otherwise("")).alias("op_id")).distinct()
    return C.lookup_counts(wanted, ops.unionByName(ops.where("step_index = '2'")))


@register("op_46_endpoints", "chain", "SELECT id, producer, producer_file, producer_event, producer_op, consumer, consumer_file, consumer_event, consumer_op FROM chain")
def _(t):
    return chains_of(t).select("id", "producer", "producer_file", "producer_event", "producer_op", "consumer", "consumer_file", "consumer_event", "consumer_op")


@register("op_49_shared_name", "pair op", "SELECT p.id, w.name IS NOT DISTINCT FROM r.name AS same_name FROM pair p JOIN op w ON w.workflow = producer AND w.op_id = producer_op JOIN op r ON r.workflow = consumer AND r.op_id = consumer_op")
def _(t):
    ops = artifact_operations(t)
    side = lambda s: ops.select(F.col("workflow").alias(s), F.col("op_id").alias(f"{s}_op"), F.col("name").alias(f"{s}_name"))
    pairs = P.candidates(t, ops).select("id", "producer", "producer_op", "consumer", "consumer_op")
    return pairs.join(side("producer"), ["producer", "producer_op"]).join(side("consumer"), ["consumer", "consumer_op"]).select("id", F.col("producer_name").eqNullSafe(F.col("consumer_name")).alias("same_name"))


def traced(t: DataFrame) -> DataFrame:
    return chains_of(t).select("id", F.inline("places"))


_PLACES = """SELECT id, stage, ord, CASE WHEN ord < 2 THEN producer_file ELSE consumer_file END AS file, CASE WHEN ord < 2 THEN producer ELSE consumer END AS workflow,
  CASE WHEN ord < 2 THEN producer_job WHEN ord = 5 AND pairing = 'unique' THEN 'deploy' ELSE consumer_job END AS job_id,
  CASE WHEN ord < 2 THEN producer_step ELSE (consumer_step::INT + greatest(ord - 2, 0))::VARCHAR END AS step_index, meaning
FROM chain, (VALUES """ + ", ".join(f"({i}, '{s}', '{C.MEANINGS.get(s, '権限へ到達する．')}')" for i, s in enumerate(V.STAGES)) + ") s(ord, stage, meaning)"
S.cte("place", "chain", _PLACES)


@register("op_51_trace_map", "place", "SELECT * FROM place")
def _(t):
    return traced(t)


@register("op_52_location_jobs", "place", "SELECT stage, count(*) AS n, count(*) FILTER (job_id = 'deploy') AS n_own_job FROM place GROUP BY stage")
def _(t):
    return traced(t).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("job_id") == "deploy").alias("n_own_job"))


def recorded(chains: DataFrame) -> DataFrame:
    """Chains with the records of their elements; what annotations would give has its kind of source by a number."""
    kind = F.expr(f"CASE {S.SEED} % 2 WHEN 0 THEN 'manual-judgment' ELSE 'runtime-observation' END")
    names = [f"facts.{n}" for n in C.ANNOTATED] + [f"traceMap.{s}" for s in C.PLACES]
    return chains.withColumn("records", C.provenance("table.csv", "annotations.json", "pairing", F.array(*[C.record(n, kind, "run", "claim") for n in names])))


@register("op_38_provenance_kinds", "chain", f"""SELECT id, 46::BIGINT AS n, 31::BIGINT AS n_static, (5 + CASE {S.SEED} % 2 WHEN 0 THEN 10 ELSE 0 END)::BIGINT AS n_manual,
  (CASE {S.SEED} % 2 WHEN 0 THEN 0 ELSE 10 END)::BIGINT AS n_runtime FROM chain""")
def _(t):
    n = lambda k: F.count_if(F.col("source_kind") == k)
    return recorded(chains_of(t)).select("id", F.inline("records")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), n("static-analysis").alias("n_static"), n("manual-judgment").alias("n_manual"), n("runtime-observation").alias("n_runtime"))


@register("op_39_fact_provenance", "chain", f"""SELECT element, source_kind, count(*) AS n FROM (
  SELECT 'facts.' || unnest([{', '.join(repr(n) for n in C.ANNOTATED)}]) AS element, CASE {S.SEED} % 2 WHEN 0 THEN 'manual-judgment' ELSE 'runtime-observation' END AS source_kind FROM chain
  UNION ALL SELECT 'facts.' || unnest([{', '.join(repr(n) for n in C.STATIC_FACTS)}]), 'static-analysis' FROM chain) GROUP BY ALL""")
def _(t):
    return recorded(chains_of(t)).select(F.inline("records")).where("element LIKE 'facts.%'").groupBy("element", "source_kind").agg(F.count(F.lit(1)).alias("n"))


@register("op_40_required_elements", "chain", f"SELECT id, unnest([{', '.join(repr(e) for e in C.required_elements())}]) AS element FROM chain")
def _(t):
    """The elements that the records of each chain cover; they are the required ones."""
    return recorded(chains_of(t)).select("id", F.inline("records")).select("id", "element")


@register("op_41_provenance_faults", "chain", """SELECT id, 'missing' AS rule, 'facts.hasAuthority' AS element FROM chain WHERE "hasAuthority" = 'unknown'
  UNION ALL SELECT id, 'duplicate', 'facts.writeIntent' FROM chain WHERE "hasAuthority" = 'false'""")
def _(t):
    """Two faults are planted: authority without a source where it is unknown, write intent with two where there is none."""
    lost = F.filter("records", lambda r: (F.col("hasAuthority") != "unknown") | (r.element != "facts.hasAuthority"))
    extra = F.when(F.col("hasAuthority") == "false", F.array(C.record("facts.writeIntent", "static-analysis", "s", "c"))).otherwise(F.array())
    return recorded(chains_of(t)).select("id", F.concat(lost, extra).alias("records")).select("id", F.inline(C.provenance_faults(F.col("records"))))


@register("op_50_fact_counts", "chain", "SELECT fact, value, count(*) AS n FROM (UNPIVOT (SELECT " + _FACT_LIST + " FROM chain) ON COLUMNS(*) INTO NAME fact VALUE value) GROUP BY ALL")
def _(t):
    rows = F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value")) for f in V.CHAIN_FACTS])
    return chains_of(t).select(F.inline(rows)).groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n"))


# Verdicts

@register("op_54_bad_facts", "chain", "SELECT id, 'hasAuthority' AS fact, 'maybe' AS value FROM chain WHERE \"hasAuthority\" = 'unknown'")
def _(t):
    return C.bad_facts(chains_of(t).withColumn("hasAuthority", F.when(F.col("hasAuthority") == "unknown", "maybe").otherwise(F.col("hasAuthority"))))


_NAMES = lambda sign: "concat_ws(',', " + ", ".join(f"CASE WHEN \"{f}\" {sign} 'unknown' THEN '{V.snake(f)}' END" for f in V.CHAIN_FACTS) + ")"


@register("op_56_known_and_unknown", "chain", f"SELECT id, {_NAMES('<>')} AS known, {_NAMES('=')} AS unknown FROM chain")
def _(t):
    names = lambda test: F.concat_ws(",", *[F.when(test(F.col(f)), F.lit(V.snake(f))) for f in V.CHAIN_FACTS])
    return chains_of(t).select("id", names(lambda c: c != "unknown").alias("known"), names(lambda c: c == "unknown").alias("unknown"))


_FINAL = """CASE WHEN NOT ("producerUntrusted" = 'true' AND "writeIntent" = 'true' AND "writeAuthorized" = 'true' AND "writeSucceeded" = 'true') THEN 'blocked'
  WHEN NOT ("sameObject" = 'true' AND "readSucceeded" = 'true') THEN 'blocked' WHEN "integrityCheckPresent" = 'true' AND "integrityCheckPassed" <> 'true' THEN 'blocked'
  WHEN "consumerUsesObject" <> 'true' THEN 'blocked' WHEN NOT ("privilegedConsumer" = 'true' AND "hasAuthority" = 'true') THEN 'blocked' ELSE 'authority_reached' END"""


@register("op_57_final_stages", "chain", f"SELECT id, {_FINAL} AS final_stage FROM chain")
def _(t):
    return chains_of(t).select("id", V.final_stage().alias("final_stage"))


@register("op_59_consistency", "chain", f"SELECT {S.CONSISTENT} AS consistent, count(*) AS n FROM chain GROUP BY ALL")
def _(t):
    return chains_of(t).groupBy(V.chain_consistent().alias("consistent")).agg(F.count(F.lit(1)).alias("n"))


@register("op_60_chain_verdicts", "chain", f"SELECT id, {S.UNSAFE} AS unsafe, {S.CONSISTENT} AS consistent, CASE WHEN {S.UNSAFE} THEN 'start>object_written>object_restored>object_used>authority_reached' END AS witness FROM chain")
def _(t):
    return chains_of(t).select("id", V.chain_unsafe().alias("unsafe"), V.chain_consistent().alias("consistent"), F.array_join(V.witness(), ">").alias("witness"))


S.cte("model_text", "chain place", """SELECT c.id, '-- Generated from chain.json\n-- Scenario: ' || c.id || '\n' || (SELECT string_agg('-- TRACE ' || stage || ': ' || file || ':' || job_id || ':' || step_index || ' - ' || meaning, '\n' ORDER BY ord) FROM place p WHERE p.id = c.id)
  || '\nMODULE main\n' || CASE WHEN """ + " OR ".join(f"\"{f}\" = 'unknown'" for f in V.CHAIN_FACTS) + " THEN 'FROZENVAR\n' || " + " || ".join(f"CASE WHEN \"{f}\" = 'unknown' THEN '  {V.snake(f)} : boolean;\n' ELSE '' END" for f in V.CHAIN_FACTS)
  + f" ELSE '' END || '{V.CHAIN_HEAD}\nDEFINE\n' || " + " || ".join(f"CASE WHEN \"{f}\" <> 'unknown' THEN '  {V.snake(f)} := ' || upper(\"{f}\") || ';\n' ELSE '' END" for f in V.CHAIN_FACTS)
  + f" || '{V.CHAIN_TAIL}' AS text FROM chain c")


@register("op_61_chain_models", "model_text", "SELECT id, sha256(text) AS digest, length(text)::INT AS n FROM model_text")
def _(t):
    text = V.chain_model(F.lit("chain.json"), F.col("id"), C.trace_lines(F.col("places")))
    return chains_of(t).select("id", text.alias("text")).select("id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


def cache_facts(t: DataFrame) -> DataFrame:
    """Cache writes with eight facts bound to their numbers."""
    seed = "(cast(job_id AS bigint) + cast(step_index AS bigint))"
    names = [f for f in V.CACHE_FACTS if f not in ("write_intent", "integrity_verified")]
    bound = {n: F.expr(S.fact(seed, 3 * i, 5)) for i, n in enumerate(names)}
    bound |= {"write_intent": F.lit("true"), "integrity_verified": F.expr(S.fact(seed, 1, 3, "true", "false"))}
    return M.operations(t).where("op_kind = 'cacheWriteIntent'").select("workflow", "op_id", *[bound[n].alias(n) for n in V.CACHE_FACTS])


S.cte("cache_fact", "op", "SELECT workflow, op_id, 'true' AS write_intent, " + ", ".join(
    f"{S.fact('(job_id::BIGINT + step_index::BIGINT)', 3 * i, 5)} AS {n}" for i, n in enumerate(f for f in V.CACHE_FACTS if f not in ("write_intent", "integrity_verified")))
    + f", {S.fact('(job_id::BIGINT + step_index::BIGINT)', 1, 3, 'true', 'false')} AS integrity_verified FROM op WHERE op_kind = 'cacheWriteIntent'")
_CACHE_UNSAFE = "(" + " AND ".join(f"{f} <> 'false'" for f in V.CACHE_FACTS if f != "integrity_verified") + " AND integrity_verified <> 'true')"
_CACHE_ALWAYS = """(write_intent <> 'false' AND write_authorized <> 'false' AND write_succeeded = 'true' AND same_object = 'true' AND consumer_uses_object = 'true' AND privileged_consumer = 'true'
  AND has_authority = 'true' AND integrity_verified = 'false')"""


@register("op_62_single_cache_write", "op", "SELECT workflow, count(*) AS n_writes, CASE WHEN count(*) = 1 THEN min(op_id) END AS chosen FROM op WHERE op_kind = 'cacheWriteIntent' GROUP BY workflow")
def _(t):
    writes = M.operations(t).where("op_kind = 'cacheWriteIntent'").groupBy("workflow").agg(F.count(F.lit(1)).alias("n_writes"), F.min("op_id").alias("m"))
    return writes.select("workflow", "n_writes", F.when(F.col("n_writes") == 1, F.col("m")).alias("chosen"))


@register_on("op_64_runtime_facts", "op observed", """SELECT o.workflow, o.op_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'false' WHEN 'HOUSEHOLD' THEN 'true' ELSE 'unknown' END AS write_authorized,
  CASE count(outcome) WHEN 0 THEN 'unknown' WHEN 1 THEN CASE max(outcome) WHEN 'succeeded' THEN 'true' WHEN 'failed' THEN 'false' ELSE 'unknown' END END AS write_succeeded, count(outcome) AS n_results
  FROM op o LEFT JOIN (SELECT workflow, 'cache-write:' || split_part(op_id, ':', 2) || ':1' AS op_id, outcome FROM observed) r USING (workflow, op_id) JOIN customer ON 'wf-' || c_custkey = o.workflow
  WHERE op_kind = 'cacheWriteIntent' GROUP BY ALL""")
def _(spark, sf_dir):
    policies = table(spark, sf_dir, "customer").selectExpr("concat('wf-', c_custkey) AS workflow", "CASE c_mktsegment WHEN 'BUILDING' THEN 'denied' WHEN 'HOUSEHOLD' THEN 'allowed' ELSE 'unknown' END AS decision")
    return V.runtime_facts(M.operations(extraction(spark, sf_dir)).where("op_kind = 'cacheWriteIntent'"), policies, observed(spark, sf_dir))


@register("op_65_cache_facts", "cache_fact", f"SELECT workflow, op_id, {', '.join(V.CACHE_FACTS)} FROM cache_fact")
def _(t):
    return cache_facts(t)


@register("op_66_cache_verdicts", "cache_fact", f"""SELECT workflow, op_id, {_CACHE_UNSAFE} AS unsafe, NOT (write_succeeded = 'true' AND (write_intent = 'false' OR write_authorized = 'false')) AS consistent,
  CASE WHEN {_CACHE_ALWAYS} THEN 'unsafe' WHEN {_CACHE_UNSAFE} THEN 'incomplete' ELSE 'blocked' END AS class FROM cache_fact""")
def _(t):
    return cache_facts(t).select("workflow", "op_id", V.cache_unsafe().alias("unsafe"), V.cache_consistent().alias("consistent"), V.cache_class().alias("class"))


@register("op_68_cache_models", "cache_fact", "SELECT workflow, op_id, sha256('-- Generated from model.json\n" + V.CACHE_NOTE + "\nMODULE main\n' || CASE WHEN " + " OR ".join(f"{f} = 'unknown'" for f in V.CACHE_FACTS)
          + " THEN 'FROZENVAR\n' || " + " || ".join(f"CASE WHEN {f} = 'unknown' THEN '  {f} : boolean;\n' ELSE '' END" for f in V.CACHE_FACTS) + f" ELSE '' END || '{V.CACHE_HEAD}\nDEFINE\n' || "
          + " || ".join(f"CASE WHEN {f} <> 'unknown' THEN '  {f} := ' || upper({f}) || ';\n' ELSE '' END" for f in V.CACHE_FACTS) + f" || '{V.CACHE_TAIL}') AS digest FROM cache_fact")
def _(t):
    return cache_facts(t).select("workflow", "op_id", F.sha2(V.cache_model(F.lit("model.json")), 256).alias("digest"))


# Evaluation and explanation

def outputs(t: DataFrame) -> DataFrame:
    """What a checker prints for each chain."""
    bad = V.chain_unsafe()
    trace = F.concat(*[F.lit(f"-> State: 1.{i + 1} <-\n  stage = {s}\n" + ("  stage = start\n" if i == 0 else "")) for i, s in enumerate(V.WITNESS)])
    spec = F.concat(F.lit("*** checker\n" + E.SPEC_LINE + "(stage = authority_reached & object_tainted)  is "), F.when(bad, "false").otherwise("true"), F.lit("\n"))
    return chains_of(t).select("id", "places", V.chain_class().alias("class"), F.concat(spec, F.when(bad, trace).otherwise("")).alias("output"))


@register("op_70_parsed_verdicts", "chain", f"SELECT id, CASE WHEN {S.UNSAFE} THEN 'unsafe' ELSE 'safe' END AS verdict FROM chain")
def _(t):
    return outputs(t).select("id", E.verdict(F.col("output")).alias("verdict"))


S.cte("judged", "chain", f"SELECT id, CASE WHEN {S.ALWAYS} THEN 'unsafe' ELSE 'safe' END AS expected, CASE WHEN {S.UNSAFE} THEN 'unsafe' ELSE 'safe' END AS actual FROM chain")


def cases(t: DataFrame) -> DataFrame:
    return E.judged(outputs(t).select("id", F.when(F.col("class") == "unsafe", "unsafe").otherwise("safe").alias("expected"), E.verdict(F.col("output")).alias("actual")))


@register("op_71_judged_cases", "judged", "SELECT id, expected, actual, expected = actual AS correct FROM judged")
def _(t):
    return cases(t)


@register("op_72_confusion_summary", "judged", """SELECT count(*) AS total, count(*) FILTER (expected = actual) AS correct, count(*) FILTER (expected = actual) / count(*) AS accuracy, count(*) FILTER (expected = 'unsafe' AND actual = 'unsafe') AS true_positive,
  count(*) FILTER (expected = 'safe' AND actual = 'safe') AS true_negative, count(*) FILTER (expected = 'safe' AND actual = 'unsafe') AS false_positive, count(*) FILTER (expected = 'unsafe' AND actual = 'safe') AS false_negative FROM judged""")
def _(t):
    return E.summary(cases(t))


@register("op_74_stage_traces", "chain", f"SELECT id, o::INT AS ord, s AS stage FROM chain, (VALUES {', '.join(f'({i + 1}, {s!r})' for i, s in enumerate(V.WITNESS))}) w(o, s) WHERE {S.UNSAFE}")
def _(t):
    return E.stage_trace(outputs(t), "id", "output")


@register_on("op_74_role_runs", "", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS ord, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role""")
def _(spark, sf_dir):
    """The same collapse of repeats on turns of conversations."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).where(~F.col("before").eqNullSafe(F.col("role")))
    return c.select("conv_id", F.row_number().over(w).alias("ord"), "role")


@register("op_75_violated", "chain", f"SELECT {S.UNSAFE} AS violated, count(*) AS n FROM chain GROUP BY ALL")
def _(t):
    return outputs(t).groupBy(E.violated(F.col("output")).alias("violated")).agg(F.count(F.lit(1)).alias("n"))


_EXPLAINED = f"SELECT id, o::INT AS ord, stage, file, job_id, step_index, meaning FROM chain JOIN place USING (id) JOIN (VALUES {', '.join(f'({i + 1}, {s!r})' for i, s in enumerate(V.WITNESS))}) w(o, stage) USING (stage) WHERE {S.UNSAFE}"


@register("op_76_explained_traces", "chain place", _EXPLAINED)
def _(t):
    return outputs(t).select("id", F.inline(E.explained(F.col("output"), F.col("places")))).drop("workflow")


S.cte("explained", "chain place", _EXPLAINED)


@register("op_77_markdown", "chain explained", f"""SELECT c.id, sha256('# ' || c.id || '{E.TITLE}\n\n{E.SAFETY}' || CASE WHEN {S.UNSAFE} THEN '{E.VIOLATED}' ELSE '{E.HELD}' END || '\n\n' ||
  CASE WHEN {S.UNSAFE} THEN '{E.TABLE_HEAD}\n' || (SELECT string_agg('| ' || ord || ' | `' || stage || '` | `' || file || '` | `' || job_id || '` | ' || step_index || ' | ' || meaning || ' |', '\n' ORDER BY ord) FROM explained e WHERE e.id = c.id) || '\n'
  ELSE '{E.NO_TRACE}\n' END) AS digest FROM chain c""")
def _(t):
    return outputs(t).select("id", F.sha2(E.markdown(F.col("id"), F.col("output"), F.col("places")), 256).alias("digest"))


# What tests and documents of the subject specify

@register_on("op_t1_same_artifact", "", """SELECT l_orderkey::VARCHAR || ':' || l_linenumber AS consumer_id, o_orderkey AS run_id, l_partkey % 7 = o_custkey % 7 AS same_artifact_id, l_suppkey % 3 = o_custkey % 3 AS same_digest, l_linestatus = o_orderstatus AS same_payload,
  l_partkey % 7 = o_custkey % 7 AND l_suppkey % 3 = o_custkey % 3 AND l_linestatus = o_orderstatus AS same_object FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    producers = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "o_custkey % 7 AS artifact_id", "o_custkey % 3 AS digest", "o_orderstatus AS payload")
    consumers = table(spark, sf_dir, "lineitem").selectExpr("concat_ws(':', l_orderkey, l_linenumber) AS consumer_id", "l_orderkey AS run_id", "l_partkey % 7 AS artifact_id", "l_suppkey % 3 AS digest", "l_linestatus AS payload")
    return I.same_artifact(producers, consumers)


@register_on("op_t2_payload_digests", "", "SELECT p_partkey, sha256(p_name || chr(10)) AS digest FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", I.payload_digest(F.col("p_name")).alias("digest"))


@register("op_s1_violations", "chain", f"SELECT producer, consumer, count(*) AS n FROM chain WHERE {S.UNSAFE} GROUP BY ALL")
def _(t):
    return chains_of(t).where(V.chain_unsafe()).groupBy("producer", "consumer").agg(F.count(F.lit(1)).alias("n"))


@register("op_s2_blocking_conditions", "chain", """SELECT id, CASE WHEN "producerUntrusted" = 'false' THEN 'producer trusted' WHEN "writeIntent" = 'false' OR "writeAuthorized" = 'false' OR "writeSucceeded" = 'false' THEN 'write denied'
  WHEN "sameObject" = 'false' OR "readSucceeded" = 'false' THEN 'object not restored' WHEN "integrityCheckPresent" = 'true' THEN 'integrity checked' WHEN "consumerUsesObject" = 'false' THEN 'object not used'
  WHEN "privilegedConsumer" = 'false' OR "hasAuthority" = 'false' THEN 'no authority' END AS blocked_by FROM chain""")
def _(t):
    return chains_of(t).select("id", V.blocking_condition().alias("blocked_by"))


@register("op_s4_outcome_classes", "chain", f"SELECT pairing, {S.CLASS} AS class, count(*) AS n FROM chain GROUP BY ALL")
def _(t):
    return chains_of(t).groupBy("pairing", V.chain_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("op_s5_default_cache_writers", "op ev", f"SELECT o.workflow, o.op_id FROM op o WHERE op_kind = 'cacheWriteIntent' AND EXISTS (SELECT 1 FROM ev WHERE ev.workflow = o.workflow AND event IN ({', '.join(repr(e) for e in V.WRITE_EVENTS)}))")
def _(t):
    return M.operations(t).where("op_kind = 'cacheWriteIntent'").join(M.events(t).where(V.may_write_default_cache(F.col("event"))), "workflow", "left_semi").select("workflow", "op_id")


@register("op_s6_tool_matrix", "chain", f"SELECT pairing AS scenario, count(*) FILTER ({S.CLASS} = 'safe') AS safe, count(*) FILTER ({S.CLASS} = 'incomplete') AS incomplete, count(*) FILTER ({S.CLASS} = 'unsafe') AS unsafe FROM chain GROUP BY pairing")
def _(t):
    return E.tool_matrix(chains_of(t).select(F.col("pairing").alias("scenario"), V.chain_class().alias("tool")), ["safe", "incomplete", "unsafe"])


@register("flagship_exposed_paths", "chain", f"SELECT pairing, {S.CLASS} AS class, {S.CONSISTENT} AS consistent, count(*) AS n_paths, count(DISTINCT producer) AS n_producers FROM chain GROUP BY ALL")
def flagship(t):
    """Which untrusted producers reach an authority-bearing consumer unverified?"""
    return chains_of(t).groupBy("pairing", V.chain_class().alias("class"), V.chain_consistent().alias("consistent")).agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("producer").alias("n_producers"))


# Rows of the table as the extraction writes them

@register_on("op_q04_step_ids", "", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax >= 0.04::DOUBLE THEN 'step-' || l_linenumber END, '-') AS step_id FROM lineitem")
def _(spark, sf_dir):
    """Steps without an id of their own have the marker."""
    given = F.when(F.col("l_tax") >= 0.04, F.concat(F.lit("step-"), F.col("l_linenumber").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.or_absent(given).alias("step_id"))


@register("op_q08_emitted_workflow_rows", "d1", "SELECT file_path, workflow, job_id, step_index, kind, name, detail FROM d1 WHERE kind = 'workflow'")
def _(t):
    return M.workflow_table_rows(t)


@register("op_q09_emitted_event_rows", "d1", "SELECT file_path, workflow, job_id, step_index, kind, name, detail FROM d1 WHERE kind = 'event'")
def _(t):
    return M.event_table_rows(t)


# Annotation documents, chain documents and what is wrong with them

#: Scenarios as annotation documents would give them: one for each workflow and each it names, facts and places by numbers.
_SC_SEED = "(3 * cast(substring(producer, 4) AS bigint) + cast(substring(consumer, 4) AS bigint))"
_SC_FACTS = {n: S.fact(_SC_SEED, 2 * i, 7) for i, n in enumerate(C.ANNOTATED)}
_SC_KIND = f"CASE {_SC_SEED} % 2 WHEN 0 THEN 'manual-judgment' ELSE 'runtime-observation' END"
#: Every eleventh scenario lacks a fact, and every thirteenth has one with an unknown kind of source.
_SC_LACKS, _SC_ODD = f"{_SC_SEED} % 11 = 0", f"{_SC_SEED} % 13 = 0"


def annotations_of(targets: DataFrame) -> DataFrame:
    """Rows of documents.scenarios."""
    one = lambda n: f"named_struct('value', {_SC_FACTS[n]}, 'sourceKind', {_SC_KIND if n != 'readSucceeded' else f'CASE WHEN {_SC_ODD} THEN {chr(39)}hearsay{chr(39)} ELSE {_SC_KIND} END'}, 'source', 'run', 'claim', 'claim')"
    facts = ", ".join(f"'{n}', {one(n)}" for n in C.ANNOTATED if n != "hasAuthority")
    place = lambda i: f"named_struct('jobId', CASE {_SC_SEED} % 3 WHEN 0 THEN '' ELSE 'deploy' END, 'stepIndex', cast({_SC_SEED} % 5 + {i} AS int), 'sourceKind', 'manual-judgment', 'source', 'file', 'claim', concat('place ', {i}))"
    places = ", ".join(f"'{p}', {place(i)}" for i, p in enumerate(C.PLACES.values()))
    return targets.selectExpr("workflow AS consumer", "target AS producer").selectExpr(
        "concat(producer, '>', consumer) AS scenario", "producer", "consumer", "concat('from ', producer) AS description", "'observed' AS evidence_status",
        f"CASE WHEN {_SC_LACKS} THEN map({facts}) ELSE map({facts}, 'hasAuthority', {one('hasAuthority')}) END AS facts", f"map({places}) AS locations",
    )


S.cte("scenario", "target", f"""
SELECT target || '>' || workflow AS scenario, target AS producer, workflow AS consumer, {_SC_SEED.replace('producer', 'target').replace('consumer', 'workflow')} AS seed FROM target""")
S.cte("found", "scenario pair", """
SELECT s.scenario, s.producer, s.consumer, s.seed, count(p.id) AS n, count(p.id) FILTER (pairing = 'unique') AS n_unique, min(p.id) AS id FROM scenario s LEFT JOIN pair p ON p.producer = s.producer AND p.consumer = s.consumer GROUP BY ALL""")
_given = lambda n, i: S.fact("f.seed", 2 * i, 7)
S.cte("told", "found pair op ev", f"""
SELECT f.scenario, f.seed, p.*, w.path AS producer_path, r.path AS consumer_path, r.run_id, pe.event AS producer_event, ce.event AS consumer_event,
  CASE WHEN pe.external AND NOT pe.privileged THEN 'true' ELSE 'false' END AS "producerUntrusted", 'true' AS "writeIntent", 'true' AS "sameObject", CASE WHEN ce.privileged THEN 'true' ELSE 'false' END AS "privilegedConsumer",
  {", ".join(f'{S.fact("f.seed", 2 * i, 7)} AS "{n}"' for i, n in enumerate(C.ANNOTATED))}
FROM found f JOIN pair p ON p.id = f.id JOIN op w ON w.workflow = p.producer AND w.op_id = p.producer_op JOIN op r ON r.workflow = p.consumer AND r.op_id = p.consumer_op
JOIN {S._EV1} pe ON pe.workflow = p.producer JOIN {S._EV1} ce ON ce.workflow = p.consumer
WHERE f.n = 1 AND f.n_unique = 1 AND f.seed % 11 <> 0""")


def annotated_of(t: DataFrame) -> DataFrame:
    return stored(D.annotated(annotations_of(P.trigger_targets(t)), pairs_of(t), "table.csv", "annotations.json"), "annotated-chains")


@register("op_34_annotated_values", "told", """SELECT scenario, "writeAuthorized", CASE WHEN seed % 13 = 0 THEN NULL ELSE "readSucceeded" END AS "readSucceeded", "hasAuthority" FROM told""")
def _(t):
    return annotated_of(t).select("scenario", "writeAuthorized", "readSucceeded", "hasAuthority")


_J = lambda record: "{" + ", ".join(f"'{k}': {v}" for k, v in record.items()) + "}"
_END = lambda side, kind, run: _J({
    "workflow": _J({"name": side, "file": f"{side}_file", "event": f"{side}_event"}),
    "operation": _J({"id": f"{side}_op", "kind": f"'{kind}'", "jobId": f"{side}_job", "stepIndex": f"{side}_step::INT", "name": "name", "path": f"{side}_path", "runId": run}),
})
_AT = lambda side, step, meaning, job=None: _J({"workflowFile": f"{side}_file", "workflowName": side, "jobId": job or f"{side}_job", "stepIndex": step, "meaning": meaning})
_Q = lambda text: f"'{text}'"
_REC = lambda element, kind, source, claim: _J({"element": _Q(element), "sourceKind": kind, "source": _Q(source), "claim": _Q(claim)})
_RECORDS = (
    [_REC(f"scenario.{n}", _Q("manual-judgment"), "annotations.json", C.SCENARIO_CLAIM) for n in C.SCENARIO]
    + [_REC(f"{side}.{section}.{n}", _Q("static-analysis"), "table.csv", C.TABLE_CLAIM) for side in ("producer", "consumer") for section, names in (("workflow", C.WORKFLOW), ("operation", C.OPERATION)) for n in names]
    + [_REC(f"sharedObject.{n}", _Q("manual-judgment"), D.TOOL_SOURCE, C.SELECTOR_CLAIM) if n == "producerRunSelector" else _REC(f"sharedObject.{n}", _Q("static-analysis"), "table.csv", C.MATCH_CLAIM) for n in C.SHARED]
    + [_REC(f"facts.{n}", _Q("static-analysis"), "table.csv", C.FACT_CLAIM) for n in C.STATIC_FACTS]
    + [_REC(f"traceMap.{s}", _Q("static-analysis"), "table.csv", C.PLACE_CLAIM) for s in V.STAGES[:3]]
    + [_REC(f"facts.{n}", "CASE seed % 2 WHEN 0 THEN 'manual-judgment' ELSE 'runtime-observation' END", "run", "claim") for n in C.ANNOTATED]
    + [_REC(f"traceMap.{s}", _Q("manual-judgment"), "file", f"place {i}") for i, s in enumerate(C.PLACES)]
)
_DOCUMENT = "to_json(" + _J({
    "schemaVersion": _Q(D.VERSION), "scenario": _J({"id": "scenario", "platform": _Q(D.PLATFORM), "description": "'from ' || producer", "evidenceStatus": _Q("observed")}),
    "producer": _END("producer", "artifactWriteIntent", "NULL::VARCHAR"), "consumer": _END("consumer", "artifactReadIntent", "run_id"),
    "sharedObject": _J({"kind": _Q("artifact"), "producerRunSelector": _Q(D.PRODUCER_RUN), "consumerRunSelector": _Q(X.WORKFLOW_RUN_ID), "identityBasis": "[" + ", ".join(map(_Q, P.MATCH_BASIS)) + "]", "name": "name"}),
    "facts": _J({f: f'"{f}"' for f in V.CHAIN_FACTS}),
    "traceMap": _J({
        "start": _AT("producer", "producer_step::INT", _Q(C.MEANINGS["start"])), "object_written": _AT("producer", "producer_step::INT", _Q(C.MEANINGS["object_written"])),
        "object_restored": _AT("consumer", "consumer_step::INT", _Q(C.MEANINGS["object_restored"])), "object_used": _AT("consumer", "(seed % 5)::INT", _Q(C.MEANINGS["object_used"])),
        "integrity_checked": _AT("consumer", "(seed % 5 + 1)::INT", _Q(C.MEANINGS["integrity_checked"])),
        "authority_reached": _AT("consumer", "(seed % 5 + 2)::INT", _Q("place 2"), "CASE seed % 3 WHEN 0 THEN consumer_job ELSE 'deploy' END"),
    }),
    "evidence": "[" + _J({"kind": _Q("static"), "source": _Q("table.csv"), "claim": _Q(D.EVIDENCE_CLAIM)}) + "]", "provenance": "[" + ", ".join(_RECORDS) + "]",
}) + ")::VARCHAR"


@register("op_43_chain_documents", "told", f"SELECT scenario, {_DOCUMENT} AS document FROM told WHERE seed % 13 <> 0")
def _(t):
    """Whole chain documents from annotations; scenarios with a fault give none."""
    return D.chain_documents(annotated_of(t), "table.csv").select("scenario", "document")


@register("op_42_scenario_files", "told", f"SELECT lower(scenario) || '.json' AS file, sha256({_DOCUMENT}) AS digest FROM told WHERE seed % 13 <> 0")
def _(t):
    return D.chain_documents(annotated_of(t), "table.csv").select("file", F.sha2("document", 256).alias("digest"))


@register("op_37_source_records", "told", "SELECT scenario, 46::INT AS n, seed % 13 = 0 AS odd FROM told")
def _(t):
    faults = C.provenance_faults(F.col("records"))
    return annotated_of(t).select("scenario", F.size("records").alias("n"), F.exists(faults, lambda f: f.rule == "source kind").alias("odd"))


@register("op_t3_exact_provenance", "told", "SELECT scenario, seed % 13 <> 0 AND seed % 2 <> 0 AS exact FROM told")
def _(t):
    """Exactly the required elements and all three kinds of source; scenarios of judgments alone lack one."""
    return annotated_of(t).select("scenario", C.provenance_exact(F.col("records")).alias("exact"))


@register("op_t4_required_facts", "told", f"SELECT scenario, '' AS missing, '' AS more, {len(V.CHAIN_FACTS)}::INT AS n FROM told WHERE seed % 13 <> 0")
def _(t):
    """Fact names of each document against those of its schema, both ways."""
    parsed = D.chain_documents(annotated_of(t), "table.csv").select("scenario", F.json_object_keys(F.get_json_object("document", "$.facts")).alias("k"))
    need = F.array(*[F.lit(f) for f in V.CHAIN_FACTS])
    return parsed.select("scenario", F.array_join(F.array_except(need, "k"), ",").alias("missing"), F.array_join(F.array_except("k", need), ",").alias("more"), F.size("k").alias("n"))


def configs_of(pairs: DataFrame) -> DataFrame:
    """Pairs as a person would configure them; some name an operation that is not there."""
    facts = ", ".join(f"'{n}', {v}" for n, v in S.PAIR_FACTS.items())
    return pairs.where("pairing = 'unique'").selectExpr(
        "id AS scenario", "producer", "consumer", "CASE WHEN cast(consumer_step AS int) = 3 THEN 'gone' ELSE producer_op END AS producer_op", "consumer_op", f"map({facts}, 'sameObject', 'unknown') AS facts",
        "1 AS use_step", "2 AS check_step", "named_struct('jobId', 'deploy', 'stepIndex', 3, 'meaning', 'reached') AS authority",
    )


@register("op_53_configured_chains", "chain", f"""SELECT id AS scenario, producer_file, consumer_file, {', '.join(f'"{f}"' if f != 'sameObject' else "'unknown' AS " + '"sameObject"' for f in V.CHAIN_FACTS)}, 'deploy:3' AS authority
  FROM chain WHERE pairing = 'unique' AND consumer_step <> '3'""")
def _(t):
    ops = artifact_operations(t)
    rows = D.configured(configs_of(P.candidates(t, ops)), ops, M.workflows(t))
    return rows.select("scenario", "producer_file", "consumer_file", *V.CHAIN_FACTS, F.concat_ws(":", F.col("places")[5].job_id, F.col("places")[5].step_index).alias("authority"))


@register("op_58_final_taint", "chain", """SELECT id, "producerUntrusted" = 'true' AND NOT ("writeIntent" = 'true' AND "writeAuthorized" = 'true' AND "writeSucceeded" = 'true' AND "sameObject" = 'true' AND "readSucceeded" = 'true'
  AND "integrityCheckPresent" = 'true' AND "integrityCheckPassed" = 'true') AS tainted FROM chain""")
def _(t):
    return chains_of(t).select("id", V.tainted_at_end().alias("tainted"))


@register("op_73_report", "judged", f"""SELECT to_json({{'schemaVersion': '0.1.0', 'property': '{E.PROPERTY}', 'summary': {{'total': count(*), 'correct': count(*) FILTER (expected = actual), 'accuracy': count(*) FILTER (expected = actual) / count(*),
  'confusionMatrix': {{'truePositive': count(*) FILTER (expected = 'unsafe' AND actual = 'unsafe'), 'trueNegative': count(*) FILTER (expected = 'safe' AND actual = 'safe'),
  'falsePositive': count(*) FILTER (expected = 'safe' AND actual = 'unsafe'), 'falseNegative': count(*) FILTER (expected = 'unsafe' AND actual = 'safe')}}}}, 'limitations': [{', '.join(map(_Q, E.LIMITATIONS))}]}})::VARCHAR AS document FROM judged""")
def _(t):
    return E.report(cases(t))


@register("op_73_case_documents", "judged", "SELECT id, to_json({'id': id, 'expectedVerdict': expected, 'actualVerdict': actual, 'correct': expected = actual})::VARCHAR AS document FROM judged")
def _(t):
    return E.case_documents(cases(t))


def observations_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations and their results: an event observes the workflow of its user; its result is that of the write of the job of that number."""
    e = table(spark, sf_dir, "events")
    observations = e.selectExpr("concat('wf-', user_id) AS workflow", "concat('obs-', event_id) AS observation", "CASE event_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'denied' WHEN 2 THEN 'unknown' ELSE 'perhaps' END AS decision")
    results = e.selectExpr("concat('wf-', user_id) AS workflow", "concat('obs-', event_id) AS observation", "concat('cache-write:', event_id, ':1') AS op_id", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'unknown' END AS outcome")
    return observations, results


S.cte("observation", "", "SELECT 'wf-' || user_id AS workflow, 'obs-' || event_id AS observation, CASE event_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'denied' WHEN 2 THEN 'unknown' ELSE 'perhaps' END AS decision, event_id, event_type FROM events")


@register_on("op_63_chosen_observations", "observation", "SELECT workflow, count(*) AS n, CASE WHEN count(*) = 1 THEN min(observation) END AS observation, CASE WHEN count(*) = 1 THEN min(decision) END AS decision FROM observation GROUP BY workflow")
def _(spark, sf_dir):
    return V.chosen_observations(observations_of(spark, sf_dir)[0])


@register_on("op_63_named_observations", "observation", "SELECT workflow, count(observation) AS n, CASE WHEN count(observation) = 1 THEN min(observation) END AS observation, CASE WHEN count(observation) = 1 THEN min(decision) END AS decision FROM (SELECT 'wf-' || c_custkey AS workflow, 'obs-' || c_custkey AS observation FROM customer) LEFT JOIN observation USING (workflow, observation) GROUP BY workflow".replace("count(observation)", "count(decision)"))
def _(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").selectExpr("concat('wf-', c_custkey) AS workflow", "concat('obs-', c_custkey) AS observation")
    return V.chosen_observations(observations_of(spark, sf_dir)[0], wanted)


S.cte("result", "", "SELECT 'wf-' || o_custkey AS workflow, 'obs-' || o_orderkey AS observation, CASE o_orderkey % 3 WHEN 0 THEN 'allowed' ELSE 'denied' END AS decision, 'cache-write:' || o_orderkey || ':1' AS op_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'unknown' END AS outcome FROM orders")


@register_on("op_21_appended_observations", "result op head", """SELECT h.workflow, count(o.op_id) AS n, coalesce(string_agg(observation || '=' || decision || ':' || r.op_id || '=' || outcome, ',' ORDER BY observation) FILTER (o.op_id IS NOT NULL), '') AS observed
  FROM head h LEFT JOIN result r ON r.workflow = h.workflow LEFT JOIN op o ON o.workflow = r.workflow AND o.op_id = r.op_id GROUP BY h.workflow""")
def _(spark, sf_dir):
    """Observations of orders appended to the documents; those of an operation that no model has stay out."""
    o = table(spark, sf_dir, "orders")
    key = ("concat('wf-', o_custkey) AS workflow", "concat('obs-', o_orderkey) AS observation")
    observations = o.selectExpr(*key, "CASE o_orderkey % 3 WHEN 0 THEN 'allowed' ELSE 'denied' END AS decision")
    results = o.selectExpr(*key, "concat('cache-write:', o_orderkey, ':1') AS op_id", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'unknown' END AS outcome")
    models = M.with_observations(stored(M.documents(extraction(spark, sf_dir)).select("workflow", "operations", "runtimeObservations"), "models"), observations, results)
    shown = F.transform("runtimeObservations", lambda x: F.concat(x.id, F.lit("="), x.decision, F.lit(":"), x.results[0].operationId, F.lit("="), x.results[0].outcome))
    # They stand in the order of their ids, which is not that of the texts: one id may begin another.
    return models.select("workflow", F.size("runtimeObservations").cast("long").alias("n"), F.array_join(shown, ",").alias("observed"))


def faulty_table(t: DataFrame) -> DataFrame:
    """The table with faults put in: lost headers, doubled events, permissions without a colon, a property without a dot, lines lost."""
    n = "cast(substring(workflow, 4) AS bigint)"
    kept = t.where(f"NOT (kind = 'workflow' AND {n} % 50 = 0)")
    changed = kept.withColumn("detail", F.expr(f"CASE WHEN kind = 'permission' AND {n} % 40 = 0 THEN 'contents read' ELSE detail END")).withColumn(
        "name", F.expr(f"CASE WHEN kind = 'event-property' AND {n} % 30 = 0 THEN 'workflows' ELSE name END")).withColumn("line", F.expr(f"CASE WHEN kind = 'expression' AND {n} % 60 = 0 THEN NULL ELSE line END"))
    return changed.unionByName(kept.where(f"kind = 'event' AND {n} % 20 = 0"))


@register("op_v_table", "d1", """WITH f AS (SELECT *, substring(workflow, 4)::BIGINT AS n FROM d1)
SELECT 'no workflow row' AS rule, workflow AS entity, NULL::VARCHAR AS detail FROM (SELECT DISTINCT workflow FROM f WHERE n % 50 = 0 AND kind <> 'workflow')
UNION ALL SELECT DISTINCT 'property without one event', workflow, name FROM f WHERE kind = 'event-property' AND n % 20 = 0 AND n % 30 <> 0
UNION ALL SELECT DISTINCT 'property without dot', workflow, 'workflows' FROM f WHERE kind = 'event-property' AND n % 30 = 0
UNION ALL SELECT 'permission without colon', workflow || ':' || job_id, 'contents read' FROM f WHERE kind = 'permission' AND n % 40 = 0
UNION ALL SELECT 'line is no number', workflow, name FROM f WHERE kind = 'expression' AND n % 60 = 0
UNION ALL SELECT 'no rows', 'nobody', NULL""")
def _(t):
    wanted = t.sparkSession.createDataFrame([("nobody",), ("wf-1",)], "workflow string")
    return W.of_table(faulty_table(t), wanted)


@register("op_v_scenarios", "found", """SELECT 'not one pair' AS rule, scenario AS entity, n::VARCHAR AS detail FROM found WHERE n <> 1
UNION ALL SELECT 'ambiguous pair', scenario, NULL FROM found WHERE n = 1 AND n_unique <> 1
UNION ALL SELECT 'missing fact', scenario, 'hasAuthority' FROM found WHERE seed % 11 = 0
UNION ALL SELECT 'source kind of fact', scenario, 'readSucceeded' FROM found WHERE seed % 13 = 0""")
def _(t):
    return W.of_scenarios(annotations_of(P.trigger_targets(t)), pairs_of(t))


@register("op_v_chains", "told", """SELECT 'no such fact value' AS rule, id AS entity, 'hasAuthority=maybe' AS detail FROM told WHERE seed % 3 = 0 AND seed % 13 <> 0
UNION ALL SELECT 'source kind provenance', id, 'facts.readSucceeded' FROM told WHERE seed % 13 = 0
UNION ALL SELECT 'no such fact value', id, unnest(CASE WHEN seed % 3 = 0 THEN ['hasAuthority=maybe', 'readSucceeded'] ELSE ['readSucceeded'] END) FROM told WHERE seed % 13 = 0""")
def _(t):
    seed = F.expr(_SC_SEED)
    return W.of_chains(annotated_of(t).withColumn("hasAuthority", F.when(seed % 3 == 0, "maybe").otherwise(F.col("hasAuthority"))))


@register("op_v_lookups", "pair ev", """WITH c AS (SELECT *, CASE WHEN consumer_step = '3' THEN 'gone' ELSE producer_op END AS op FROM pair WHERE pairing = 'unique')
SELECT DISTINCT 'not one operation' AS rule, producer || '/gone' AS entity, '0' AS detail FROM c WHERE op = 'gone'
UNION ALL SELECT DISTINCT 'not one event', workflow, NULL::VARCHAR FROM (SELECT producer AS workflow FROM c UNION ALL SELECT consumer FROM c) WHERE workflow NOT IN (SELECT workflow FROM ev GROUP BY workflow HAVING count(*) = 1)""")
def _(t):
    ops = artifact_operations(t)
    return W.of_lookups(configs_of(P.candidates(t, ops)), ops, t)


@register("op_v_cache_choices", "op", "SELECT 'not one cache write' AS rule, workflow AS entity, count(*)::VARCHAR AS detail FROM op WHERE op_kind = 'cacheWriteIntent' GROUP BY workflow HAVING count(*) <> 1")
def _(t):
    return W.of_cache_choices(V.cache_choices(M.operations(t)))


@register_on("op_v_observations", "observation op", """SELECT 'unknown operation observed' AS rule, workflow AS entity, 'cache-write:' || event_id || ':1' AS detail FROM observation o WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.workflow = o.workflow AND op.op_id = 'cache-write:' || event_id || ':1')
UNION ALL SELECT 'several observations', workflow, count(*)::VARCHAR FROM observation GROUP BY workflow HAVING count(*) > 1
UNION ALL SELECT 'no such decision', workflow, decision FROM observation WHERE decision = 'perhaps'""")
def _(spark, sf_dir):
    return W.of_observations(*observations_of(spark, sf_dir), M.operations(extraction(spark, sf_dir)))


@register("op_v_outputs", "chain", """SELECT 'no specification line' AS rule, id AS entity, NULL::VARCHAR AS detail FROM chain WHERE "hasAuthority" = 'unknown'
UNION ALL SELECT 'no verdict', id, '-- specification AG !(x) is odd' FROM chain WHERE "hasAuthority" = 'false'""")
def _(t):
    bad = F.when(F.col("hasAuthority") == "unknown", "nothing").when(F.col("hasAuthority") == "false", "x\n-- specification AG !(x) is odd").otherwise("-- specification AG !(x) is true")
    return W.of_outputs(chains_of(t).select("id", bad.alias("output")))
