"""From the 8-column table to typed tables: events, permissions, jobs, steps, expressions and the operations on shared objects.

File order is row_seq; where several rows describe one thing, the later one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.functions import expressions as X
from boundarylens.sources.readers import of_kind
from boundarylens.sources.shared import partitions

STEP = ["workflow", "job_id", "step_index"]
_USES, _RUN = -2, -1  # slots of rows of steps that are not arguments


def workflow_rows(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted workflows (column workflow); those without any are told by violations.of_table."""
    return table.join(wanted.select("workflow").distinct(), "workflow", "left_semi")


def headers(table: DataFrame) -> DataFrame:
    """workflow, name, file: of the first workflow row."""
    first = F.min_by(F.struct("name", "file_path"), "row_seq")
    return of_kind(table, "workflow").groupBy("workflow").agg(first.alias("h")).select("workflow", F.col("h.name").alias("name"), F.col("h.file_path").alias("file"))


def events(table: DataFrame) -> DataFrame:
    return of_kind(table, "event").select(
        "workflow", F.col("name").alias("event"), X.event_flag(F.col("detail"), "externally-triggerable").alias("external"),
        X.event_flag(F.col("detail"), "privileged").alias("privileged"), "row_seq",
    )


def workflows(table: DataFrame) -> DataFrame:
    """workflow, file (null without a header), n_events, event, external, privileged (of one event), targets.

    All that pairing asks of a workflow, in one aggregation. Targets are the workflows named by
    workflow_run, where a workflow has exactly one such event; each once.
    """
    is_ = lambda kind: F.col("kind") == kind
    event = F.struct(F.col("name").alias("event"), X.event_flag(F.col("detail"), "externally-triggerable").alias("external"), X.event_flag(F.col("detail"), "privileged").alias("privileged"))
    header = lambda c: F.when(is_("workflow"), F.col(c))
    of = of_kind(table, "workflow", "event", "event-property").groupBy("workflow").agg(
        F.min_by(header("file_path"), header("row_seq")).alias("file"), F.count_if(is_("event")).alias("n_events"), F.max(F.when(is_("event"), event)).alias("e"),
        F.count_if(is_("event") & (F.col("name") == "workflow_run")).alias("n_runs"),
        F.collect_set(F.when(is_("event-property") & (F.col("name") == "workflow_run.workflows"), F.col("detail"))).alias("named"),
    )
    return of.select("workflow", "file", "n_events", "e.event", "e.external", "e.privileged", F.when(F.col("n_runs") == 1, F.col("named")).otherwise(F.array()).alias("targets"))


def event_properties(table: DataFrame) -> DataFrame:
    """workflow, event, property, values and their lines in order, n_events: how many events of the workflow have that name (one is right)."""
    split = of_kind(table, "event-property").select(
        "workflow", F.split("name", r"\.", 2)[0].alias("event"), F.get(F.split("name", r"\.", 2), 1).alias("property"), "detail", "line", "row_seq"
    )
    held = split.groupBy("workflow", "event", "property").agg(F.array_sort(F.collect_list(F.struct("row_seq", "detail", "line"))).alias("v"))
    values = held.select("workflow", "event", "property", F.col("v.detail").alias("values"), F.col("v.line").alias("lines"))
    counted = events(table).groupBy("workflow", "event").agg(F.count(F.lit(1)).alias("n_events"))
    return values.join(counted, ["workflow", "event"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def workflow_table_rows(table: DataFrame) -> DataFrame:
    """Headers as rows of the table, as the extraction writes them."""
    mark = F.lit("-")
    return headers(table).select(F.col("file").alias("file_path"), "workflow", mark.alias("job_id"), mark.alias("step_index"), F.lit("workflow").alias("kind"), "name", mark.alias("detail"))


def event_table_rows(table: DataFrame) -> DataFrame:
    """Events as rows of the table; the labels say whether others can trigger them and whether they are privileged."""
    mark, label = F.lit("-"), lambda c, n: F.when(F.col(c), n).otherwise(f"not-{n}")
    files = headers(table).select("workflow", "file")
    return events(table).join(files, "workflow").select(
        F.col("file").alias("file_path"), "workflow", mark.alias("job_id"), mark.alias("step_index"), F.lit("event").alias("kind"), F.col("event").alias("name"),
        F.concat_ws(";", label("external", "externally-triggerable"), label("privileged", "privileged")).alias("detail"),
    )


def permissions(table: DataFrame) -> DataFrame:
    scope, access = X.scope_access(F.col("detail"))
    return of_kind(table, "permission").select("workflow", X.absent(F.col("job_id")).alias("job_id"), scope.alias("scope"), access.alias("access"), "row_seq")


def jobs(table: DataFrame) -> DataFrame:
    """workflow, job_id, label (the last), labels (all), job_seq (first appearance)."""
    label = F.regexp_replace("detail", "^runs-on=", "")
    return of_kind(table, "job").groupBy("workflow", "job_id").agg(
        F.max_by(label, "row_seq").alias("label"), F.min("row_seq").alias("job_seq"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_seq", label.alias("v")))), lambda x: x.v).alias("labels"),
    )


def steps(table: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per step: uses and argument rows merge, the last value of an argument wins, a run row replaces what came before it.

    Values are strings, so the merge sorts its rows. They are dealt by job before it: one sort, in tasks of one partition each, not also one
    of the widest rows in the tasks that made them; and the join with jobs finds its steps in place. What a row tells is a number by then (slot:
    the action, the command, or the place of its argument in ARGUMENTS, 0 for any other), so that sorted rows are short.
    tasks: how many they are dealt to, as many as the table's size asks for if not given.
    """
    argument = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in X.ARGUMENTS]), F.col("name")).cast("int"), F.lit(0))
    slot = F.when(F.col("kind") == "uses-step", _USES).when(F.col("kind") == "run-step", _RUN).otherwise(argument)
    rows = of_kind(table, "uses-step", "uses-argument", "run-step").select(*STEP, slot.alias("slot"), "detail", "row_seq").repartition(tasks or partitions(table), "workflow", "job_id")
    held = lambda of, value: F.max_by(F.when(F.col("slot") == of, value), F.when(F.col("slot") == of, F.col("row_seq")))
    both = F.struct("row_seq", "detail")
    last_run = F.max(F.when(F.col("slot") == _RUN, F.col("row_seq")))
    last_use = F.max(F.when(F.col("slot") != _RUN, F.col("row_seq")))
    merged = rows.groupBy(*STEP).agg(
        held(_USES, both).alias("u"), held(_RUN, F.col("detail")).alias("command"), last_run.alias("run_seq"), last_use.alias("use_seq"),
        *[held(i + 1, both).alias(f"a{i}") for i in range(len(X.ARGUMENTS))],
    )
    is_run = F.col("run_seq").isNotNull() & (F.coalesce("use_seq", F.lit(-1)) < F.col("run_seq"))
    alive = lambda c: F.when(~is_run & (F.col(f"{c}.row_seq") > F.coalesce("run_seq", F.lit(-1))), F.col(f"{c}.detail"))
    return merged.select(
        *STEP, F.when(is_run, "run").otherwise("uses").alias("type"),
        F.when(~is_run, F.coalesce(X.action_name(alive("u")), F.lit(""))).alias("action"), F.when(~is_run, F.coalesce(X.action_version(alive("u")), F.lit(""))).alias("version"),
        F.when(is_run, F.col("command")).alias("command"), *[alive(f"a{i}").alias(f"arg_{n}") for i, n in enumerate(X.ARGUMENTS)],
    )


def argument_entries() -> Column:
    """Names and values of the present arguments of a step."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`arg_{n}`").alias("value")) for n in X.ARGUMENTS])
    return F.filter(pairs, lambda p: p.value.isNotNull())


def argument_map() -> Column:
    """The same as a map."""
    return F.map_from_entries(argument_entries())


def attached_steps(table: DataFrame) -> DataFrame:
    """Steps of known jobs, numbered as they are ordered within the job; steps of unknown jobs fall away.

    Jobs are dealt as steps are, ahead of their aggregation: hardly any has a second row, so that the tasks that read them would only fill hash tables.
    """
    tasks = partitions(table)
    known = jobs(of_kind(table, "job").repartition(tasks, "workflow", "job_id")).select("workflow", "job_id", "job_seq")
    return steps(table, tasks).join(known, ["workflow", "job_id"]).withColumn("step_order", X.step_order(F.col("step_index")))


def expressions(table: DataFrame) -> DataFrame:
    return of_kind(table, "expression").select("workflow", F.col("name").alias("raw"), F.col("detail").alias("normalized"), F.col("line").cast("int").alias("line"), "row_seq")


_KINDS = {k: [a for a, kinds in X.ACTIONS.items() if k in kinds] for k in ("cacheWriteIntent", "cacheReadIntent", "artifactWriteIntent", "artifactReadIntent")}
_PREFIX = {"cacheWriteIntent": "cache-write", "cacheReadIntent": "cache-read", "artifactWriteIntent": "artifact-write", "artifactReadIntent": "artifact-read"}


def _operations_of_step() -> Column:
    """The operations of a step, none, one or two, as (step_order, place, v): v as documents hold it, place puts writes before reads."""
    def op(place: int, kind: str) -> Column:
        cache = kind.startswith("cache")
        null = F.lit(None).cast("string")
        fields = F.struct(
            F.concat_ws(":", F.lit(_PREFIX[kind]), "job_id", "step_index").alias("id"), F.lit(kind).alias("kind"), F.col("job_id").alias("jobId"), F.col("step_order").alias("stepIndex"),
            (F.col("arg_key") if cache else null).alias("key"), F.col("arg_path").alias("path"), (null if cache else F.col("arg_name")).alias("name"),
            (F.col("`arg_run-id`") if kind == "artifactReadIntent" else null).alias("runId"),
        )
        return F.when((F.col("type") == "uses") & F.col("action").isin(_KINDS[kind]), F.struct("step_order", F.lit(place).alias("place"), fields.alias("v")))

    return F.filter(F.array(*[op(i, k) for i, k in enumerate(_KINDS)]), lambda x: x.isNotNull())


def operations(table: DataFrame) -> DataFrame:
    """workflow, op_id, op_kind, job_id, step_index, key, path, name, run_id, job_seq: none, one or two per step, writes first."""
    return attached_steps(table).select(*STEP, "job_seq", "step_order", F.explode(_operations_of_step()).alias("o")).select(
        "workflow", F.col("o.v.id").alias("op_id"), F.col("o.v.kind").alias("op_kind"), "job_id", "step_index", "o.v.key", "o.v.path", "o.v.name", F.col("o.v.runId").alias("run_id"), "job_seq", "step_order"
    )


OBSERVED = "struct<id: string, decision: string, results: array<struct<operationId: string, outcome: string>>>"


def documents(table: DataFrame, source: str = "table") -> DataFrame:
    """The nested common model, one document per workflow.

    Steps are dealt once, with the rows they are merged of: their jobs' arrays of steps and of operations are made where they lie, and only whole jobs
    move on to their workflow. Maps are made of their entries last of all, as rows that hold maps have no order.
    """
    ordered = lambda value, *order: F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    values = event_properties(table).where("n_events = 1").groupBy("workflow", "event").agg(F.array_sort(F.collect_list(F.struct("property", "values"))).alias("properties"))
    ev = events(table).join(values, ["workflow", "event"], "left").groupBy("workflow").agg(ordered(F.struct("event", "external", "privileged", "properties"), "row_seq").alias("events"))
    step = F.struct(F.col("step_order").alias("index"), "type", "action", "version", F.when(F.col("type") == "uses", argument_entries()).alias("arguments"), "command")
    st = steps(table).withColumn("step_order", X.step_order(F.col("step_index"))).select("workflow", "job_id", step.alias("step"), _operations_of_step().alias("ops")).groupBy("workflow", "job_id").agg(
        F.array_sort(F.collect_list("step")).alias("steps"), F.array_sort(F.flatten(F.collect_list("ops"))).alias("ops"))
    jo = jobs(table).join(st, ["workflow", "job_id"], "left").groupBy("workflow").agg(ordered(F.struct("job_id", "label", "steps", "ops"), "job_seq").alias("jobs"))
    scope, access = X.scope_access(F.col("detail"))
    told = {
        "permission": F.struct(X.absent(F.col("job_id")).alias("jobId"), scope.alias("scope"), access.alias("access")),
        "expression": F.struct(F.col("name").alias("raw"), F.col("detail").alias("normalized"), F.col("line").cast("int").alias("line")),
    }
    of_it = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("row_seq", told[k].alias("v")))))
    pe = of_kind(table, *told).groupBy("workflow").agg(*[of_it(k).alias(f"{k}s") for k in told])
    out = headers(table)
    for df in (ev, pe, jo):
        out = out.join(df, "workflow", "left")
    out = out.withColumn("operations", F.flatten(F.transform("jobs", lambda x: F.coalesce(x.v.ops, F.array()))))
    in_step = lambda x: F.struct(*[x[c].alias(c) for c in ("index", "type", "action", "version")], F.map_from_entries(x.arguments).alias("arguments"), x.command.alias("command"))
    in_job = lambda x: F.struct(x.v.job_id.alias("id"), F.array(x.v.label).alias("runnerLabels"), F.coalesce(F.transform(x.v.steps, in_step), F.array()).alias("steps"))
    properties = lambda x: F.map_from_entries(F.coalesce(x.v.properties, none("struct<property: string, values: array<string>>")))
    in_event = lambda x: F.struct(x.v.event.alias("name"), x.v.external.alias("externallyTriggerable"), x.v.privileged.alias("privileged"), properties(x).alias("properties"))
    plain = lambda x: x.v
    held = lambda c, of=plain: F.coalesce(F.transform(F.col(c), of), F.array()).alias(c)
    facts = F.struct(*[F.lit("unknown").alias(n) for n in ("sameObject", "consumerUsesObject", "integrityVerified", "privilegedConsumer", "hasAuthority")])
    return out.select(
        F.lit("0.1.0").alias("schemaVersion"), F.struct(F.lit("codeqlTable").alias("type"), F.lit(source).alias("file"), F.lit(True).alias("staticAnalysisOnly")).alias("source"),
        "workflow", "file", held("events", in_event), held("permissions"), held("jobs", in_job), held("expressions"), held("operations"),
        facts.alias("verificationFacts"), none(OBSERVED).alias("runtimeObservations"),
    )


def with_observations(models: DataFrame, observations: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with the observations of their workflow appended by id; those that name an operation no model has are left out (violations.of_observations reports them).

    observations: workflow, observation, decision. results: workflow, observation, op_id, outcome.
    """
    known = models.select("workflow", F.explode(F.coalesce(F.col("operations.id"), F.array().cast("array<string>"))).alias("op_id"))
    bad = unknown_observed(known, results).select("workflow", "observation").distinct()
    told = results.groupBy("workflow", "observation").agg(F.array_sort(F.collect_list(F.struct(F.col("op_id").alias("operationId"), "outcome"))).alias("results"))
    rows = observations.join(bad, ["workflow", "observation"], "left_anti").join(told, ["workflow", "observation"], "left")
    one = F.struct(F.col("observation").alias("id"), "decision", F.coalesce("results", F.array().cast("array<struct<operationId: string, outcome: string>>")).alias("results"))
    per = rows.groupBy("workflow").agg(F.array_sort(F.collect_list(one)).alias("more"))
    more = F.coalesce("more", F.array().cast(f"array<{OBSERVED}>"))
    return models.join(per, "workflow", "left").withColumn("runtimeObservations", F.concat("runtimeObservations", more)).drop("more")


def unknown_observed(ops: DataFrame, results: DataFrame) -> DataFrame:
    """Observed results (workflow, op_id ...) for operations that no model has."""
    return results.join(ops.select("workflow", "op_id"), ["workflow", "op_id"], "left_anti")
