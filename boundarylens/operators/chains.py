"""Trust chains: a pair, its facts, where each stage stands in the workflow files, and where every element comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.operators import model
from boundarylens.operators.verdicts import CHAIN_FACTS, STAGES, is_fact

#: Meanings of the stages, sources and claims of provenance records.
MEANINGS = {
    "start": "未信頼なworkflowが共有objectへの保存を試みる．",
    "object_written": "共有objectの保存が成功する．",
    "object_restored": "同じ共有objectを後続workflowが取得する．",
    "object_used": "取得した内容を後続処理が利用する．",
    "integrity_checked": "復元した内容を利用する前に完全性を確認する．",
}
SOURCE_KINDS = ("static-analysis", "runtime-observation", "manual-judgment")
ANNOTATED = ("writeAuthorized", "writeSucceeded", "readSucceeded", "consumerUsesObject", "integrityCheckPresent", "integrityCheckPassed", "hasAuthority")
SCENARIO = ("id", "platform", "description", "evidenceStatus")
WORKFLOW = ("name", "file", "event")
OPERATION = ("id", "kind", "jobId", "stepIndex", "name", "path", "runId")
SHARED = ("kind", "producerRunSelector", "consumerRunSelector", "identityBasis", "name")
SCENARIO_CLAIM = "評価scenarioの定義から設定した．"
TABLE_CLAIM = "CodeQLの抽出表から取得した．"
SELECTOR_CLAIM = "upload-artifactは実行中runへ成果物を保存すると解釈した．"
MATCH_CLAIM = "保存操作と取得操作の照合から生成した．"
FACT_CLAIM = "CodeQL抽出結果と結合条件から算出した．"
PLACE_CLAIM = "CodeQLが抽出した操作位置から生成した．"
STATIC_FACTS = ("producerUntrusted", "writeIntent", "sameObject", "privilegedConsumer")
PLACES = {"object_used": "objectUsed", "integrity_checked": "integrityChecked", "authority_reached": "authorityReached"}
#: Fixed values end.


def only_event(table: DataFrame) -> DataFrame:
    """workflow, event, external, privileged: workflows with exactly one event in all."""
    every = model.events(table).groupBy("workflow").agg(
        F.count(F.lit(1)).alias("n"), F.first("event").alias("event"), F.first("external").alias("external"), F.first("privileged").alias("privileged")
    )
    return every.where("n = 1").drop("n")


def lookup_counts(wanted: DataFrame, operations: DataFrame) -> DataFrame:
    """workflow, op_id, n: how many operations each wanted name stands for; one is right."""
    n = operations.groupBy("workflow", "op_id").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, ["workflow", "op_id"], "left").select("workflow", "op_id", F.coalesce("n", F.lit(0)).alias("n"))


def untrusted(external: Column, privileged: Column) -> Column:
    return F.when(external & ~privileged, "true").otherwise("false")


def assembled(pairs: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Pairs whose workflows have exactly one event each, with the eleven facts; the given ones, those of the events, and two that hold by construction."""
    both = pairs.where("producer_n_events = 1 AND consumer_n_events = 1")
    known = {
        "producerUntrusted": untrusted(F.col("producer_external"), F.col("producer_privileged")), "writeIntent": F.lit("true"), "sameObject": F.lit("true"),
        "privilegedConsumer": F.when(F.col("consumer_privileged"), "true").otherwise("false"), **facts,
    }
    return both.select("*", *[known[f].alias(f) for f in CHAIN_FACTS])


def places(use_step: Column, check_step: Column, authority: tuple[Column, Column, Column]) -> Column:
    """The six places of a chain row as an array of (stage, ord, file, workflow, job_id, step_index, meaning), in order.

    authority: job (null or empty for the reader's own), step and meaning. The job of other places is
    always that of the operation.
    """
    job, step, meaning = authority
    place = lambda ord_, side, s, m, j=None: F.struct(
        F.lit(STAGES[ord_]).alias("stage"), F.lit(ord_).alias("ord"), F.col(f"{side}_file").alias("file"), F.col(side).alias("workflow"),
        F.coalesce(F.nullif(j, F.lit("")) if j is not None else F.lit(None).cast("string"), F.col(f"{side}_job")).alias("job_id"), s.cast("string").alias("step_index"), m.alias("meaning"),
    )
    own = [F.lit(MEANINGS[s]) for s in STAGES[:5]]
    return F.array(
        place(0, "producer", F.col("producer_step"), own[0]), place(1, "producer", F.col("producer_step"), own[1]), place(2, "consumer", F.col("consumer_step"), own[2]),
        place(3, "consumer", use_step, own[3]), place(4, "consumer", check_step, own[4]), place(5, "consumer", step, meaning, job),
    )


def trace_lines(found: Column) -> Column:
    """The comment line of each of these places."""
    return F.transform(found, lambda p: F.concat(F.lit("-- TRACE "), p.stage, F.lit(": "), p.file, F.lit(":"), p.job_id, F.lit(":"), p.step_index, F.lit(" - "), p.meaning))


def required_elements() -> list[str]:
    """The 46 elements of a chain that need exactly one provenance record."""
    out = [f"scenario.{n}" for n in SCENARIO]
    for side in ("producer", "consumer"):
        out += [f"{side}.workflow.{n}" for n in WORKFLOW] + [f"{side}.operation.{n}" for n in OPERATION]
    return out + [f"sharedObject.{n}" for n in SHARED] + [f"facts.{n}" for n in CHAIN_FACTS] + [f"traceMap.{s}" for s in STAGES]


def record(element: Column | str, kind: Column | str, source: Column | str, claim: Column | str) -> Column:
    """Where one element of a chain comes from."""
    columns = (F.lit(x) if isinstance(x, str) else x for x in (element, kind, source, claim))
    return F.struct(*[c.alias(n) for c, n in zip(columns, ("element", "source_kind", "source", "claim"), strict=True)])


def provenance(table_source: str, annotation_source: str, tool_source: str, annotated: Column) -> Column:
    """The records of a chain row as an array; annotated: the ones of what its annotation gives (facts.* and traceMap.*)."""
    fixed = [record(f"scenario.{n}", "manual-judgment", annotation_source, SCENARIO_CLAIM) for n in SCENARIO]
    for side in ("producer", "consumer"):
        for section, names in (("workflow", WORKFLOW), ("operation", OPERATION)):
            fixed += [record(f"{side}.{section}.{n}", "static-analysis", table_source, TABLE_CLAIM) for n in names]
    for n in SHARED:
        manual = n == "producerRunSelector"
        fixed.append(record(f"sharedObject.{n}", *(("manual-judgment", tool_source, SELECTOR_CLAIM) if manual else ("static-analysis", table_source, MATCH_CLAIM))))
    fixed += [record(f"facts.{n}", "static-analysis", table_source, FACT_CLAIM) for n in STATIC_FACTS]
    fixed += [record(f"traceMap.{s}", "static-analysis", table_source, PLACE_CLAIM) for s in STAGES[:3]]
    return F.concat(F.array(*fixed), annotated)


def provenance_faults(records: Column) -> Column:
    """(rule, element) of what is wrong with a chain's records: duplicate, missing, source kind. More elements than needed are fine."""
    names = F.transform(records, lambda r: r.element)
    fault = lambda rule, elements: F.transform(elements, lambda e: F.struct(F.lit(rule).alias("rule"), e.alias("element")))
    once = F.array_distinct(names)
    twice = F.when(F.size(once) < F.size(names), F.filter(once, lambda e: F.size(F.filter(names, lambda n: n == e)) > 1)).otherwise(F.array())
    missing = F.array_except(F.array(*[F.lit(e) for e in required_elements()]), names)
    odd = F.transform(F.filter(records, lambda r: ~F.coalesce(r.source_kind.isin(*SOURCE_KINDS), F.lit(False))), lambda r: r.element)
    return F.concat(fault("duplicate", twice), fault("missing", missing), fault("source kind", odd))


def provenance_exact(records: Column) -> Column:
    """Whether the records cover exactly the required elements, each once, and all three kinds of source occur."""
    names = F.transform(records, lambda r: r.element)
    need = F.array(*[F.lit(e) for e in required_elements()])
    kinds = F.array_distinct(F.transform(records, lambda r: r.source_kind))
    return (F.size(F.array_except(need, names)) == 0) & (F.size(F.array_except(names, need)) == 0) & (F.size(names) == F.size(need)) & (F.array_sort(kinds) == F.array_sort(F.array(*[F.lit(k) for k in SOURCE_KINDS])))


def missing_facts(scenarios: DataFrame) -> DataFrame:
    """scenario, fact: annotated facts that a scenario (id, facts map) lacks."""
    return scenarios.select(F.col("id").alias("scenario"), F.explode(F.array_except(F.array(*[F.lit(n) for n in ANNOTATED]), F.map_keys("facts"))).alias("fact"))


def bad_facts(chains: DataFrame) -> DataFrame:
    """id, fact, value: values that are none of the three."""
    rows = F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value"), is_fact(F.col(f)).alias("ok")) for f in CHAIN_FACTS])
    return chains.select("id", F.inline(rows)).where("NOT ok").select("id", "fact", "value")
