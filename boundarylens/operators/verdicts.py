"""Verdicts in closed form: facts are 'true', 'false' or 'unknown', and unknown means both are tried.

With its facts fixed the state machine is deterministic, so a path is unsafe if no fact rules it out:
one boolean expression over the columns, with nothing to shuffle and no model checker.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts in their order, stages, and the texts of the state models.
CHAIN_FACTS = (
    "producerUntrusted", "writeIntent", "writeAuthorized", "writeSucceeded", "sameObject", "readSucceeded",
    "consumerUsesObject", "integrityCheckPresent", "integrityCheckPassed", "privilegedConsumer", "hasAuthority",
)
CACHE_FACTS = ("write_intent", "write_authorized", "write_succeeded", "same_object", "consumer_uses_object", "integrity_verified", "privileged_consumer", "has_authority")
STAGES = ("start", "object_written", "object_restored", "object_used", "integrity_checked", "authority_reached")
WITNESS = ("start", "object_written", "object_restored", "object_used", "authority_reached")
WRITE_EVENTS = ("push", "workflow_dispatch", "repository_dispatch", "delete", "registry_package", "page_build", "schedule")
CHAIN_HEAD = """VAR
  stage : {start, object_written, object_restored, integrity_checked, object_used, authority_reached, blocked};
  object_tainted : boolean;"""
CHAIN_TAIL = """INVAR write_succeeded -> write_authorized
INVAR read_succeeded -> write_succeeded
INVAR integrity_check_passed -> integrity_check_present
ASSIGN
  init(stage) := start;
  init(object_tainted) := producer_untrusted;
  next(object_tainted) := case
    stage = object_restored & integrity_check_present & integrity_check_passed : FALSE;
    TRUE : object_tainted;
  esac;
  next(stage) := case
    stage = start & (!producer_untrusted | !write_intent | !write_authorized | !write_succeeded) : blocked;
    stage = start : object_written;
    stage = object_written & same_object & read_succeeded : object_restored;
    stage = object_written : blocked;
    stage = object_restored & integrity_check_present & integrity_check_passed : integrity_checked;
    stage = object_restored & integrity_check_present : blocked;
    stage = object_restored & consumer_uses_object : object_used;
    stage = object_restored : blocked;
    stage = integrity_checked & consumer_uses_object : object_used;
    stage = integrity_checked : blocked;
    stage = object_used & privileged_consumer & has_authority : authority_reached;
    stage = object_used : blocked;
    TRUE : stage;
  esac;

CTLSPEC AG !(stage = authority_reached & object_tainted)
"""
CACHE_HEAD = """VAR
  stage : {start, object_written, object_restored, object_used, integrity_checked, authority_reached, blocked};"""
CACHE_TAIL = """INVAR write_succeeded -> (write_intent & write_authorized)
ASSIGN
  init(stage) := start;
  next(stage) := case
    stage = start & (!write_intent | !write_authorized | !write_succeeded) : blocked;
    stage = start : object_written;
    stage = object_written & same_object : object_restored;
    stage = object_written : blocked;
    stage = object_restored & consumer_uses_object : object_used;
    stage = object_restored : blocked;
    stage = object_used & integrity_verified : integrity_checked;
    stage = object_used & privileged_consumer & has_authority : authority_reached;
    stage = object_used : blocked;
    TRUE : stage;
  esac;

CTLSPEC AG stage != authority_reached
"""
CACHE_NOTE = "-- unknownはFROZENVARとし，実行中は一定だが真偽の両方を検査する．"
#: Fixed values end.


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def is_fact(c: Column) -> Column:
    """One of the three values; null is none."""
    return F.coalesce(c.isin("true", "false", "unknown"), F.lit(False))


def _can(*names: str) -> Column:
    return reduce(and_, [F.col(n) != "false" for n in names])


def _cannot_pass(*names: str) -> Column:
    return reduce(and_, [F.col(n) != "true" for n in names])


def chain_consistent() -> Column:
    """Whether some legal state exists: success needs permission, a read needs a write, a passed check a check."""
    clash = lambda yes, no: (F.col(yes) == "true") & (F.col(no) == "false")
    return ~(
        clash("writeSucceeded", "writeAuthorized") | clash("readSucceeded", "writeSucceeded")
        | clash("readSucceeded", "writeAuthorized") | clash("integrityCheckPassed", "integrityCheckPresent")
    )


def chain_unsafe() -> Column:
    """Some choice for the unknowns lets untrusted content reach authority. Clashing facts have no state at all and are safe."""
    open_ = [f for f in CHAIN_FACTS if not f.startswith("integrity")]
    return _can(*open_) & _cannot_pass("integrityCheckPresent", "integrityCheckPassed")


def chain_always_unsafe() -> Column:
    """Every choice does; what may be written is implied by what was read."""
    sure = ("producerUntrusted", "writeIntent", "sameObject", "readSucceeded", "consumerUsesObject", "privilegedConsumer", "hasAuthority")
    return chain_consistent() & reduce(and_, [F.col(n) == "true" for n in sure]) & (F.col("integrityCheckPresent") == "false")


def chain_class() -> Column:
    """unsafe, incomplete (it depends on unknowns) or safe."""
    return F.when(chain_always_unsafe(), "unsafe").when(chain_unsafe(), "incomplete").otherwise("safe")


def blocking_condition() -> Column:
    """The first condition that is known to stop the path, or null."""
    no = lambda n: F.col(n) == "false"
    return (
        F.when(no("producerUntrusted"), "producer trusted")
        .when(no("writeIntent") | no("writeAuthorized") | no("writeSucceeded"), "write denied")
        .when(no("sameObject") | no("readSucceeded"), "object not restored")
        .when(F.col("integrityCheckPresent") == "true", "integrity checked")
        .when(no("consumerUsesObject"), "object not used")
        .when(no("privilegedConsumer") | no("hasAuthority"), "no authority")
    )


def cache_consistent() -> Column:
    w = F.col("write_succeeded") == "true"
    return ~(w & ((F.col("write_intent") == "false") | (F.col("write_authorized") == "false")))


def cache_unsafe() -> Column:
    return _can(*[f for f in CACHE_FACTS if f != "integrity_verified"]) & _cannot_pass("integrity_verified")


def cache_class() -> Column:
    """blocked (no choice reaches authority), unsafe (every one does) or incomplete."""
    sure = [F.col(f) == "true" for f in ("write_succeeded", "same_object", "consumer_uses_object", "privileged_consumer", "has_authority")]
    always = cache_consistent() & (F.col("write_intent") != "false") & (F.col("write_authorized") != "false") & reduce(and_, sure) & (F.col("integrity_verified") == "false")
    return F.when(always, "unsafe").when(cache_unsafe(), "incomplete").otherwise("blocked")


def witness() -> Column:
    """The stages of a counterexample; it is always the same one."""
    return F.when(chain_unsafe(), F.array(*[F.lit(s) for s in WITNESS]))


def witness_value(fact: str) -> Column:
    """What a counterexample takes for an unknown fact."""
    return F.when(F.col(fact) != "unknown", F.col(fact)).otherwise(F.lit("false" if fact.startswith("integrity") else "true"))


def final_stage() -> Column:
    """Where a path with all facts known ends: the transition system folded over a fixed number of steps."""
    t = lambda n: F.col(n) == "true"
    checked = t("integrityCheckPresent") & t("integrityCheckPassed")

    def after(stage: Column) -> Column:
        return (
            F.when(stage == "start", F.when(t("producerUntrusted") & t("writeIntent") & t("writeAuthorized") & t("writeSucceeded"), "object_written").otherwise("blocked"))
            .when(stage == "object_written", F.when(t("sameObject") & t("readSucceeded"), "object_restored").otherwise("blocked"))
            .when(stage == "object_restored", F.when(checked, "integrity_checked").when(t("integrityCheckPresent"), "blocked").when(t("consumerUsesObject"), "object_used").otherwise("blocked"))
            .when(stage == "integrity_checked", F.when(t("consumerUsesObject"), "object_used").otherwise("blocked"))
            .when(stage == "object_used", F.when(t("privilegedConsumer") & t("hasAuthority"), "authority_reached").otherwise("blocked"))
            .otherwise(stage)
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit("start"), lambda s, _: after(s))


def tainted_at_end() -> Column:
    """Whether the object is still tainted where such a path ends: it is from the start if the producer is untrusted, until a restored object passes its check."""
    t = lambda n: F.col(n) == "true"
    names = ("producerUntrusted", "writeIntent", "writeAuthorized", "writeSucceeded", "sameObject", "readSucceeded")
    cleared = reduce(and_, map(t, names)) & t("integrityCheckPresent") & t("integrityCheckPassed")
    return t("producerUntrusted") & ~cleared


def _model_text(names: tuple[str, ...], shown: list[str], before: list[Column], head: str, tail: str) -> Column:
    """Unknown facts as frozen variables, known ones as constants, between fixed texts."""
    unknown = [F.when(F.col(n) == "unknown", F.lit(f"  {s} : boolean;")) for n, s in zip(names, shown, strict=True)]
    known = [F.when(F.col(n) != "unknown", F.concat(F.lit(f"  {s} := "), F.upper(n), F.lit(";"))) for n, s in zip(names, shown, strict=True)]
    any_unknown = reduce(or_, [F.col(n) == "unknown" for n in names])
    any_known = reduce(or_, [F.col(n) != "unknown" for n in names])
    return F.concat_ws(
        "\n", *before, F.lit("MODULE main"), F.when(any_unknown, F.concat_ws("\n", F.lit("FROZENVAR"), *unknown)), F.lit(head),
        F.when(any_known, F.concat_ws("\n", F.lit("DEFINE"), *known)), F.lit(tail),
    )


def chain_model(source: Column, scenario: Column, trace_lines: Column) -> Column:
    """The state model of a chain as text; trace_lines is an array with a line for each stage."""
    before = [F.concat(F.lit("-- Generated from "), source), F.concat(F.lit("-- Scenario: "), scenario), F.array_join(trace_lines, "\n")]
    return _model_text(CHAIN_FACTS, [snake(n) for n in CHAIN_FACTS], before, CHAIN_HEAD, CHAIN_TAIL)


def cache_model(source: Column) -> Column:
    return _model_text(CACHE_FACTS, list(CACHE_FACTS), [F.concat(F.lit("-- Generated from "), source), F.lit(CACHE_NOTE)], CACHE_HEAD, CACHE_TAIL)


def policy_fact(decision: Column) -> Column:
    return F.when(decision == "allowed", "true").when(decision == "denied", "false").when(decision == "unknown", "unknown")


def outcome_fact(outcome: Column) -> Column:
    return F.when(outcome == "succeeded", "true").when(outcome == "failed", "false").when(outcome == "unknown", "unknown")


def cache_choices(ops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """workflow, n, op_id, op_kind: the operation a workflow's cache model starts from.

    Without wanted (workflow, op_id) that is its only cache write. n tells how many there were to choose
    from; op_id and op_kind are null unless it is one.
    """
    of = ops.where("op_kind = 'cacheWriteIntent'") if wanted is None else ops.join(wanted, ["workflow", "op_id"])
    counted = of.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("op_id", "op_kind")).alias("o"))
    if wanted is not None:
        counted = wanted.select("workflow").distinct().join(counted, "workflow", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = lambda c: F.when(F.col("n") == 1, F.col(f"o.{c}")).alias(c)
    return counted.select("workflow", "n", one("op_id"), one("op_kind"))


def chosen_observations(observations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """workflow, n, and the columns of the observation that counts: the named one (wanted: workflow, observation), or a workflow's only one.

    Where there are several to choose from, or none, their columns are null.
    """
    of = observations if wanted is None else observations.join(wanted, ["workflow", "observation"])
    rest = [c for c in observations.columns if c != "workflow"]
    counted = of.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*rest)).alias("o"))
    if wanted is not None:
        counted = wanted.select("workflow").distinct().join(counted, "workflow", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("workflow", "n", *[F.when(F.col("n") == 1, F.col("o")[c]).alias(c) for c in rest])


def runtime_facts(ops: DataFrame, policies: DataFrame, results: DataFrame) -> DataFrame:
    """workflow, op_id, write_authorized, write_succeeded, n_results: unknown without an observation.

    policies: workflow, decision. results: workflow, op_id, outcome. Several decisions of a workflow or
    several results of an operation leave the fact null; violations.of_observations reports them.
    """
    one = lambda c: F.when(F.count(F.lit(1)) == 1, F.min(c))
    seen = results.groupBy("workflow", "op_id").agg(F.count(F.lit(1)).alias("n_results"), one("outcome").alias("outcome"))
    decided = policies.groupBy("workflow").agg(F.count(F.lit(1)).alias("n_decisions"), one("decision").alias("decision"))
    return ops.select("workflow", "op_id").join(decided, "workflow", "left").join(seen, ["workflow", "op_id"], "left").select(
        "workflow", "op_id", F.when(F.col("n_decisions").isNull(), "unknown").otherwise(policy_fact(F.col("decision"))).alias("write_authorized"),
        F.when(F.col("n_results").isNull(), "unknown").otherwise(outcome_fact(F.col("outcome"))).alias("write_succeeded"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )


def may_write_default_cache(event: Column) -> Column:
    """Events whose runs may write the default branch's cache."""
    return event.isin(*WRITE_EVENTS)
