"""Findings of analysis tools against the steps of workflows: a matrix of what each tool reports where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.operators.asof import latest_before
from boundarylens.operators.intervals import overlapping
from boundarylens.sources.shared import stored

#: A tool's results as its summary has them; counts and findings may be absent.
SUMMARY = (
    "observedAt STRING, scope ARRAY<STRING>, results ARRAY<STRUCT<tool: STRING, version: STRING, alertCount: BIGINT, findingCount: BIGINT, relevantFindingCount: BIGINT, "
    "relevantFindings: ARRAY<STRUCT<workflow: STRING, audit: STRING, line: INT, endLine: INT>>, evidenceStatus: STRING>>"
)


def flattened(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned, findings) of summary documents. scanned: tool, file, for every file in scope of every tool. findings: tool, file, rule, first, last; lines are null where a tool names none."""
    results = summaries.select("scope", F.explode("results").alias("r"))
    scanned = results.select(F.col("r.tool").alias("tool"), F.explode("scope").alias("file")).distinct()
    f = results.select(F.col("r.tool").alias("tool"), F.explode("r.relevantFindings").alias("f"))
    return scanned, f.select("tool", F.col("f.workflow").alias("file"), F.col("f.audit").alias("rule"), F.col("f.line").alias("first"), F.coalesce("f.endLine", "f.line").alias("last"))


def step_ranges(steps: DataFrame) -> DataFrame:
    """file, job_id, step_index, first, last: a step reaches from its line to the one before the next step of its file; the last one as far as lines go.

    steps: file, job_id, step_index, line. Steps of one line have the same range; those without a line have none.
    """
    by_file = Window.partitionBy("file").orderBy("line")
    starts = steps.where("line IS NOT NULL").select("file", "line").distinct().withColumn("next", F.lead("line").over(by_file))
    return steps.join(starts, ["file", "line"]).select("file", "job_id", "step_index", F.col("line").alias("first"), F.coalesce(F.col("next") - 1, F.lit(2**31 - 1)).alias("last"))


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """The places that the ranges equal in `by` cover, as the fewest ranges: *by, first, last. Ranges with a null, or that end before they start, cover none.

    A group is sorted in one task, but with one row for each place where something starts, however many ranges start there.
    """
    widest = ranges.where("first <= last").groupBy(*by, "first").agg(F.max("last").alias("last"))
    in_order = Window.partitionBy(*by).orderBy("first")
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = widest.withColumn("fresh", F.coalesce(F.col("first").cast("long") > reached.cast("long") + 1, F.lit(True)).cast("int"))
    return fresh.withColumn("n", F.sum("fresh").over(in_order)).groupBy(*by, "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n")


def _touched_by(findings: DataFrame, places: DataFrame, labels: list[str]) -> DataFrame:
    """file, first, last, labels: the different ranges of places that a finding touches, each with the set of labels of those that do.

    Findings of one label are merged to what they cover, so that a range meets each label about once, however many findings it has.
    """
    hit = overlapping(stored(merged_ranges(findings, ["file", *labels]), "merged-findings"), places, ["file"])
    label = F.struct(*[F.col(f"left_{c}").alias(c) for c in labels])
    return hit.groupBy("file", F.col("right_first").alias("first"), F.col("right_last").alias("last")).agg(F.collect_set(label).alias("labels"))


def located(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """tool, file, rule, job_id, step_index: every finding with every step whose lines it touches; with nulls where it touches none or has no lines.

    What touches is found among different ranges only, steps of one range take it over; so the work grows with steps, findings and the rows of the result, not
    with pairs of findings and steps.
    """
    different = stored(findings.select("tool", "file", "rule", "first", "last").distinct(), "findings")
    ranges = stored(ranges.select("file", "job_id", "step_index", "first", "last"), "ranges")
    places = stored(ranges.select("file", "first", "last").distinct(), "places")
    of_step = ["file", "job_id", "step_index"]
    held = ranges.groupBy(*of_step).agg(F.collect_set(F.struct("first", "last")).alias("at"))
    labelled = _touched_by(different, places, ["tool", "rule"])
    met = held.select(*of_step, F.size("at").alias("n"), F.inline("at")).join(labelled, ["file", "first", "last"])
    # A step of one range has its labels once; only those of several can have them twice.
    rows = ["tool", "file", "rule", "job_id", "step_index"]
    shown = lambda df: df.select(*of_step, F.inline("labels")).select(*rows)
    touched = shown(met.where("n = 1")).unionByName(shown(met.where("n > 1")).distinct())
    full = overlapping(different, stored(merged_ranges(places, ["file"]), "covered"), ["file"]).select("file", *[F.col(f"left_{c}").alias(c) for c in ("tool", "rule", "first", "last")]).distinct()
    key = ["tool", "file", "rule", "first", "last"]
    other = full.select(*[F.col(c).alias(f"o_{c}") for c in key])
    none = different.join(other, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in key], "left_anti").select("tool", "file", "rule").distinct()
    return touched.unionByName(none.selectExpr("tool", "file", "rule", "cast(NULL AS string) AS job_id", "cast(NULL AS string) AS step_index"))


def rule_totals(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """rule, n, firsts, jobs: of the pairs of a finding of the rule and a step that it touches, their number, the sum of the steps' first lines, and how many jobs they lie in.

    A finding touches all steps but those that start after its end and those that end before its start, so running totals by line
    give both sums without the pairs; two as-of joins look them up.
    """
    fine = stored(ranges.where("first <= last").select("file", "job_id", "first", "last"), "ranges")
    asked = findings.where("first <= last").groupBy("rule", "file", "first", "last").agg(F.count(F.lit(1)).alias("w"))
    asked = stored(asked, "findings")

    def running(at: Column) -> DataFrame:
        here = fine.groupBy("file", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
        so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        return here.select("file", "at", F.sum("n").over(so_far).alias("n"), F.sum("firsts").over(so_far).alias("firsts"))

    started = latest_before(asked.withColumn("at", F.col("last").cast("long")), running(F.col("first").cast("long")), ["file"]).drop("at").withColumnRenamed("found", "started")
    both = latest_before(started.withColumn("at", F.col("first").cast("long")), running(F.col("last").cast("long") + 1), ["file"])
    sums = {c: F.sum(F.col("w") * (F.coalesce(F.col(f"started.{c}"), F.lit(0)) - F.coalesce(F.col(f"found.{c}"), F.lit(0)))) for c in ("n", "firsts")}
    totals = both.groupBy("rule").agg(*[v.alias(c) for c, v in sums.items()]).where("n > 0")
    labelled = _touched_by(asked, stored(fine.select("file", "first", "last").distinct(), "places"), ["rule"])
    of_job = fine.select("file", "first", "last", "job_id").distinct().join(labelled, ["file", "first", "last"])
    # Dealt by job before the labels multiply the rows, which are small as they are read.
    jobs = of_job.select("job_id", "labels").repartition("job_id").select("job_id", F.inline("labels")).groupBy("rule").agg(F.count_distinct("job_id").alias("jobs"))
    return totals.join(jobs, totals["rule"].eqNullSafe(jobs["rule"])).select(totals["rule"], "n", "firsts", "jobs")


def matrix(scanned: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """A row per file, a column per tool: its rules there, in order and joined by a comma; `none` if it scanned the file and found nothing, null if it did not scan it."""
    rules = findings.where(F.col("tool").isin(*tools)).groupBy("file", "tool").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    cells = scanned.where(F.col("tool").isin(*tools)).select("file", "tool").distinct().join(rules, ["file", "tool"], "full").select("file", "tool", F.coalesce("rules", F.lit("none")).alias("rules"))
    return cells.groupBy("file").pivot("tool", tools).agg(F.first("rules"))
