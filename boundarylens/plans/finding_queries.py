"""Findings of tools as queries: where they lie, and which tool says what about a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundarylens.operators import findings as T
from boundarylens.plans import sql as S
from boundarylens.plans.queries import register_on
from boundarylens.sources.binding import table

TOOLS = ("purchase", "click", "view")
_FIRST, _LAST = "event_id % 997", "event_id % 997 + CASE event_id % 11 WHEN 0 THEN 300 WHEN 1 THEN -1 ELSE user_id % 6 END"
_FILE = "concat('wf/', {n} % 60, '.yml')"
S.cte("finding", "", f"SELECT event_type AS tool, {_FILE.format(n='user_id')} AS file, 'rule-' || (event_id % 9) AS rule, CASE WHEN event_id % 13 <> 0 THEN ({_FIRST})::INT END AS first, CASE WHEN event_id % 13 <> 0 THEN ({_LAST})::INT END AS last FROM events")
S.cte("step_line", "", f"SELECT {_FILE.format(n='l_orderkey')} AS file, l_orderkey::VARCHAR AS job_id, l_linenumber::VARCHAR AS step_index, (l_partkey % 1000)::INT AS line FROM lineitem WHERE l_linenumber <= 2")
S.cte("step_range", "step_line", """SELECT s.file, job_id, step_index, s.line AS first, coalesce(n.next - 1, 2147483647)::INT AS last FROM step_line s
JOIN (SELECT file, line, lead(line) OVER (PARTITION BY file ORDER BY line) AS next FROM (SELECT DISTINCT file, line FROM step_line)) n ON s.file = n.file AND s.line = n.line""")
S.cte("scan", "finding", "SELECT DISTINCT tool, file FROM finding WHERE rule <> 'rule-0' UNION SELECT 'view', 'wf/clean.yml'")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS tool", f"{_FILE.format(n='user_id')} AS file", "concat('rule-', event_id % 9) AS rule",
        f"CASE WHEN event_id % 13 <> 0 THEN cast({_FIRST} AS int) END AS first", f"CASE WHEN event_id % 13 <> 0 THEN cast({_LAST} AS int) END AS last")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.step_ranges(table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").selectExpr(
        f"{_FILE.format(n='l_orderkey')} AS file", "cast(l_orderkey AS string) AS job_id", "cast(l_linenumber AS string) AS step_index", "cast(l_partkey % 1000 AS int) AS line"))


@register_on("op_s6_step_ranges", "step_range", "SELECT * FROM step_range")
def _(spark, sf_dir):
    return ranges(spark, sf_dir)


@register_on("op_s6_overlaps", "finding step_range", """SELECT rule, count(*) AS n, sum(s.first) AS firsts, count(DISTINCT job_id) AS jobs FROM finding f JOIN step_range s
  ON f.file = s.file AND f.first <= f.last AND f.first <= s.last AND s.first <= f.last GROUP BY rule""")
def _(spark, sf_dir):
    return T.rule_totals(found(spark, sf_dir), ranges(spark, sf_dir))


@register_on("op_s6_located_findings", "finding step_range", """SELECT DISTINCT tool, f.file, rule, job_id, step_index FROM finding f LEFT JOIN step_range s
  ON f.file = s.file AND f.first <= f.last AND f.first <= s.last AND s.first <= f.last""")
def _(spark, sf_dir):
    return T.located(found(spark, sf_dir), ranges(spark, sf_dir))


@register_on("op_s6_finding_matrix", "finding scan", "SELECT file, " + ", ".join(f"min(rules) FILTER (tool = '{t}') AS \"{t}\"" for t in TOOLS) + """ FROM (
  SELECT coalesce(s.file, f.file) AS file, coalesce(s.tool, f.tool) AS tool, coalesce(rules, 'none') AS rules FROM (SELECT * FROM scan WHERE tool IN (""" + ", ".join(f"'{t}'" for t in TOOLS) + """)) s
  FULL JOIN (SELECT file, tool, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM finding WHERE tool IN (""" + ", ".join(f"'{t}'" for t in TOOLS) + """) AND rule = 'rule-0' GROUP BY ALL) f ON s.file = f.file AND s.tool = f.tool) GROUP BY file""")
def _(spark, sf_dir):
    """Files by tool for one rule: what a tool found, that it found nothing, or that it did not look."""
    f = found(spark, sf_dir)
    scanned = f.where("rule <> 'rule-0'").select("tool", "file").unionByName(spark.createDataFrame([("view", "wf/clean.yml")], "tool string, file string"))
    return T.matrix(scanned, f.where("rule = 'rule-0'"), list(TOOLS))
