"""The workflow table that stands behind the benchmark tables: customers are workflows, orders jobs, lineitems steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boundarylens.sources.shared import partitions

COLUMNS = ("file_path", "line", "workflow", "job_id", "step_index", "kind", "name", "detail", "row_seq", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their workflow, a total order within the job, and what kind of step they are.

    Lineitems are sorted once, for their order; the join looks orders up in a hash table of a partition, which holds one short row each.
    """
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lineitem = table(spark, sf_dir, "lineitem")
    return (
        lineitem.repartition(partitions(lineitem), "l_orderkey").join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("rn", F.row_number().over(order))
        .selectExpr(
            "concat('wf-', o_custkey) AS workflow", "concat('wf/', o_custkey, '.yml') AS file_path", "cast(l_orderkey AS string) AS job_id",
            "cast(l_linenumber AS string) AS step_index", "l_orderkey * 1000L + rn * 10L AS base_seq", "l_linenumber", "l_partkey", "l_suppkey",
            "l_returnflag", "l_linestatus",
            "CASE WHEN l_quantity >= 46 THEN 'run' WHEN l_tax >= 0.08D THEN 'other' ELSE 'uses' END AS role",
        )
    )


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-column table with row_seq and part.

    Each of the three source tables is read once and gives all its rows at once; a filter on `part`, as
    the operators set it for the kinds they read, leaves out whole tables.
    """
    event = "CASE c_mktsegment WHEN 'BUILDING' THEN 'pull_request' WHEN 'AUTOMOBILE' THEN 'pull_request_target' WHEN 'MACHINERY' THEN 'workflow_run' WHEN 'FURNITURE' THEN 'workflow_dispatch' ELSE 'push' END"
    labels = "CASE c_mktsegment WHEN 'BUILDING' THEN 'externally-triggerable;not-privileged' WHEN 'HOUSEHOLD' THEN 'not-externally-triggerable;not-privileged' ELSE 'externally-triggerable;privileged' END"
    action = "CASE l_returnflag WHEN 'A' THEN 'actions/upload-artifact' WHEN 'R' THEN 'actions/download-artifact' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'actions/cache' WHEN 1 THEN 'actions/cache/save' ELSE 'actions/cache/restore' END END"
    run_id = "CASE WHEN l_linestatus = 'O' THEN concat('$', '{{ github.event.workflow_run.id }}') ELSE concat('$', '{{ github.run_id }}') END"

    def row(line: str, kind: str, name: str, detail: str, seq: str) -> str:
        return f"named_struct('line', cast({line} AS int), 'kind', '{kind}', 'name', {name}, 'detail', {detail}, 'row_seq', {seq})"

    def part(name: str, df: DataFrame, job: str, step: str, rows: str) -> DataFrame:
        keyed = df.selectExpr("file_path", "workflow", f"{job} AS job_id", f"{step} AS step_index", f"inline({rows})")
        return keyed.selectExpr("file_path", "line", "workflow", "job_id", "step_index", "kind", "name", "detail", "row_seq", f"'{name}' AS part")

    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", "concat('wf-', c_custkey) AS workflow", "concat('wf/', c_custkey, '.yml') AS file_path")
    plain = [row("1", "workflow", "workflow", "'-'", "c_custkey * 10L"), row("2", "event", event, labels, "c_custkey * 10L + 1")]
    targets = [row("2", "event-property", "'workflow_run.workflows'", f"concat('wf-', c_custkey + {k})", f"c_custkey * 10L + 1 + {k}") for k in (1, 2)]
    workflows = f"CASE WHEN c_mktsegment = 'MACHINERY' THEN array({', '.join(plain + targets)}) ELSE array({', '.join(plain)}) END"

    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_orderpriority", "concat('wf-', o_custkey) AS workflow", "concat('wf/', o_custkey, '.yml') AS file_path", "cast(o_orderkey AS string) AS job")
    jobs = ", ".join((
        row("4", "job", "job", "concat('runs-on=', o_orderstatus)", "o_orderkey * 1000L"),
        row("5", "permission", "'permission'", "concat('contents: ', lower(substring(o_orderpriority, 3)))", "o_orderkey * 1000L + 1"),
        row("6", "expression", "concat('$', '{{ github.run_id }}')", "'github.run_id'", "o_orderkey * 1000L + 2"),
    ))

    of_step = lambda kind, name, detail, k: row("l_linenumber + 10", kind, name, detail, f"base_seq + {k}")
    uses = of_step("uses-step", "'-'", f"concat({action}, '@v', l_partkey % 4 + 1)", 3)
    name, path = of_step("uses-argument", "'name'", "concat('art-', l_partkey % 20)", 4), of_step("uses-argument", "'path'", "concat('out/', l_suppkey % 5)", 5)
    key, run = of_step("uses-argument", "'key'", "concat('key-', l_partkey % 20)", 6), of_step("uses-argument", "'run-id'", run_id, 7)
    shell, other = of_step("run-step", "'-'", "concat('make ', l_partkey)", 3), of_step("step", "'-'", "'-'", 3)
    steps = (
        f"CASE WHEN role = 'run' THEN array({shell}) WHEN role = 'other' THEN array({other}) WHEN l_returnflag = 'N' THEN array({uses}, {path}, {key}) "
        f"WHEN l_returnflag = 'R' THEN array({uses}, {name}, {path}, {run}) ELSE array({uses}, {name}, {path}) END"
    )
    return (
        part("workflow", customers, "'-'", "'-'", workflows)
        .unionByName(part("job", orders, "job", "'-'", f"array({jobs})"))
        .unionByName(part("step", steps_of(spark, sf_dir), "job_id", "step_index", steps))
    )
