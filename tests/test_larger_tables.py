"""What shows only on larger tables than the given ones, on small tables that have it too."""

from __future__ import annotations

import duckdb
import pytest

from boundarylens.operators import model
from boundarylens.registry import ORACLE_SQL, QUERIES
from boundarylens.sources import shared
from boundarylens.sources.binding import extraction


def plain(rows):
    return sorted(tuple("null" if x is None else str(x) for x in r) for r in rows)


@pytest.fixture
def compared(spark, data, tmp_path):
    """The given tables, some of them replaced by SQL; gives (rows of a query, rows of its SQL)."""

    def of(name, **tables):
        con = duckdb.connect()
        for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
            con.execute(f"CREATE VIEW given_{t} AS SELECT * FROM '{data}/{t}.parquet'")
            con.execute(f"COPY ({tables.get(t, f'SELECT * FROM given_{t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        sql = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in sql.description]
        return plain(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())), plain(sql.fetchall())

    return of


def test_observations_whose_ids_begin_others(compared):
    """obs-100 is before obs-1000, though 'obs-100=' is after it."""
    got, expected = compared(
        "op_21_appended_observations", orders="SELECT * REPLACE (1 AS o_custkey) FROM given_orders",
        lineitem="SELECT * REPLACE (10.0 AS l_quantity, 0.0 AS l_tax, 'N' AS l_returnflag) FROM given_lineitem",
    )
    assert got == expected and any("obs-100=" in r[2] and "obs-1000=" in r[2] for r in got)


def test_steps_are_sorted_once(spark, data):
    """Rows of steps are sorted where they are merged, not also in the tasks that make them, and the join with jobs does not move them again."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    merged = plan(model.steps(extraction(spark, data)))
    assert merged.count("Sort [workflow") == 1 and merged.count("Exchange hashpartitioning(workflow") == 1
    ops = plan(model.operations(extraction(spark, data)))
    assert ops.count("Exchange hashpartitioning(workflow") == 2  # of the steps, and of the jobs


def test_sorts_of_steps_take_one_partition_a_task(spark, data):
    """Partitions that compress well are not read several by one task, and lineitems are not sorted for their join with orders as well."""
    steps = model.steps(extraction(spark, data))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Sort [l_orderkey") == 1
    assert steps.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_steps_of_documents_are_dealt_once(spark, data):
    """Steps are not written and read again: lineitems are read once, and only rows of steps, jobs and whole jobs are dealt by workflow or job."""
    plan = model.documents(extraction(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert "attached-steps" not in plan and plan.count("l_linenumber#") > 0
    assert plan.count("RepartitionByExpression [workflow") == 1


def test_documents_of_jobs_without_steps_and_with_many_operations(compared):
    """Operations stand by job and step though they are gathered job by job; jobs whose steps are all of other kinds have none."""
    got, expected = compared("op_20_documents", lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 0.08 ELSE 0.0 END AS l_tax, 3 * l_linenumber AS l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 1.0 ELSE l_quantity END AS l_quantity) FROM given_lineitem")
    assert got == expected and got


def test_rows_of_steps_are_short_when_sorted(spark, data):
    """What a row of a step tells is dealt and sorted as a number, not as two texts."""
    plan = model.steps(extraction(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    merge = next(line for line in plan.splitlines() if "Aggregate [workflow" in line)
    assert "slot#" in merge and "kind#" not in merge


def test_more_tasks_sort_steps_of_larger_tables(spark, compared, tmp_path, monkeypatch):
    """Tasks grow in number with the input beyond the session's number of shuffle partitions, so that what one of them sorts does not; jobs are dealt to the same tasks."""
    monkeypatch.setattr(shared, "BYTES_A_TASK", 20_000)
    got, expected = compared("op_17_artifact_write_intent")
    assert got == expected and got
    table = extraction(spark, str(tmp_path))
    tasks = -(-sum((tmp_path / f"{t}.parquet").stat().st_size for t in ("customer", "orders", "lineitem")) // 20_000)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert model.steps(table).rdd.getNumPartitions() == model.operations(table).rdd.getNumPartitions() == tasks


def test_jobs_of_steps_are_aggregated_where_they_are_dealt(spark, data):
    """Tasks that read jobs hold no hash table of them, which grows with the task's split of the file."""
    plan = model.operations(extraction(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [workflow") == 2  # steps, and jobs


def test_sizes_of_files_with_any_name(spark, tmp_path):
    folder = tmp_path / "a b%20[1]{2}*?+" / "x=1%2F2"
    folder.mkdir(parents=True)
    duckdb.sql("SELECT range AS id FROM range(10)").write_parquet(str(folder / "part.parquet"))
    read = spark.read.parquet(f"{tmp_path}/a b*/")
    assert [r.x for r in read.select("x").distinct().collect()] == ["1/2"]
    assert shared.input_bytes(read) == (folder / "part.parquet").stat().st_size
    assert shared.input_bytes(spark.range(10)) == 0
