"""DuckDB SQL of the workflow table and what follows from it, as common table expressions to put queries together from."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (tuple(needs.split()), sql)


def query(needs: str, body: str) -> str:
    """The body with all the expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    # Kept once: many expressions are used several times, and inlined they multiply.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + ("" if not body.startswith("WITH ") else ",") + "\n" + body.removeprefix("WITH ")


cte("sized_lines", "", """
SELECT l.*, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""")
cte("lines", "sized_lines", """
SELECT 'wf-' || o_custkey AS workflow, 'wf/' || o_custkey || '.yml' AS file_path, l_orderkey::VARCHAR AS job_id, l_linenumber::VARCHAR AS step_index,
       l_orderkey * 1000 + rn * 10 AS base_seq, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
       CASE WHEN l_quantity >= 46 THEN 'run' WHEN l_tax >= 0.08::DOUBLE THEN 'other' ELSE 'uses' END AS role FROM sized_lines""")
cte("wf", "", "SELECT c_custkey, c_mktsegment, 'wf-' || c_custkey AS workflow, 'wf/' || c_custkey || '.yml' AS file_path FROM customer")
cte("jb", "", "SELECT o_orderkey, o_orderstatus, o_orderpriority, 'wf-' || o_custkey AS workflow, 'wf/' || o_custkey || '.yml' AS file_path, o_orderkey::VARCHAR AS job_id FROM orders")
_COLS = "file_path, {line} AS line, workflow, {job} AS job_id, {step} AS step_index, '{kind}' AS kind, {name} AS name, {detail} AS detail, {seq} AS row_seq"


def _rows(source: str, line: str, job: str, step: str, kind: str, name: str, detail: str, seq: str) -> str:
    return "SELECT " + _COLS.format(line=f"({line})::INT", job=job, step=step, kind=kind, name=name, detail=detail, seq=f"({seq})::BIGINT") + " FROM " + source


_LABELS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'externally-triggerable;not-privileged' WHEN 'HOUSEHOLD' THEN 'not-externally-triggerable;not-privileged' ELSE 'externally-triggerable;privileged' END"
_EVENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'pull_request' WHEN 'AUTOMOBILE' THEN 'pull_request_target' WHEN 'MACHINERY' THEN 'workflow_run' WHEN 'FURNITURE' THEN 'workflow_dispatch' ELSE 'push' END"
_ACTION = "CASE l_returnflag WHEN 'A' THEN 'actions/upload-artifact' WHEN 'R' THEN 'actions/download-artifact' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'actions/cache' WHEN 1 THEN 'actions/cache/save' ELSE 'actions/cache/restore' END END"
_RUN = "CASE WHEN l_linestatus = 'O' THEN '${{ github.event.workflow_run.id }}' ELSE '${{ github.run_id }}' END"
cte("d1", "wf jb lines", "\nUNION ALL ".join([
    _rows("wf", "1", "'-'", "'-'", "workflow", "workflow", "'-'", "c_custkey * 10"),
    _rows("wf", "2", "'-'", "'-'", "event", _EVENT, _LABELS, "c_custkey * 10 + 1"),
    _rows("(SELECT * FROM wf, (VALUES (1), (2)) t(k) WHERE c_mktsegment = 'MACHINERY')", "2", "'-'", "'-'", "event-property", "'workflow_run.workflows'", "'wf-' || (c_custkey + k)", "c_custkey * 10 + 1 + k"),
    _rows("jb", "4", "job_id", "'-'", "job", "job_id", "'runs-on=' || o_orderstatus", "o_orderkey * 1000"),
    _rows("jb", "5", "job_id", "'-'", "permission", "'permission'", "'contents: ' || lower(substring(o_orderpriority, 3))", "o_orderkey * 1000 + 1"),
    _rows("jb", "6", "job_id", "'-'", "expression", "'${{ github.run_id }}'", "'github.run_id'", "o_orderkey * 1000 + 2"),
    _rows("lines WHERE role = 'uses'", "l_linenumber + 10", "job_id", "step_index", "uses-step", "'-'", f"{_ACTION} || '@v' || (l_partkey % 4 + 1)", "base_seq + 3"),
    _rows("lines WHERE role = 'uses' AND l_returnflag <> 'N'", "l_linenumber + 10", "job_id", "step_index", "uses-argument", "'name'", "'art-' || (l_partkey % 20)", "base_seq + 4"),
    _rows("lines WHERE role = 'uses'", "l_linenumber + 10", "job_id", "step_index", "uses-argument", "'path'", "'out/' || (l_suppkey % 5)", "base_seq + 5"),
    _rows("lines WHERE role = 'uses' AND l_returnflag = 'N'", "l_linenumber + 10", "job_id", "step_index", "uses-argument", "'key'", "'key-' || (l_partkey % 20)", "base_seq + 6"),
    _rows("lines WHERE role = 'uses' AND l_returnflag = 'R'", "l_linenumber + 10", "job_id", "step_index", "uses-argument", "'run-id'", _RUN, "base_seq + 7"),
    _rows("lines WHERE role = 'run'", "l_linenumber + 10", "job_id", "step_index", "run-step", "'-'", "'make ' || l_partkey", "base_seq + 3"),
    _rows("lines WHERE role = 'other'", "l_linenumber + 10", "job_id", "step_index", "step", "'-'", "'-'", "base_seq + 3"),
]))
cte("ev", "d1", """
SELECT workflow, name AS event, list_contains(string_split(detail, ';'), 'externally-triggerable') AS external,
       list_contains(string_split(detail, ';'), 'privileged') AS privileged, row_seq FROM d1 WHERE kind = 'event'""")
cte("job", "d1", """
SELECT workflow, job_id, arg_max(replace(detail, 'runs-on=', ''), row_seq) AS label, min(row_seq) AS job_seq FROM d1 WHERE kind = 'job' GROUP BY ALL""")
cte("step_seq", "d1", """
SELECT workflow, job_id, step_index, max(row_seq) FILTER (kind = 'run-step') AS run_seq, max(row_seq) FILTER (kind <> 'run-step') AS use_seq
FROM d1 WHERE kind IN ('uses-step', 'uses-argument', 'run-step') GROUP BY ALL""")
cte("live", "d1 step_seq", """
SELECT d.*, run_seq IS NOT NULL AND coalesce(use_seq, -1) < run_seq AS is_run, run_seq FROM d1 d JOIN step_seq USING (workflow, job_id, step_index)
WHERE kind IN ('uses-step', 'uses-argument', 'run-step')""")
_ARG = "arg_max(detail, row_seq) FILTER (kind = 'uses-argument' AND name = '{n}' AND NOT is_run AND row_seq > coalesce(run_seq, -1)) AS {a}"
cte("step", "live", """
SELECT workflow, job_id, step_index, CASE WHEN is_run THEN 'run' ELSE 'uses' END AS type,
  CASE WHEN NOT is_run THEN coalesce(regexp_extract(arg_max(detail, row_seq) FILTER (kind = 'uses-step' AND row_seq > coalesce(run_seq, -1)), '^(.*)@', 1), '') END AS action,
  CASE WHEN NOT is_run THEN coalesce(regexp_extract(arg_max(detail, row_seq) FILTER (kind = 'uses-step' AND row_seq > coalesce(run_seq, -1)), '@([^@]*)$', 1), '') END AS version,
  CASE WHEN is_run THEN arg_max(detail, row_seq) FILTER (kind = 'run-step') END AS command, """ + ", ".join(
    _ARG.format(n=n, a=a) for n, a in (("name", "arg_name"), ("path", "arg_path"), ("key", "arg_key"), ("run-id", "arg_run"))) + """
FROM live GROUP BY workflow, job_id, step_index, is_run""")
cte("rule", "", """
SELECT * FROM (VALUES ('actions/cache', 'cacheWriteIntent', 'cache-write'), ('actions/cache', 'cacheReadIntent', 'cache-read'),
  ('actions/cache/save', 'cacheWriteIntent', 'cache-write'), ('actions/cache/restore', 'cacheReadIntent', 'cache-read'),
  ('actions/upload-artifact', 'artifactWriteIntent', 'artifact-write'), ('actions/download-artifact', 'artifactReadIntent', 'artifact-read')) t(action, op_kind, prefix)""")
cte("op", "step job rule", """
SELECT s.workflow, prefix || ':' || s.job_id || ':' || s.step_index AS op_id, op_kind, s.job_id, s.step_index,
  CASE WHEN op_kind LIKE 'cache%' THEN arg_key END AS key, arg_path AS path, CASE WHEN op_kind LIKE 'artifact%' THEN arg_name END AS name,
  CASE WHEN op_kind = 'artifactReadIntent' THEN arg_run END AS run_id
FROM step s JOIN job USING (workflow, job_id) JOIN rule r ON s.action = r.action AND s.type = 'uses'""")
cte("target", "d1 ev", """
SELECT DISTINCT d.workflow, d.detail AS target FROM d1 d
JOIN (SELECT workflow FROM ev WHERE event = 'workflow_run' GROUP BY workflow HAVING count(*) = 1) USING (workflow)
WHERE kind = 'event-property' AND name = 'workflow_run.workflows'""")
cte("head", "d1", "SELECT workflow, arg_min(file_path, row_seq) AS file FROM d1 WHERE kind = 'workflow' GROUP BY workflow")
cte("pair", "op target head", """
SELECT w.workflow AS producer, w.op_id AS producer_op, w.job_id AS producer_job, w.step_index AS producer_step, w.name, pf.file AS producer_file,
  r.workflow AS consumer, r.op_id AS consumer_op, r.job_id AS consumer_job, r.step_index AS consumer_step, cf.file AS consumer_file,
  CASE WHEN count(*) OVER (PARTITION BY r.workflow, r.op_id) = 1 THEN 'unique' ELSE 'ambiguous' END AS pairing,
  'artifact-' || substring(sha256(pf.file || '|' || w.op_id || '|' || cf.file || '|' || r.op_id), 1, 12) AS id
FROM op r JOIN target t ON t.workflow = r.workflow JOIN op w ON w.workflow = t.target AND w.name = r.name AND w.op_kind = 'artifactWriteIntent'
JOIN head pf ON pf.workflow = w.workflow JOIN head cf ON cf.workflow = r.workflow
WHERE r.op_kind = 'artifactReadIntent' AND regexp_extract(trim(r.run_id), '^\\$\\{\\{\\s*(.*?)\\s*\\}\\}$', 1) = 'github.event.workflow_run.id'""")


def fact(seed: str, k: int, m: int, no: str = "false", yes: str = "true") -> str:
    """A fact of three values from a number: one in m is `no`, one in m unknown, the rest `yes`."""
    return f"CASE ({seed} + {k}) % {m} WHEN 0 THEN '{no}' WHEN 1 THEN 'unknown' ELSE '{yes}' END"


SEED = "(cast(producer_job AS bigint) + 3 * cast(consumer_job AS bigint) + cast(consumer_step AS bigint))"
PAIR_FACTS = {
    "writeAuthorized": fact(SEED, 1, 7), "writeSucceeded": fact(SEED, 2, 7), "readSucceeded": fact(SEED, 3, 7), "consumerUsesObject": fact(SEED, 4, 7),
    "integrityCheckPresent": fact(SEED, 5, 3, "true", "false"), "integrityCheckPassed": fact(SEED, 6, 3, "true", "false"), "hasAuthority": fact(SEED, 7, 5),
}
_EV1 = "(SELECT workflow, count(*) n, min(external) external, min(privileged) privileged, min(event) event FROM ev GROUP BY workflow HAVING count(*) = 1)"
cte("chain", "pair ev", f"""
SELECT p.*, pe.event AS producer_event, ce.event AS consumer_event, CASE WHEN pe.external AND NOT pe.privileged THEN 'true' ELSE 'false' END AS "producerUntrusted", 'true' AS "writeIntent", 'true' AS "sameObject",
  CASE WHEN ce.privileged THEN 'true' ELSE 'false' END AS "privilegedConsumer", """ + ", ".join(f'{v} AS "{k}"' for k, v in PAIR_FACTS.items()) + f"""
FROM pair p JOIN {_EV1} pe ON pe.workflow = producer JOIN {_EV1} ce ON ce.workflow = consumer""")
_CAN = " AND ".join(f"\"{f}\" <> 'false'" for f in ("producerUntrusted", "writeIntent", "writeAuthorized", "writeSucceeded", "sameObject", "readSucceeded", "consumerUsesObject", "privilegedConsumer", "hasAuthority"))
UNSAFE = f"({_CAN} AND \"integrityCheckPresent\" <> 'true' AND \"integrityCheckPassed\" <> 'true')"
CONSISTENT = """(NOT (("writeSucceeded" = 'true' AND "writeAuthorized" = 'false') OR ("readSucceeded" = 'true' AND "writeSucceeded" = 'false')
  OR ("readSucceeded" = 'true' AND "writeAuthorized" = 'false') OR ("integrityCheckPassed" = 'true' AND "integrityCheckPresent" = 'false')))"""
_SURE = " AND ".join(f"\"{f}\" = 'true'" for f in ("producerUntrusted", "writeIntent", "sameObject", "readSucceeded", "consumerUsesObject", "privilegedConsumer", "hasAuthority"))
ALWAYS = f"({CONSISTENT} AND {_SURE} AND \"integrityCheckPresent\" = 'false')"
CLASS = f"CASE WHEN {ALWAYS} THEN 'unsafe' WHEN {UNSAFE} THEN 'incomplete' ELSE 'safe' END"
