"""Cache identity as queries: refs and scopes, restore keys, and the entry that each restore gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundarylens.operators import caches as K
from boundarylens.operators import model as M
from boundarylens.plans import sql as S
from boundarylens.plans.queries import register, register_on
from boundarylens.sources.binding import table

#: Bound to the number of a workflow, alike in both languages: its repository and ref. Some refs are not known.
_REPO = "concat('repo-', {n} % 100)"
_REF = "CASE WHEN {n} % 19 = 0 THEN NULL WHEN {n} % 6 = 0 THEN 'main' WHEN {n} % 6 = 3 THEN 'dev' WHEN {n} % 6 IN (1, 2) THEN concat('refs/pull/', {n}, '/merge') ELSE concat('wf-', {n}) END"
_KIND = "CASE {n} % 6 WHEN 0 THEN 'default' WHEN 1 THEN 'pull_request' WHEN 2 THEN 'pull_request' WHEN 3 THEN 'branch' ELSE CASE WHEN {n} % 8 <> 4 THEN 'branch' END END"
_BASE = "CASE WHEN {n} % 6 = 1 THEN 'dev' WHEN {n} % 6 = 2 AND {n} % 4 <> 0 THEN 'main' END"

S.cte("refs", "", f"SELECT {_REPO.format(n='c_custkey')} AS repo, {_REF.format(n='c_custkey')} AS ref, {_KIND.format(n='c_custkey')} AS kind, {_BASE.format(n='c_custkey')} AS base FROM customer")
S.cte("one_ref", "refs", """
SELECT repo, ref, CASE WHEN count(DISTINCT kind) = 1 AND count(kind) = count(*) THEN min(kind) END AS kind, CASE WHEN count(DISTINCT base) = 1 AND count(base) = count(*) THEN min(base) END AS base
FROM refs WHERE ref IS NOT NULL GROUP BY repo, ref""")
S.cte("default_ref", "one_ref", "SELECT repo, CASE WHEN count(*) = 1 THEN min(ref) END AS d FROM one_ref WHERE kind = 'default' GROUP BY repo")
S.cte("seen", "one_ref default_ref", """
SELECT repo, ref, 0 AS rank, ref AS scope FROM one_ref
UNION ALL SELECT repo, ref, 1, base FROM one_ref WHERE kind = 'pull_request' AND NOT coalesce(base LIKE 'refs/pull/%/merge', false)
UNION ALL SELECT repo, ref, 1, NULL FROM one_ref WHERE kind IS NULL
UNION ALL SELECT o.repo, ref, 2, d FROM one_ref o LEFT JOIN default_ref f ON f.repo = o.repo WHERE NOT coalesce(d = ref, false) AND NOT coalesce(kind = 'pull_request' AND base = d, false)""")
S.cte("cache_op", "op", f"""
SELECT op_id AS id, op_kind, {_REPO.format(n='n')} AS repo, CASE WHEN job % 37 <> 0 THEN 'b' || (job % 2) END AS backend, {_REF.format(n='n')} AS ref, key,
  CASE WHEN n % 23 <> 0 THEN 'v' || (n % 2) END AS version, CASE WHEN job % 31 <> 0 THEN job END AS made
FROM (SELECT *, substring(workflow, 4)::BIGINT AS n, job_id::BIGINT AS job FROM op WHERE key IS NOT NULL)""")


def refs(t: DataFrame) -> DataFrame:
    n = "cast(substring(workflow, 4) AS bigint)"
    return t.where("kind = 'workflow'").selectExpr(*[f"{x.format(n=n)} AS {c}" for c, x in (("repo", _REPO), ("ref", _REF), ("kind", _KIND), ("base", _BASE))])


@register("op_s3_reachable_scopes", "seen", "SELECT repo, ref, rank, scope FROM seen")
def _(t):
    return K.reachable_scopes(refs(t)).select("repo", "ref", F.inline("scopes"))


_KEYS = "concat('key-', l_partkey % 20, '-', l_returnflag, {cr}, {lf}, '  key-', l_partkey % 20, {lf}, {lf}, 'key- ', {lf})"


@register_on("op_q7_restore_keys", "", f"""SELECT l_orderkey, l_linenumber, array_to_string(list_filter(list_transform(string_split(replace({_KEYS.format(cr='chr(13)', lf='chr(10)')}, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS keys FROM lineitem""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(K.restore_keys(F.expr(_KEYS.format(cr="char(13)", lf="char(10)"))), "|").alias("keys"))


@register("op_s3_same_cache", "cache_op seen", """WITH first_write AS (
  SELECT * FROM cache_op WHERE op_kind = 'cacheWriteIntent'
  QUALIFY backend IS NULL OR ref IS NULL OR version IS NULL OR made IS NULL OR row_number() OVER (PARTITION BY repo, backend, ref, key, version, made IS NULL ORDER BY made, id) = 1),
ask AS (
  SELECT c.*, s.rank, s.scope, t.n, t.text FROM (SELECT * FROM cache_op WHERE op_kind = 'cacheReadIntent') c
  JOIN (SELECT * FROM seen UNION ALL SELECT DISTINCT repo, NULL, 0, NULL FROM cache_op) s ON s.repo = c.repo AND s.ref IS NOT DISTINCT FROM c.ref,
  LATERAL (SELECT unnest([0, 1, 2]) AS n, unnest([key, substring(key, 1, 5), 'key-']) AS text) t),
hit AS (
  SELECT a.id, e.id AS entry, rank, n, e.made, a.scope IS NULL OR e.ref IS NULL OR a.backend IS NULL OR e.backend IS NULL OR a.version IS NULL OR e.version IS NULL OR a.made IS NULL OR e.made IS NULL AS open
  FROM ask a JOIN first_write e ON a.repo = e.repo AND CASE WHEN n = 0 THEN e.key = text ELSE starts_with(e.key, text) END
   AND coalesce(a.backend = e.backend, true) AND coalesce(a.version = e.version, true) AND coalesce(e.made <= a.made, true) AND coalesce(e.ref = a.scope, true)
   AND NOT (e.ref IS NULL AND rank > 0) AND NOT (a.scope IS NULL AND a.ref IS NOT NULL AND coalesce(e.ref LIKE 'refs/pull/%/merge', false))),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, n, made DESC NULLS FIRST, open DESC, entry DESC) = 1)
SELECT c.id AS restore_id, CASE WHEN b.id IS NULL THEN 'false' WHEN open THEN 'unknown' ELSE 'true' END AS same, CASE WHEN NOT open THEN entry END AS cache_id, CASE WHEN open THEN entry END AS open_id, rank AS scope_rank, n AS term_rank
FROM (SELECT id FROM cache_op WHERE op_kind = 'cacheReadIntent') c LEFT JOIN best b ON b.id = c.id""")
def _(t):
    """Which write's entry each read gets. Writes for the default branch, branches and pull requests; some refs, versions, backends and times are not known."""
    n, job = "cast(substring(workflow, 4) AS bigint)", "cast(job_id AS bigint)"
    ops = M.operations(t).where("key IS NOT NULL").selectExpr(
        "op_id AS id", "op_kind", f"{_REPO.format(n=n)} AS repo", f"CASE WHEN {job} % 37 <> 0 THEN concat('b', {job} % 2) END AS backend", f"{_REF.format(n=n)} AS ref", "key",
        f"CASE WHEN {n} % 23 <> 0 THEN concat('v', {n} % 2) END AS version", f"CASE WHEN {job} % 31 <> 0 THEN {job} END AS at",
    )
    ops = K.stored(ops, "cache-operations")
    restores = ops.where("op_kind = 'cacheReadIntent'").withColumn("restore_keys", F.expr("array(substring(key, 1, 5), 'key-')"))
    return K.resolved(ops.where("op_kind = 'cacheWriteIntent'").withColumnRenamed("ref", "scope"), restores, refs(t))
