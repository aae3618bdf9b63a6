"""As-of joins and the search for the cache a restore gets, against brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from boundarylens.operators import asof, caches
from boundarylens.operators.asof import latest_before
from boundarylens.registry import QUERIES
from boundarylens.sources.shared import stored


def test_latest_before_equals_brute_force(spark):
    r = random.Random(3)
    when = lambda: r.choice([None, *range(40)])
    entries = [(r.choice("aaaaab"), when(), i) for i in range(300)]
    lookups = [(r.choice("aaaaabc"), when(), i) for i in range(300)]
    e = spark.createDataFrame(entries, "g string, at int, entry int").repartition(3)
    q = spark.createDataFrame(lookups, "g string, at int, look int").repartition(3)
    got = {x.look: x.found and x.found.entry for x in latest_before(q, e, ["g"], prefer="entry").collect()}
    late = lambda t: (t is not None, t)
    for g, at, i in lookups:
        fits = [(late(t), n) for h, t, n in entries if h == g and (at is None or t is None or t <= at)]
        assert got[i] == max(fits, default=(None, None))[1]


def test_latest_before_across_ranges(spark):
    """One group over many ranges, most of them without an entry of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = spark.createDataFrame([("g", 5, 1), ("g", 70, 2)], "g string, at int, entry int")
        q = spark.range(100).selectExpr("'g' AS g", "cast(id AS int) AS at", "id AS look")
        got = {x.at: x.found and x.found.entry for x in latest_before(q, e, ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: None if i < 5 else 1 if i < 70 else 2 for i in range(100)}
    assert latest_before(q.where("1 = 0"), e, ["g"]).collect() == []
    assert latest_before(q, e.where("1 = 0"), ["g"]).where("found IS NOT NULL").count() == 0


REFS = "repo string, ref string, kind string, base string"


def test_reachable_scopes(spark):
    refs = spark.createDataFrame([
        ("r", "main", "default", None), ("r", "dev", "branch", None), ("r", "dev2", "branch", "dev"), ("r", "v1", "tag", None), ("r", "refs/pull/1/merge", "pull_request", "dev"),
        ("r", "refs/pull/2/merge", "pull_request", "main"), ("r", "refs/pull/3/merge", "pull_request", None), ("r", "odd", None, None), ("r", "refs/pull/4/merge", "pull_request", "refs/pull/1/merge"),
        ("s", "a", "default", None), ("s", "b", "default", None), ("s", "c", "branch", None), ("t", "x", "branch", None), ("t", "x", "tag", None), ("u", "m", "default", None), ("u", "m", "default", None), (None, "m", "branch", None),
    ], REFS)
    got = {(r.repo, r.ref): [tuple(x) for x in r.scopes] for r in caches.reachable_scopes(refs).collect()}
    assert got == {
        ("r", "main"): [(0, "main")], ("r", "dev"): [(0, "dev"), (2, "main")], ("r", "dev2"): [(0, "dev2"), (2, "main")], ("r", "v1"): [(0, "v1"), (2, "main")],
        ("r", "refs/pull/1/merge"): [(0, "refs/pull/1/merge"), (1, "dev"), (2, "main")], ("r", "refs/pull/2/merge"): [(0, "refs/pull/2/merge"), (1, "main")],
        ("r", "refs/pull/3/merge"): [(0, "refs/pull/3/merge"), (1, None), (2, "main")], ("r", "odd"): [(0, "odd"), (1, None), (2, "main")],
        ("r", "refs/pull/4/merge"): [(0, "refs/pull/4/merge"), (2, "main")], ("s", "a"): [(0, "a"), (2, None)], ("s", "b"): [(0, "b"), (2, None)], ("s", "c"): [(0, "c"), (2, None)],
        ("t", "x"): [(0, "x"), (1, None), (2, None)], ("u", "m"): [(0, "m")],
    }


def test_restore_keys(spark):
    rows = spark.createDataFrame([(" linux-\n\n  linux-x-  \r\n\tlast", 1), (None, 2), ("", 3)], "a string, n int")
    assert [r.k for r in rows.orderBy("n").select(caches.restore_keys(F.col("a")).alias("k")).collect()] == [["linux-", "linux-x-", "last"], [], []]


def brute_resolved(writes, restores, refs):
    """Every restore against every write: attributes match, don't, or might; the best in order of scope, term and age counts."""
    scopes = {}
    defaults = {}
    for repo, ref, kind, base in refs:
        if kind == "default":
            defaults[repo] = ref
    for repo, ref, kind, base in refs:
        seen = [(0, ref)]
        if kind == "pull_request" or kind is None:
            seen.append((1, base if kind else None))
        if kind != "default" and not (kind == "pull_request" and base == defaults.get(repo) and base is not None):
            seen.append((2, defaults.get(repo)))
        scopes[repo, ref] = seen
    known = [w for w in writes if None not in w]
    first = {}
    for w in known:
        first[w[1:6]] = min(first.get(w[1:6], w), w, key=lambda x: (x[6], x[0]))
    entries = list(first.values()) + [w for w in writes if None in w]
    out = {}
    for rid, repo, backend, ref, key, terms, version, at in restores:
        best = None
        seen = [(0, None)] if ref is None else scopes.get((repo, ref)) or [(0, ref), (1, None), (2, defaults.get(repo))]
        for wid, wrepo, wbackend, wscope, wkey, wversion, wat in entries:
            pairs = [(repo, wrepo), (backend, wbackend), (version, wversion)]
            if any(a is not None and b is not None and a != b for a, b in pairs) or (at is not None and wat is not None and wat > at):
                continue
            shared_gap = sum(a is None or b is None for a, b in [*pairs, (at, wat)])
            for rank, scope in seen:
                if wscope is not None and scope is not None and scope != wscope:
                    continue
                if wscope is None and rank != seen[0][0]:
                    continue
                if scope is None and ref is not None and wscope is not None and re.match(caches.PULL_REQUEST_SCOPE, wscope):
                    continue
                for n, text in enumerate([key, *[x for x in terms or [] if x]]):
                    if wkey is None or (n == 0 and text is None):
                        if n:
                            continue
                        gap = 1
                    elif wkey != text if n == 0 else not wkey.startswith(text):
                        continue
                    else:
                        gap = 0
                    open_ = shared_gap + gap + (scope is None or wscope is None) > 0
                    rated = (-rank, -n, wat is None, -1 if wat is None else wat, open_, wid)
                    if best is None or rated > best:
                        best = rated
        out[rid] = ("false", None, None, None, None) if best is None else (
            ("unknown", None, best[5]) if best[4] else ("true", best[5], None)) + (-best[0], -best[1])
    return out


WRITES, RESTORES = "id string, repo string, backend string, scope string, key string, version string, at int", "id string, repo string, backend string, ref string, key string, restore_keys array<string>, version string, at int"


def test_resolved_equals_brute_force(spark):
    for seed, gaps in ((1, 0.0), (2, 0.04), (3, 0.15)):
        r = random.Random(seed)
        some = lambda x: None if r.random() < gaps else x
        refs = [("r", "main", "default", None), ("r", "dev", "branch", None), ("r", "refs/pull/1/merge", "pull_request", "dev"), ("r", "refs/pull/2/merge", "pull_request", None), ("q", "main", "branch", None), ("q", "odd", None, None)]
        names = ["main", "dev", "refs/pull/1/merge", "refs/pull/2/merge", "odd", "elsewhere"]
        keys = ["k", "k-a", "k-b", "k-a-1", "k-a-2", "m-1"]
        writes = [(f"w{i:03}", some(r.choice("rrq")), some(r.choice("gg") + "h"), some(r.choice(names)), some(r.choice(keys)), some(r.choice(["v1", "v2"])), some(r.randrange(50))) for i in range(120)]
        restores = [
            (f"r{i:03}", some(r.choice("rrq")), some("gh"), some(r.choice(names)), some(r.choice([*keys, "none"])), r.choice([None, [], ["k-a"], ["k-a-", "k-"], ["x", "", "m"], [None, "k"]]), some(r.choice(["v1", "v2"])), some(r.randrange(60)))
            for i in range(150)
        ]
        got = caches.resolved(spark.createDataFrame(writes, WRITES).repartition(3), spark.createDataFrame(restores, RESTORES).repartition(3), spark.createDataFrame(refs, REFS))
        assert {x.restore_id: tuple(x)[1:] for x in got.collect()} == brute_resolved(writes, restores, refs)


def test_resolved_of_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    one = spark.createDataFrame([("r1", "r", "g", "main", "k", None, "v", 3)], RESTORES)
    assert caches.resolved(none(WRITES), none(RESTORES), none(REFS)).collect() == []
    assert [tuple(x)[:2] for x in caches.resolved(none(WRITES), one, none(REFS)).collect()] == [("r1", "false")]
    assert caches.resolved(spark.createDataFrame([("w", "r", "g", "main", "k", "v", 3)], WRITES), none(RESTORES), none(REFS)).collect() == []


def test_only_what_first_and_last_entries_leave_open_is_sorted(spark, monkeypatch):
    """Restores look for their entry by time in one scope and by one term, and only where some of its entries are later than they are."""
    refs = [("r", "main", "default", None)] + [("r", f"b{i}", "branch", None) for i in range(20)]
    writes = [(f"w{i:02}", "r", None if i % 5 == 4 else "g", "main", f"k-{i % 3}", None if i % 7 == 6 else "v", i) for i in range(30)]
    restores = [(f"r{i:02}", "r", "g", f"b{i % 20}", f"k-{i % 3}", ["k-", "k"], "v", 15 if i < 10 else 99) for i in range(40)]
    sorted_rows = []

    def counted(lookups, entries, *rest, **named):
        sorted_rows.append((lookups.count(), entries.count()))
        return latest_before(lookups, entries, *rest, **named)

    monkeypatch.setattr(caches, "latest_before", counted)
    got = caches.resolved(spark.createDataFrame(writes, WRITES), spark.createDataFrame(restores, RESTORES), spark.createDataFrame(refs, REFS))
    assert {x.restore_id: tuple(x)[1:] for x in got.collect()} == brute_resolved(writes, restores, refs)
    ((lookups, entries),) = sorted_rows
    assert 0 < lookups <= 10 * 4 and 0 < entries <= 16  # ten restores, up to four sets of what entries miss; the entries until then


def test_lookups_are_not_broadcast(spark, data, monkeypatch):
    """Spark takes restores times scopes times terms to be as small as the file of restores; they are dealt, not sent through the driver."""
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def planned(df, name):
        plans[name] = plan(df)
        return stored(df, name)

    monkeypatch.setattr(caches, "stored", planned)
    monkeypatch.setattr(asof, "stored", planned)
    plans["result"] = plan(QUERIES["op_s3_same_cache"](spark, data))
    assert "SortMergeJoin" in plans["cache-found"] and "SortMergeJoin" in plans["as-of"]
    for name in ("cache-found", "as-of", "result"):
        sent = [line for line in plans[name].splitlines() if "BroadcastHashJoin" in line]
        assert all("[part#" in line for line in sent), (name, sent)  # what ranges end with is one row a range
