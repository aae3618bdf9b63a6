"""Overlapping ranges and the matrix of findings, against brute force and a summary document."""

from __future__ import annotations

import json
import random

from boundarylens.operators import findings as T
from boundarylens.operators.intervals import overlapping
from boundarylens.sources import readers

RANGE = "g string, first int, last int, id int"


def test_overlapping_equals_brute_force(spark):
    r = random.Random(2)

    def some(n, longest):
        out = []
        for i in range(n):
            a = r.choice([None, -5, 0, *[r.randrange(300)] * 20])
            out.append((r.choice("aab"), a, None if a is None or r.random() < 0.03 else a + r.choice([-1, 0, 0, 1, 2, r.randrange(longest)]), i))
        return [*out, ("a", -(2**31), 2**31 - 1, n)]

    left, right = some(150, 400), some(150, 20)
    got = sorted((x.left_id, x.right_id) for x in overlapping(spark.createDataFrame(left, RANGE).repartition(3), spark.createDataFrame(right, RANGE), ["g"]).collect())
    fine = lambda x: None not in x[1:3] and x[1] <= x[2]
    assert got == sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and fine(a) and fine(b) and a[1] <= b[2] and b[1] <= a[2])
    none = spark.createDataFrame([], RANGE)
    assert overlapping(none, none, ["g"]).collect() == [] == overlapping(spark.createDataFrame(left, RANGE), none, ["g"]).collect()


def test_a_long_range_does_not_multiply(spark):
    """A range over everything stands in as few bins as any other."""
    left = spark.createDataFrame([("g", 0, 2**30, 1)], RANGE)
    right = spark.range(1000).selectExpr("'g' AS g", "cast(id * 1000 AS int) AS first", "cast(id * 1000 + 3 AS int) AS last", "cast(id AS int) AS id")
    assert overlapping(left, right, ["g"]).count() == 1000


def test_matrix_of_a_summary_document(spark, tmp_path):
    summary = {
        "observedAt": "2026-01-01", "scope": ["a.yml", "b.yml"],
        "results": [
            {"tool": "one", "alertCount": 0},
            {"tool": "two", "relevantFindings": [{"workflow": "a.yml", "audit": "z"}, {"workflow": "b.yml", "audit": "q", "line": 4, "endLine": 12}, {"workflow": "a.yml", "audit": "b", "line": 3}]},
        ],
    }
    (tmp_path / "s.json").write_text(json.dumps(summary))
    scanned, found = T.flattened(readers.read_json(spark, str(tmp_path), T.SUMMARY))
    assert sorted(map(tuple, T.matrix(scanned, found, ["one", "two", "three"]).collect())) == [("a.yml", "none", "b,z", None), ("b.yml", "none", "q", None)]
    steps = spark.createDataFrame([("b.yml", "j", "0", 2), ("b.yml", "j", "1", 5), ("b.yml", "k", "0", 9), ("b.yml", "k", "1", 13), ("a.yml", "j", "0", 3), ("a.yml", "j", "1", None)], "file string, job_id string, step_index string, line int")
    ranges = T.step_ranges(steps)
    assert sorted((r.file, r.job_id, r.first, r.last) for r in ranges.collect()) == [("a.yml", "j", 3, 2**31 - 1), ("b.yml", "j", 2, 4), ("b.yml", "j", 5, 8), ("b.yml", "k", 9, 12), ("b.yml", "k", 13, 2**31 - 1)]
    got = sorted((r.file, r.rule, r.job_id or "", r.step_index or "") for r in T.located(found, ranges).collect())
    assert got == [("a.yml", "b", "j", "0"), ("a.yml", "z", "", ""), ("b.yml", "q", "j", "0"), ("b.yml", "q", "j", "1"), ("b.yml", "q", "k", "0")]


def test_ranges_of_one_file_do_not_meet_in_pairs(spark, monkeypatch):
    """Findings and steps against brute force: rows that stand twice, gaps, empty ranges, nulls, a step of two lines; what meets in the join is different ranges only."""
    r = random.Random(5)
    step = [(r.choice("ab"), str(i % 60), str(i % 4), a, a + r.randrange(-1, 4)) for i in range(400) for a in [r.randrange(60) * 3]]
    found = [(r.choice("xy"), r.choice(["a", "b", "c", None]), r.choice(["p", "q"]), a, None if a is None else a + r.choice([-1, 0, 2, 60])) for _ in range(500) for a in [r.choice([None, *[r.randrange(-20, 260)] * 9])]]
    f = spark.createDataFrame(found, "tool string, file string, rule string, first int, last int")
    s = spark.createDataFrame(step, "file string, job_id string, step_index string, first int, last int")
    met, plainly = [], T.overlapping
    monkeypatch.setattr(T, "overlapping", lambda *a: met.append((a[0].count(), a[1].count())) or plainly(*a))
    touches = lambda a, b: a[1] == b[0] and a[3] is not None and a[3] <= a[4] and b[3] <= b[4] and a[3] <= b[4] and b[3] <= a[4]
    pairs = [(a, b) for a in found for b in step if touches(a, b)]
    expected = {(a[0], a[1], a[2], b[1], b[2]) for a, b in pairs} | {(*a[:3], None, None) for a in found if not any(touches(a, b) for b in step)}
    got = [tuple(x) for x in T.located(f, s).select("tool", "file", "rule", "job_id", "step_index").collect()]
    assert len(got) == len(expected) and set(got) == expected
    totals = {rule: (len(of), sum(b[3] for _, b in of), len({b[1] for _, b in of})) for rule in "pq" for of in [[p for p in pairs if p[0][2] == rule]]}
    assert {x.rule: (x.n, x.firsts, x.jobs) for x in T.rule_totals(f, s).collect()} == totals
    assert met and 4 * met[0][0] * met[0][1] < len(found) * len(step)
