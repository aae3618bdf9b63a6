"""Periodic runs, the Merkle manifest and nearest neighbours against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boundarylens.llm import merkle, neighbours, queries, runs


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Periodic runs


def plain_runs(words, least=24, power=3):
    """For every period the maximal stretches that keep it; of periods with the same stretch the smallest."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


@st.composite
def repetitive(draw):
    alphabet = draw(st.integers(1, 4))
    pieces = draw(st.lists(st.tuples(st.lists(st.integers(0, alphabet), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
    return [x for piece, times in pieces for x in piece * times][:150]


@settings(max_examples=400, deadline=None)
@given(repetitive(), st.sampled_from([(2, 2), (4, 2), (3, 3), (9, 3), (24, 3), (5, 4)]))
def test_runs_equal_brute_force(word, bounds):
    assert runs.runs(word, *bounds) == plain_runs(word, *bounds)
    assert runs.word_runs([b"%d" % x for x in word]) == plain_runs(word)


def test_runs_of_fibonacci_words_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    for bounds in ((2, 2), (4, 3), (24, 3)):
        assert runs.runs(b, *bounds) == plain_runs(b, *bounds)
    r = random.Random(4)
    period = [r.randrange(90) for _ in range(400)]
    word = [r.randrange(90) for _ in range(77)] + period * 9 + period[:123]
    assert runs.runs(word) == plain_runs(word)
    parts = runs.factors(word)
    assert [a for a, _, _ in parts] == [0, *[b for _, b, _ in parts[:-1]]] and parts[-1][1] == len(word)
    for s, e, earlier in parts:
        assert (e - s == 1 and word[s] not in word[:s]) if earlier < 0 else (earlier < s and word[earlier : earlier + e - s] == word[s:e])


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(((s, e - s, q) for s, e, q in plain_runs(words)), key=lambda x: (x[0], x[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (
        len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join("%d,%d,%d\n" % x for x in found)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_query_on_messy_documents(messy, empty):
    got = runs.digest(runs.periodic_runs(messy, alter=True)).collect()
    texts = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert sorted(map(repr, ((r[0], *r[1:]) for r in got))) == sorted(repr((i, *expected_runs(i, t))) for i, t in texts)
    assert sum(r.n_runs > 0 for r in got) >= 2
    assert runs.digest(runs.periodic_runs(empty)).collect() == []


def test_runs_query_on_given_documents(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") < 6000).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_kolpakov_kucherov_runs(spark, data).collect() if r.doc_id in texts}
    assert got == {i: expected_runs(i, t) for i, t in texts.items()}


# Merkle manifest


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r: sha("".join(map(field, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = plain_tree([leaf(r) for r in groups[k]])
    top = plain_tree([trees[k][-1][0] for k in order]) if order else None
    out = []
    for place, k in enumerate(order):
        for at, r in enumerate(groups[k]):
            path = plain_path(trees[k], at) + plain_path(top, place)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], lower(r[4]))) if bad else leaf(r)
            for left, right in path:
                node = sha(left + node + right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[k][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def manifest_rows(n, seed):
    r = random.Random(seed)
    langs = ["en", "en", "en", "de", None, "", "é", "zz", "z", "a", "b", "c", "d"]
    return [(i, r.choice(["s", None, "ü"]), r.choice(langs), r.choice([i, None]), r.choice([f"Some TEXT {i}", None, "", "É straße "])) for i in range(n)]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_manifest_equals_brute_force(spark, n):
    rows = manifest_rows(n, n)
    if n > 10:
        rows += [rows[3], (rows[4][0], *rows[5][1:]), (None, "s", "en", 1, "NO id"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS key", "'y' AS leaf", "1 AS pos", "2 AS n", "3 AS block").repartition(3)
    assert sorted(map(repr, map(tuple, merkle.tampered_proofs(docs).collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_with_outer_levels(spark):
    """More leaves of a key than a bucket holds, in three buckets, beside small keys."""
    rows = [(i, "s", "en" if i % 50 else f"k{i % 7}", i, f"Text {i}") for i in range(9000)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(map(tuple, merkle.tampered_proofs(docs).collect())) == sorted(plain_manifest(rows))
    built = merkle.build_manifest(docs, merkle.FIELDS)
    leaves = {r.lang: r.leaves for r in built.roots.collect()}
    assert leaves["en"] == 8820 and sum(leaves.values()) == 9000
    whole = merkle.proofs(built).collect()
    assert all(r.verified for r in whole) and len({len(r.proof) for r in whole}) > 1


def test_manifest_of_messy_and_empty_documents(messy, empty):
    rows = [tuple(r) for r in messy.select(*merkle.FIELDS[:3], F.col("size").alias("n_chars"), "text").collect()]
    docs = messy.withColumnRenamed("size", "n_chars")
    assert sorted(map(repr, map(tuple, merkle.tampered_proofs(docs).collect()))) == sorted(map(repr, plain_manifest(rows)))
    assert merkle.tampered_proofs(empty.withColumnRenamed("size", "n_chars")).collect() == []


def test_manifest_equals_its_sql(spark, data):
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    wanted = engine.execute(queries.OP12_SQL).fetchall()
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, data).collect())) == sorted(wanted)


# Nearest neighbours


def plain_neighbours(rows, every, k):
    """Per query row the sorted (distance, id) of all other rows."""
    kept = [(i, np.array([float(x) for x in v])) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.pad(v, (0, size - len(v)))) for i, v in kept]
    out = []
    for at, (i, v) in enumerate(kept):
        if i % every == 0:
            near = []
            for other, (j, w) in enumerate(kept):
                if other != at:
                    total = 0.0
                    for a, b in zip(v.tolist(), w.tolist(), strict=True):
                        total += (a - b) * (a - b)
                    near.append((float(np.sqrt(total)), j))
            out.append((i, sorted(near)[:k], near))
    return out


def test_neighbours_of_a_small_table_are_all_there(spark):
    rows = [(i, [float(i % 4), 1.0 + i, -2.0]) for i in range(9)] + [(None, [1.0] * 3), (11, None), (12, [0.0, -0.0, 0.0]), (13, [1.0, None, 2.0]), (14, [float("nan"), 1.0, 1.0]), (15, [float("inf"), 1.0, 1.0]), (16, [])]
    rows += [(0, [0.0, 1.0, -2.0]), (4, [5.0, 5.0]), (20, [9.0])]  # a repeated row, an id with another vector, shorter vectors
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, query string").selectExpr("*", "1 AS cell", "2 AS v", "3 AS ids").repartition(3)
    got = neighbours.nearest_neighbours(table, every=4, recall=1.0).collect()
    wanted = [(q, n + 1, i, s) for q, near, _ in plain_neighbours(rows, 4, 10) for n, (s, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(wanted) and len(got) == len(wanted)
    assert neighbours.nearest_neighbours(table.where("1 = 0")).collect() == []
    assert neighbours.nearest_neighbours(table.where("vec_id = 7")).collect() == []


def test_neighbours_recall_and_scores(spark, data):
    for rows, every, name in ((None, 20, "given"), ("hot", 10, "a third are copies")):
        table = spark.read.parquet(f"{data}/embeddings.parquet") if rows is None else None
        if table is None:
            r = np.random.default_rng(5)
            base = r.normal(size=(400, 16)) + 4 * r.integers(0, 2, (400, 1))
            listed = [(i, base[7 if i % 3 == 0 else i % 400].tolist()) for i in range(1200)]
            table = spark.createDataFrame(listed, "vec_id long, embedding array<double>")
        rows = [(r.vec_id, r.embedding) for r in table.collect()]
        got = {}
        for r in neighbours.nearest_neighbours(table, every=every).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
        hits = total = 0
        for q, near, every_score in plain_neighbours(rows, every, 10):
            mine = got[q]
            assert [x[2] for x in mine] == list(range(1, 11)) and [x[:2] for x in mine] == sorted(x[:2] for x in mine) and set(x[:2] for x in mine) <= set(every_score)
            hits += len({x[:2] for x in mine} & set(near))
            total += 10
        assert hits >= 0.9 * total, name


def test_walk_takes_cells_in_order_of_their_sums():
    r = np.random.default_rng(3)
    for _ in range(50):
        first, second = r.integers(0, 9, 7) / 2, r.integers(0, 9, 7) / 2
        held = r.integers(0, 3, 49)
        sums = (first[:, None] + second).ravel()
        for enough in (1, 5, 20, 1000):
            cells, last = neighbours.walk(first, second, held, enough)
            assert set(cells) == {c for c in range(49) if held[c] and sums[c] <= last} and sums[cells].tolist() == sorted(sums[cells])
            assert held[cells].sum() >= min(enough, held.sum()) and (last == np.inf or held[sums < last].sum() < enough)
