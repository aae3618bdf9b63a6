"""The CSV table in splits of any size, against Python's own reader."""

from __future__ import annotations

import csv
import random

import pytest

from boundarylens.sources import readers

HEADER = ["filePath", "line", "workflowName", "jobId", "stepIndex", "kind", "name", "detail"]


def nasty_file(path, seed, n, end, mark=""):
    """Quoted line breaks, doubled quotes, commas, empty fields, blank lines, other scripts."""
    r = random.Random(seed)
    texts = ["", "-", "plain", 'say ""hi""'.replace('""', '"'), "two\nlines", "a,b", "\n", "x\r\ny", "漢字\n\n\n" * 9, '"', '"\n"', " spaced "]
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(mark)
        rows = csv.writer(out, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL, lineterminator=end)
        rows.writerow(HEADER)
        for i in range(n):
            rows.writerow([r.choice(texts), i, *[r.choice(texts) for _ in range(6)]])
            if r.random() < 0.1:
                out.write(end)


def by_python(*paths):
    out = []
    for path in paths:
        with open(path, newline="", encoding="utf-8-sig") as source:
            out += [tuple(int(x[k]) if k == "line" else x[k] for k in HEADER) for x in csv.DictReader(source)]
    return out


@pytest.fixture
def splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "end", "size"), [(1, "\n", 300), (2, "\r\n", 700), (3, "\n", 10**8)])
def test_table_in_splits(spark, tmp_path, splits, seed, end, size):
    for name, k in (("a.csv", 0), ("b.csv", 10), ("c.csv", 20)):
        nasty_file(tmp_path / name, seed + k, 60, end, "﻿" if k == 10 else "")
    splits(size)
    got = readers.read_extraction(spark, str(tmp_path)).orderBy("row_seq").collect()
    assert [tuple(r)[:8] for r in got] == by_python(*(tmp_path / n for n in ("a.csv", "b.csv", "c.csv")))
    assert len({r.row_seq for r in got}) == len(got)
    one = readers.read_extraction(spark, str(tmp_path / "b.csv")).orderBy("row_seq").collect()
    assert [tuple(r)[:8] for r in one] == by_python(tmp_path / "b.csv")


def test_one_file_is_read_by_many_tasks(spark, tmp_path, splits):
    nasty_file(tmp_path / "a.csv", 5, 400, "\n")
    splits(2000)
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
    assert [tuple(r)[:8] for r in readers.read_extraction(spark, str(tmp_path / "a.csv")).orderBy("row_seq").collect()] == by_python(tmp_path / "a.csv")


def test_unclosed_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n1,2\n")
    (tmp_path / "b.csv").write_text('h\nx,"open\nstill\n')
    (tmp_path / "c.csv").write_text("")
    got = readers.read_records(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.record for r in got] == ["h", "1,2", "h", 'x,"open\nstill']
    assert readers.read_extraction(spark, str(tmp_path / "c.csv")).collect() == []
