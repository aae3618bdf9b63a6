"""Documents in files of their own, byte for byte as a plain writer makes them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from boundarylens.sources import documents

SCHEMA = (
    "id string, deep struct<a: int, b: array<struct<c: string, d: double, e: boolean>>, f: array<string>, g: map<string, array<int>>, `odd \"name`: string>, n bigint"
)
TEXTS = ["", "plain", 'quote " and \\ back', "line\nfeed\r\ttab\b\f", "漢字 é 😀", "".join(map(chr, range(32))), "\\u001F \\\\u000B \x0b \x1f", "</a> & / \x7f  "]


def plain(x):
    return x.asDict(recursive=True) if hasattr(x, "asDict") else x


def rows(spark):
    data = []
    for i, t in enumerate(TEXTS):
        deep = None if i == 1 else (i, None if i == 2 else [(t, i / 2, i % 2 == 0), (None, None, None)][: i % 3], [t, None] if i % 2 else [], {"z": [], "a": [i]} if i % 3 else {}, t)
        data.append((f"GHA-{i}", deep, None if i == 3 else i))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_documents_equal_a_plain_writer(spark, tmp_path):
    df = rows(spark).select("id", F.struct("*").alias("all"))
    made = df.select(F.concat(F.lower("id"), F.lit(".json")).alias("file"), documents.pretty_column(df, "all").alias("document"))
    target = tmp_path / "out"
    target.mkdir()
    (target / "old.json").write_text("gone")
    documents.write_documents(made, str(target))
    wanted = {f"{r['id'].lower()}.json": json.dumps(plain(r["all"]), ensure_ascii=False, indent=2) + "\n" for r in df.collect()}
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {k: v.encode() for k, v in wanted.items()}
    documents.write_documents(made.where("file = 'gha-1.json'"), f"file://{target}")
    assert [p.name for p in target.iterdir()] == ["gha-1.json"]


def test_names_that_are_refused(spark, tmp_path):
    target = tmp_path / "out"
    one = spark.createDataFrame([("a.json", "1"), ("b.json", "2")], "file string, document string")
    documents.write_documents(one, str(target))
    for bad in ([("a.json", "3"), ("a.json", "4")], [("../x", "5")], [("", "6")], [(None, "7")]):
        with pytest.raises(Exception, match="name"):
            documents.write_documents(spark.createDataFrame(bad, "file string, document string"), str(target))
        assert {p.name: p.read_text() for p in target.iterdir()} == {"a.json": "1", "b.json": "2"}
