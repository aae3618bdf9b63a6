"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from boundarylens.registry import ORACLE_SQL, QUERIES
from boundarylens.sources import shared

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    sql = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(sql.fetchall(), columns)


def test_entry_without_what_only_corpus_operators_need():
    """A library that only they import is missing: the rest of the entry works."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op_') for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), str(len(QUERIES) - 1), "False"]


def test_entry_and_core_without_the_corpus_folders(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline everything else imports and gives its queries."""
    root = Path(__file__).resolve().parents[1]
    leave = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=leave)
    modules = ["boundarylens.api", *(f"boundarylens.{p.parent.name}.{p.stem}" for p in (tmp_path / "copy/boundarylens").glob("*/*.py") if p.stem != "__init__"), *(p.stem for p in (tmp_path / "copy/tests").glob("*.py"))]
    code = f"import sys, importlib; sys.path.append('tests'); [importlib.import_module(m) for m in {modules}]; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def test_a_cluster_needs_a_shared_folder():
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.shared_folder(Elsewhere())
