from __future__ import annotations

import random

import pytest

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def messy_texts() -> list[str | None]:
    """Nulls, empty and blank texts, short and very long ones, copies, near copies, shared passages, other scripts."""
    base = [prose(i, 60 + 11 * i) for i in range(12)]
    near = [" ".join(w if k % 97 != j else f"edit{j}" for k, w in enumerate(base[5].split(" "))) for j in range(10)]
    shared = prose(99, 70)
    return [
        None, "", " \n\t ", "one", "two words", "É à ü 漢字 😀 ß", *base, base[3], base[3], base[3].upper(), *near,
        *[prose(200 + i, 30) + " " + shared + " " + prose(300 + i, 40) for i in range(5)],
        prose(7, 30_000), "x" * 5000, "na " * 400, 'token = "0123456789abcdef0123456789abcdef01234567" end',
    ]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, a repeated row and columns whose names operators use themselves."""
    rows = [(i, t, ["en", "de", None][i % 3], ["src1", "src0", None, "Ünï"][i % 4], i) for i, t in enumerate(messy_texts())]
    rows.append(rows[8])
    rows.append((None, "a document without an id, of some words, that stands for itself", None, None, None))
    schema = "doc_id long, text string, lang string, source string, size long"
    df = spark.createDataFrame(rows, schema)
    for name in ("words", "key", "bucket", "row", "n", "doc", "component_id", "taken", "label"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("1 = 0")
