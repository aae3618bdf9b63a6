"""Join of integer ranges that overlap, by equality of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(first: Column, last: Column) -> Column:
    """The smallest n with a range of at most 2 ** n places: it touches at most two bins of that size."""
    return F.ceil(F.log2(last.cast("long") - first.cast("long") + 1)).cast("int")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], *, first: str = "first", last: str = "last") -> DataFrame:
    """Pairs of rows equal in `by` whose ranges (first to last, both included) share a place, with columns as left_* and right_*.

    Each range has a level by its length and lies in at most two bins of that level; a pair meets once, on the level of the longer of the two, in the bin where
    the later one starts. So every range stands in at most two bins for each level that the other side has, however long it
    is, and the only rows compared are those of one bin. Ranges with a null, or that end before they start, overlap nothing.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.where(F.col(first) <= F.col(last))
        return kept.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in by]).withColumn(f"{name} level", _level(F.col(f"{name}_{first}"), F.col(f"{name}_{last}")))

    a, b = side(left, "left"), side(right, "right")
    # Levels that occur: at most 64 on each side.
    levels = {n: sorted(r[0] for r in df.select(f"{n} level").distinct().collect()) for n, df in (("left", a), ("right", b))}
    if not levels["left"] or not levels["right"]:
        return a.join(b, by).where(F.lit(False)).drop("left level", "right level")

    def binned(df: DataFrame, name: str, other: str) -> DataFrame:
        own = F.col(f"{name} level")
        met = F.array_union(F.array(own), F.filter(F.array(*map(F.lit, levels[other])), lambda x: x > own))
        at = df.withColumn("level", F.explode(met))
        place = lambda c: F.expr(f"shiftright({c}, level)")
        return at.withColumn("bin", F.explode(F.sequence(place(f"cast({name}_{first} AS long)"), place(f"cast({name}_{last} AS long)"))))

    pairs = binned(a, "left", "right").join(binned(b, "right", "left"), [*by, "level", "bin"])
    later = F.expr(f"shiftright(cast(greatest(left_{first}, right_{first}) AS long), level)")
    meets = (F.col("level") == F.greatest("left level", "right level")) & (F.col("bin") == later)
    return pairs.where(meets & (F.col(f"left_{first}") <= F.col(f"right_{last}")) & (F.col(f"right_{first}") <= F.col(f"left_{last}"))).drop("left level", "right level", "level", "bin")
