"""As-of join: for each lookup the latest entry at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.sources.shared import stored


def latest_before(lookups: DataFrame, entries: DataFrame, by: list[str], *, at: str = "at", prefer: str | None = None) -> DataFrame:
    """All lookups with `found`, a struct of the entry's other columns: of those equal in `by` (no nulls) and not later, the latest; null if there is none.

    An entry without a time is before all others, a lookup without one after all. Of entries of one time the one with the
    largest `prefer` counts. Both sides are sorted together in ranges, so that a group with most of the rows is dealt over many
    tasks; each task carries its last entry along, and what a range ends with is handed to those after it. Output and
    memory are linear in the lookups.
    """
    payload = [c for c in entries.columns if c not in (*by, at)]
    told = [c for c in lookups.columns if c not in (*by, at)]
    tie = F.col(prefer) if prefer else F.lit(0)
    e = entries.select(*by, F.lit(0).alias("side"), F.col(at).alias("at"), tie.alias("tie"), F.struct(*payload).alias("entry"))
    q = lookups.select(*by, F.when(F.col(at).isNull(), 2).otherwise(1).alias("side"), F.col(at).alias("at"), F.struct(*told).alias("lookup"))
    both = e.unionByName(q, allowMissingColumns=True).withColumn("late", F.when(F.col("side") == 2, 1).otherwise(0))
    order = [F.col("late"), F.col("at").asc_nulls_first(), F.col("side"), F.col("tie")]
    ranged = stored(both.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "as-of")
    so_far = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumn("found", F.last("entry", ignorenulls=True).over(so_far)).where("side > 0")
    last = Window.partitionBy("part", *by).orderBy(F.col("at").desc_nulls_last(), F.col("tie").desc())
    ends = ranged.where("side = 0").withColumn("place", F.row_number().over(last)).where("place = 1").select("part", *by, "entry")
    # What ranges before one end with, for those ranges that a group reaches into; few rows, one for each group and range.
    spans = ranged.select("part", *by).distinct().join(ends, ["part", *by], "left")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = spans.select("part", *by, F.last("entry", ignorenulls=True).over(before).alias("handed")).where("handed IS NOT NULL")
    joined = here.join(handed, ["part", *by], "left")
    return joined.select(*by, F.col("at").alias(at), "lookup.*", F.coalesce("found", "handed").alias("found"))

