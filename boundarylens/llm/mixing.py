"""Mixing sources to target weights.

Every document gets a hash-random key; within its source documents stand in the order of that key.
Budgets in words are cut from that order: whole epochs first, then a prefix that ends at the exact
budget. The prefix sums are distributed: keys are uniform, so a source's key range is divided into as
many buckets as its rows need, the buckets are summed (before the shuffle), and only the one bucket in
which a source's cut falls is ordered row by row. A hot source thus has many buckets and no task of
its own. What comes out is one row per source with its cut; documents are compared with that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundarylens.llm.common import durable, word_count

BUCKET_ROWS = 4000
SOURCES_A_TASK = 100_000


def _source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def _random_key(doc_id: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def _point(key: Column) -> Column:
    """The first 32 bits of a key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: src, n_docs, source_size, target.

    Sources share the total size by weight; a target stops at max_epochs times its source's size and
    the excess is shared again by weight until no target is above. The closed form: with sources in
    the order of the share at which they fill up, the common level is the largest of the levels that
    result from taking each beginning of that order as full. Sources may be many, too: both orders are
    taken in ranges.
    """
    sums = durable(sized.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "mix-source-sizes")
    parts = sums.count() // SOURCES_A_TASK + 1
    total = F.lit(sums.agg(F.sum("source_size")).first()[0] or 0)
    named = _before(durable(_ranged(sums, parts, "src"), "mix-named"), {"place": F.lit(1)}, "src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = named.withColumn("weight", weight).withColumn("full_at", F.lit(float(max_epochs)) * F.col("source_size") / F.col("weight"))
    filling = durable(_ranged(weighed.drop("place"), parts, "full_at", "src"), "mix-filling")
    weights_in_all = F.lit(filling.agg(F.sum("weight")).first()[0] or 0)
    full = _before(filling, {"filled": F.col("source_size") * max_epochs, "weighed": F.col("weight")}, "full_at", "src")
    level = full.agg(F.max((total - F.col("filled")) / (weights_in_all - F.col("weighed")))).first()[0]
    target = F.least(F.lit(float(max_epochs)) * F.col("source_size"), F.lit(level).cast("double") * F.col("weight"))
    return full.select("src", "n_docs", "source_size", target.alias("target"))


def _ranged(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Rows dealt by range of an order, with the number of the range."""
    return df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())


def _before(ranged: DataFrame, amounts: dict[str, Column], *order: str) -> DataFrame:
    """For each name the sum of its amount over all rows that stand before in the order: ranges are summed first, then each adds up its own."""
    sums = ranged.groupBy("part").agg(*[F.sum(v).alias(f"{k} in part") for k, v in amounts.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("part", *[F.coalesce(F.sum(f"{k} in part").over(before), F.lit(0)).alias(f"{k} start") for k in amounts])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(starts, "part")
    return placed.select(*[c for c in ranged.columns if c != "part"], *[(F.col(f"{k} start") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(k) for k, v in amounts.items()])


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: its target, whole epochs, the key at which the last epoch is cut and what the documents with that key give."""
    budget = F.floor(F.col("target") + 0.5)
    sources = durable(
        source_targets(sized, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS))),
        "mix-sources",
    )
    bucketed = sized.join(sources.select("src", "n_buckets"), "src").withColumn("bucket", F.floor(_point(F.col("key")) * F.col("n_buckets")))
    sums = bucketed.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut_bucket = (
        sums.withColumn("start", F.sum("in_bucket").over(upto) - F.col("in_bucket"))
        .join(sources.select("src", "rest"), "src")
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("in_bucket")))
        .select("src", "bucket", "start", "rest")
    )
    ties = bucketed.join(cut_bucket, ["src", "bucket"]).groupBy("src", "bucket", "start", "rest", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("src", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("size") * F.col("n")
    cut = (
        ties.withColumn("begin", F.col("start") + F.sum(mass).over(upto) - mass)
        .where((F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("begin") + mass))
        .select("src", F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("begin")) / F.col("n")).alias("cut_words"))
    )
    return durable(sources.join(cut, "src", "left").drop("rest", "n_buckets", "n_docs"), "mix-cuts")


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    size = word_count(F.col(text))
    return docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), _source_key(F.col(source).cast("string")).alias("src")
    ).withColumn("key", _random_key(F.col("doc_id"), F.col("size"), seed))


def _taken() -> Column:
    last = (
        F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), F.col("size"))
        .otherwise(F.col("cut_words"))
    )
    return (F.col("epochs") * F.col("size") + last).cast("long")


def mix(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7,
) -> DataFrame:
    """How many words of every document the mix takes: doc_id, size, source_size, target, taken.

    A null text has size 0 and gives nothing; a null source is a source of its own, the last one.
    Repeated rows count each; rows with the same id and size share what the cut leaves to them evenly,
    rounded down. An empty table gives an empty result. Other columns are not read.
    """
    sized = durable(_sized(docs, text, doc_id, source, seed), "mix-sizes")
    cuts = source_cuts(sized, weights, max_epochs)
    return sized.join(cuts, "src").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mixed_documents(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7,
) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands once for each time it is taken.

    The document on a source's cut gives its first words only, joined by single spaces.
    """
    sized = durable(_sized(docs, text, doc_id, source, seed), "mix-sizes")
    cuts = source_cuts(sized, weights, max_epochs).select(
        "src", "epochs", "cut_key", "cut_words", F.lit(True).alias("known")
    )
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    size = word_count(F.col(f"row.`{text}`"))
    keyed = held.select(
        "row", size.alias("size"), _source_key(F.col(f"row.`{source}`").cast("string")).alias("src")
    ).withColumn("key", _random_key(F.col(f"row.`{doc_id}`"), F.col("size"), seed))
    copies = keyed.join(cuts, "src").select("row", "size", _taken().alias("taken")).where("taken > 0")
    part = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size"))
    turns = copies.select("row", "size", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))).alias("turn"))
    words = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut_text = F.when(part < F.col("size"), F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")).otherwise(F.col(f"row.`{text}`"))
    return turns.select(*[(cut_text if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])
