"""Quality by importance resampling.

Two generative models over hashed n-grams of word shapes: one of the target text (documents labelled good), one
of the raw text (all documents). A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw, shifted per n-gram by the cut that separates the labelled documents best. The
n-grams of one text depend on one another: a text counts as at most `effective` independent ones, so that
a long text's weight is its mean per n-gram times that number.

With the shift a weight is the log odds that a document is like the target. The sample's size k is a share
of the expected number of such documents, the sum of these probabilities over all of them, and the sample is
drawn without replacement by Gumbel top-k: weight plus Gumbel noise, the k largest. With a share of 1 hardly
any document like the target is left out; a smaller one draws among them. The noise comes from a hash of
the id, so reruns agree. The k-th largest value is found by histograms of ever narrower ranges; documents
are never sorted or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boundarylens.llm.common import blobs, durable, python_ready, word_hashes

BUCKETS = 2**14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Class of each byte: capitals A, other letters and all bytes over 127 a, digits 0, white space a space; the rest are themselves."""
    table = np.arange(256, dtype=np.uint8)
    for start, end, to in ((65, 91, "A"), (97, 123, "a"), (128, 256, "a"), (48, 58, "0"), (9, 14, " ")):
        table[start:end] = ord(to)
    return table


_CLASS = _classes()


def word_shapes(text: bytes) -> list[bytes]:
    """Words with runs of one class of characters as one: "Vièle, 1990!!" gives Aa, and 0!"""
    classes = _CLASS[np.frombuffer(text, np.uint8)]
    return classes[np.flatnonzero(np.diff(classes, prepend=np.uint8(0)))].tobytes().split()


def ngram_buckets(text: bytes) -> np.ndarray:
    """Bucket numbers of the hashed 1-, 2- and 3-grams of word shapes, which mean the same in every language."""
    h = word_hashes(word_shapes(text))
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX
    triples = (pairs[:-1] * _MIX + h[2:]) * _MIX
    return (np.concatenate([h * _MIX, pairs, triples]) >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """log p_target - log p_raw of every bucket, and the cut per n-gram that separates the labelled documents."""

    log_ratio: np.ndarray
    cut: float


def labelled_sample(labels: DataFrame, most: int, doc_id: str = "doc_id", quality: str = "quality") -> dict[int, int]:
    """At most `most` labelled ids with their label, those with the smallest hashes; labels without id or value take no part."""
    rows = (
        labels.select(F.col(doc_id).cast("long").alias("id"), F.col(quality).cast("int").alias("good"))
        .where("id IS NOT NULL AND good IS NOT NULL")
        .groupBy("id").agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id"), "id").limit(most).collect()
    )
    return {r["id"]: r["good"] for r in rows}


def _counts(docs: DataFrame, good: dict[int, int], text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of the labelled good documents and of all documents; one row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                seen = np.bincount(ngram_buckets(t), minlength=BUCKETS)
                raw += seen
                if good.get(key) == 1:
                    target += seen
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], names=["bucket", "target", "raw"])

    python_ready(docs.sparkSession)
    counted = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, "bucket long, target long, raw long")
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    return np.log((target + smoothing) / (target.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """Between the two classes' means per n-gram, where balanced accuracy is highest: the middle of the best stretch."""
    if not len(good) or not len(bad):
        return -math.inf if not len(bad) else 0.0
    values = np.unique(np.concatenate([good, bad]))
    cuts = (values[:-1] + values[1:]) / 2 if len(values) > 1 else values
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    gone = np.searchsorted(np.sort(bad), cuts) / len(bad)
    score = kept + gone
    best = np.flatnonzero(score >= score.max() - 1e-9)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def _weights(docs: DataFrame, ratio: np.ndarray, columns: list[Column], text: Column, schema: str | StructType) -> DataFrame:
    """The given columns with the log weight and the number of n-grams of the text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, n = [], []
            for t in blobs(batch.column(batch.num_columns - 1)):
                at = ngram_buckets(t)
                n.append(len(at))
                weight.append(float(ratio[at].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.float64()), pa.array(n, pa.int64())], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    python_ready(docs.sparkSession)
    return docs.select(*columns, text.cast("string").alias("body")).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(2**40)).cast("double") + 0.5) / F.lit(float(2**40))
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, k: int, few: int = 4096) -> float:
    """The k-th largest of a one-column DataFrame: narrow the range by histograms until few values are left."""
    name = values.columns[0]
    x = F.col(name)
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or k <= 0:
        return math.inf
    if k >= n:
        return low
    while n > few and high > low:
        width = (high - low) / few
        bins = values.where((x >= low) & (x <= high)).groupBy(F.least(F.floor((x - low) / width), F.lit(few - 1)).alias("bin"))
        counts = sorted((r for r in bins.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()), key=lambda r: -r["bin"])
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high, n = r["low"], r["high"], r["n"]
    if high == low:
        return low
    return sorted((r[0] for r in values.where((x >= low) & (x <= high)).collect()), reverse=True)[k - 1]


def importance_resample(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
    quality: str = "quality", max_labelled: int = 20_000, prior: float = 8.0, effective: int = 64, share: float = 1.0, seed: int = 11,
) -> DataFrame:
    """doc_id, n_ngrams, log_weight, key (with Gumbel noise), kept: one row per document.

    The two models count all documents; labels come from at most `max_labelled` labelled rows, those
    with the smallest hashes of their id. `prior` is the log odds for a document before it is read, so
    that texts too short to tell are kept; `effective` is the number of independent n-grams a text counts
    as at most; `share` is the sample's size as a share of the expected number of documents like the target. A null or empty text has weight `prior`. Rows with the same id share their noise; ties at
    the cut are all kept. Without labels of both kinds everything is kept. An empty table gives an empty
    result. Other columns are not read.
    """
    good = labelled_sample(labels, max_labelled, doc_id, quality)
    ratio = log_ratio(*_counts(docs, good, text, doc_id))
    raw = durable(_weights(docs, ratio, [F.col(doc_id).cast("long")], F.col(text), "doc_id long, raw_weight double, n_ngrams long"), "resample-weights")
    cut = _cut(raw, good)
    keyed = _keyed(raw, F.col("doc_id"), cut, prior, effective, seed)
    return keyed.select("doc_id", "n_ngrams", "log_weight", "key", (F.col("key") >= F.lit(_lowest(keyed, cut, share))).alias("kept"))


def _cut(raw: DataFrame, good: dict[int, int]) -> float:
    """The cut per n-gram from the labelled documents; minus infinity without labels of both kinds."""
    marked = raw.where(F.col("doc_id").isin(list(good)) & (F.col("n_ngrams") > 0)) if len(good) <= 500 else raw.where("n_ngrams > 0").join(
        raw.sparkSession.createDataFrame(list(good.items()), "doc_id long, good int"), "doc_id", "left_semi"
    )
    means = [(good[r["doc_id"]], r["raw_weight"] / r["n_ngrams"]) for r in marked.select("doc_id", "raw_weight", "n_ngrams").collect()]
    of = {g: np.array([m for x, m in means if x == g]) for g in (0, 1)}
    return best_cut(of[1], of[0]) if len(of[0]) and len(of[1]) else -math.inf


def _keyed(raw: DataFrame, doc_id: Column, cut: float, prior: float, effective: int, seed: int) -> DataFrame:
    """raw with log_weight and key. Without a cut all weights are infinite."""
    weight = (F.col("raw_weight") - F.lit(cut) * F.col("n_ngrams") + F.lit(prior)) * F.least(F.lit(1.0), F.lit(float(effective)) / F.col("n_ngrams"))
    weight = F.lit(math.inf) if math.isinf(cut) else F.when(F.col("n_ngrams") == 0, F.lit(prior)).otherwise(weight)
    return raw.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + gumbel(doc_id, seed))


def _lowest(keyed: DataFrame, cut: float, share: float) -> float:
    """The smallest key in the sample. Probabilities are summed as whole millionths, so that reruns agree."""
    if math.isinf(cut):
        return -math.inf
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_weight")))
    expected = keyed.agg(F.sum(F.floor(chance * 1e6))).first()[0] or 0
    return kth_largest(keyed.select("key"), round(share * expected / 1e6))


def resampled_documents(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
    quality: str = "quality", max_labelled: int = 20_000, prior: float = 8.0, effective: int = 64, share: float = 1.0, seed: int = 11,
) -> DataFrame:
    """The documents that the sample keeps, with the columns of docs, whatever their names. An empty table gives an empty result."""
    names = docs.columns
    good = labelled_sample(labels, max_labelled, doc_id, quality)
    ratio = log_ratio(*_counts(docs, good, text, doc_id))
    raw = durable(_weights(docs, ratio, [F.col(f"`{doc_id}`").cast("long").alias("doc_id")], F.col(f"`{text}`"), "doc_id long, raw_weight double, n_ngrams long"), "resample-weights")
    cut = _cut(raw, good)
    if math.isinf(cut):
        return docs
    lowest = _lowest(_keyed(raw, F.col("doc_id"), cut, prior, effective, seed), cut, share)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = StructType(held.schema.fields).add("raw_weight", "double").add("n_ngrams", "long")
    again = _weights(held, ratio, [F.col("row")], F.col(f"row.`{text}`"), schema)
    keyed = _keyed(again, F.col(f"row.`{doc_id}`").cast("long"), cut, prior, effective, seed)
    return keyed.where(F.col("key") >= F.lit(lowest)).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
