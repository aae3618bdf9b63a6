"""What several operators share: durable tables, word splitting, bounded Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boundarylens.sources.shared import shared_folder, stored

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() of Python splits on exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Writes rows to the shared folder and reads them back: the lineage ends there.
durable = stored


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write the rows to the shared folder in buckets by key, as many as a shuffle has partitions: joins on the key need no shuffle of them.

    Rows that come from a join on the key lie together already, so each task writes few files. The
    catalog's entry is only needed until the files are known to the returned DataFrame; the files stay.
    """
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{made}").saveAsTable(made)
    found = spark.table(made)
    found.schema  # noqa: B018 - resolved here, while the entry is there
    spark.sql(f"DROP TABLE {made}")
    return found


def python_ready(spark: SparkSession, rows: int = 256) -> None:
    """Before Python code runs in tasks.

    Long texts must not pile up in one Arrow batch: at most so many rows each from here on. And workers
    on this machine must find the library even where only the driver's sys.path has it; on a cluster it
    is installed, or shipped with --py-files.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blobs(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, equal on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def map_batches(df: DataFrame, each, schema: str | StructType) -> DataFrame:
    """mapInArrow with one function of a record batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    python_ready(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Ids that may travel to every executor at once: 8 bytes each, so 8 MB at most.
MOST_BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A durable column of ids for one side of a join: broadcast if counted to be few, else hashed after a shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids.hint("shuffle_hash")
