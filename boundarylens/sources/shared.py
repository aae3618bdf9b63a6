"""Tables kept for a query: written once to a folder that all executors share, read by every part of a plan that needs them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of input files for each task that sorts what comes of them; of the benchmark's Parquet files about 700,000 rows of steps.
BYTES_A_TASK = 4 << 20

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without and gets a temporary one, which goes when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        made = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_folder.append(f"file://{made}")
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: computed once however often they are read, and the lineage ends there."""
    return stored_together([df], name)


def stored_together(parts: Iterable[DataFrame], name: str, compression: str | None = None) -> DataFrame:
    """The same of several DataFrames of one schema, computed one after another."""
    path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").options(**({"compression": compression} if compression else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it what a query shuffled goes from the disks when it is done, not only when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def input_bytes(df: DataFrame) -> int:
    """Size of the files that a DataFrame is read from, 0 if it is made in memory. Only lengths are read, no contents."""
    files = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f)) for f in df.inputFiles()]  # given encoded, taken as patterns
    return int(df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0) if files else 0


def partitions(df: DataFrame) -> int:
    """Into how many partitions rows made of df are dealt that are sorted then: the session's number, and more where a task would get what comes of more than BYTES_A_TASK.

    So a task's memory does not grow with the input. Given to repartition the number stays: sorts of rows that compress well then don't get several partitions at once.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BYTES_A_TASK))
