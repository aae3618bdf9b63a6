"""Readers and writers of the documents around the tables: CSV in splits, JSON, text and Parquet, schemas given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boundarylens.sources.shared import stored

EXTRACTION = "filePath STRING, line INT, workflowName STRING, jobId STRING, stepIndex STRING, kind STRING, name STRING, detail STRING"
KINDS = ("workflow", "event", "event-property", "job", "uses-step", "uses-argument", "run-step", "step", "permission", "expression")
FACT = "STRUCT<value: STRING, sourceKind: STRING, source: STRING, claim: STRING>"
PLACE = "STRUCT<jobId: STRING, stepIndex: INT, sourceKind: STRING, source: STRING, claim: STRING>"
ANNOTATIONS = (
    "schemaVersion STRING, scenarios ARRAY<STRUCT<id: STRING, producerWorkflow: STRING, consumerWorkflow: STRING, description: STRING, "
    f"evidenceStatus: STRING, facts: MAP<STRING, {FACT}>, locations: MAP<STRING, {PLACE}>>>"
)
OBSERVATION = (
    "workflow STRING, id STRING, platform STRING, runId STRING, observedAt STRING, platformPolicy STRUCT<cacheWriteDecision: STRING, effectiveFrom: STRING, basis: STRING>, "
    "operationResults ARRAY<STRUCT<operationId: STRING, outcome: STRING, evidence: ARRAY<STRING>>>"
)
_AT = "STRUCT<workflowFile: STRING, workflowName: STRING, jobId: STRING, stepIndex: INT, meaning: STRING>"
CHAIN = (
    "schemaVersion STRING, scenario STRUCT<id: STRING, platform: STRING, description: STRING, evidenceStatus: STRING>, "
    "facts STRUCT<producerUntrusted: STRING, writeIntent: STRING, writeAuthorized: STRING, writeSucceeded: STRING, sameObject: STRING, readSucceeded: STRING, "
    "consumerUsesObject: STRING, integrityCheckPresent: STRING, integrityCheckPassed: STRING, privilegedConsumer: STRING, hasAuthority: STRING>, "
    f"traceMap STRUCT<start: {_AT}, object_written: {_AT}, object_restored: {_AT}, object_used: {_AT}, integrity_checked: {_AT}, authority_reached: {_AT}>"
)
#: What is read of a model document, and a chain's configuration.
MODEL = (
    "workflow STRUCT<name: STRING, file: STRING, events: ARRAY<STRUCT<name: STRING, externallyTriggerable: BOOLEAN, privileged: BOOLEAN>>>, "
    "sharedStateOperations ARRAY<STRUCT<id: STRING, kind: STRING, jobId: STRING, stepIndex: INT, key: STRING, path: STRING, name: STRING, runId: STRING>>, "
    "verificationFacts STRUCT<sameObject: STRING, consumerUsesObject: STRING, integrityVerified: STRING, privilegedConsumer: STRING, hasAuthority: STRING>, "
    "runtimeObservations ARRAY<STRUCT<id: STRING, platformPolicy: STRUCT<cacheWriteDecision: STRING>, operationResults: ARRAY<STRUCT<operationId: STRING, outcome: STRING>>>>"
)
CONFIG = (
    "schemaVersion STRING, scenario STRUCT<id: STRING, platform: STRING, description: STRING, evidenceStatus: STRING>, producerModel STRING, consumerModel STRING, "
    "producerOperationId STRING, consumerOperationId STRING, facts MAP<STRING, STRING>, "
    "sharedObject STRUCT<kind: STRING, producerRunSelector: STRING, consumerRunSelector: STRING, identityBasis: ARRAY<STRING>>, useStepIndex INT, integrityStepIndex INT, "
    "authority STRUCT<jobId: STRING, stepIndex: INT, meaning: STRING>, evidence ARRAY<STRUCT<kind: STRING, source: STRING, claim: STRING>>"
)
MANIFEST = "schemaVersion STRING, cases ARRAY<STRUCT<id: STRING, model: STRING, expectedVerdict: STRING, basis: STRING>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, value, line (from 0 in its file), files_before (lines of all files before it), quotes, inside, broken: the lines of text files.

    Files are read in splits, by many tasks; sums over the splits, few rows, give where each begins. inside tells whether the quotes before a split are odd in number, broken
    whether that or a line in it with an odd number of quotes makes the state of its lines differ.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    lines = lines.select(at.alias("at"), "value").select("at.file", "at.split", F.monotonically_increasing_id().alias("place"), F.col("value"), F.length(F.regexp_replace("value", '[^"]', "")).alias("quotes"))
    lines = stored(lines, "text-lines")
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("lines"), F.sum("quotes").alias("quotes"), F.max(F.col("quotes") % 2).alias("opens"))
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"lines_before": F.coalesce(F.sum("lines").over(ahead), F.lit(0)), "quotes_before": F.coalesce(F.sum("quotes").over(ahead), F.lit(0))})
    files = splits.groupBy("file").agg(F.sum("lines").alias("lines"))
    files = files.select("file", F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files_before"))
    starts = splits.join(files, "file").select("file", "split", "first", "lines_before", "files_before", (F.col("quotes_before") % 2).alias("inside"), ((F.col("opens") == 1) | (F.col("quotes_before") % 2 == 1)).alias("broken"))
    return lines.join(starts, ["file", "split"]).select(
        "file", "split", "value", "quotes", "inside", "broken", (F.col("lines_before") + F.col("place") - F.col("first")).alias("line"), "files_before")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record, seq: the records of CSV files, each as text, in order of file names and of lines.

    A record may hold line breaks inside quotes and reach over any number of splits. A line
    is inside quotes if the quotes before it are odd in number, and only splits with an open quote
    have their lines ordered. Quotes inside quoted fields are doubled, as RFC 4180 says. Blank lines between records are no records; a byte order
    mark is no text. An unclosed quote leaves the rest of its file in one record.
    """
    numbered = numbered_lines(spark, path)
    text = F.regexp_replace("value", r"\r$", "")
    whole = numbered.where("NOT broken").select("file", "line", "files_before", text.alias("record"))
    # In a broken split a line belongs to the record of the last line before it that began outside quotes; one that none precedes, to the last of earlier splits.
    so_far = Window.partitionBy("file", "split").orderBy("line")
    began = numbered.where("broken").withColumn("open", (F.col("inside") + F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) - F.col("quotes")) % 2)
    began = began.withColumn("head", F.last(F.when(F.col("open") == 0, F.col("line")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    tails = began.groupBy("file", "split").agg(F.max("head").alias("tail"))
    handed = F.last("tail", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    began = began.join(tails.select("file", "split", handed.alias("handed")), ["file", "split"]).withColumn("head", F.coalesce("head", "handed"))
    pieces = began.groupBy("file", "head", "files_before").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("pieces"))
    joined = pieces.select("file", F.col("head").alias("line"), "files_before", F.regexp_replace(F.array_join("pieces.value", "\n"), r"\r$", "").alias("record"))
    bare = F.when(F.col("line") == 0, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return whole.unionByName(joined).select("file", bare.alias("record"), (F.col("files_before") + F.col("line")).alias("seq"), "line").where("record <> ''").drop("line")


def read_extraction(spark: SparkSession, path: str) -> DataFrame:
    """The 8-column table of a CSV file, or of several in one order; empty fields are empty strings, row_seq is the order of the rows.

    The first record of each file is its header; columns are taken in the order of the schema.
    """
    records = read_records(spark, path)
    heads = records.groupBy("file").agg(F.min("seq").alias("head"))
    rows = records.join(heads, "file").where("seq > head").select(F.from_csv("record", EXTRACTION, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("r"), F.col("seq").alias("row_seq"))
    rows = rows.select("r.*", "row_seq")
    return renamed(rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c not in ("line", "row_seq") else F.col(c) for c in rows.columns]))


#: Which part of a stored table the rows of a kind lie in.
PARTS = {"workflow": ("workflow", "event", "event-property"), "job": ("job", "permission", "expression"), "step": ("uses-step", "uses-argument", "run-step", "step")}


def of_kind(table: DataFrame, *kinds: str) -> DataFrame:
    """Rows of these kinds. Of a table with the column `part` only the parts that hold them are read."""
    rows = table.where(F.col("kind").isin(*kinds))
    if "part" in table.columns:
        rows = rows.where(F.col("part").isin(*[p for p, held in PARTS.items() if set(held) & set(kinds)]))
    return rows


def store_extraction(table: DataFrame, path: str) -> None:
    """Write the table as Parquet, a folder for each part."""
    part = F.lit(None).cast("string")
    for name, kinds in PARTS.items():
        part = F.when(F.col("kind").isin(*kinds), name).otherwise(part)
    table.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(path)


def renamed(raw: DataFrame) -> DataFrame:
    return raw.selectExpr("filePath AS file_path", "line", "workflowName AS workflow", "jobId AS job_id", "stepIndex AS step_index", "kind", "name", "detail", "row_seq")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents, never inferred: field order and absent fields stay as in the schema."""
    return spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)


def read_named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same with the column path: where each document comes from."""
    return read_json(spark, path, schema).select("*", F.col("_metadata.file_path").alias("path"))


def write_json(df: DataFrame, path: str) -> None:
    """One document per line, nulls written out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
