"""Checker outputs: verdicts, stage traces, confusion matrix, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The wording of checker output and of the explanation.
SPEC_LINE = "-- specification AG !"
STAGE_LINE = r"^\s*stage = ([a-z_]+)\s*$"
TITLE, SAFETY, VIOLATED, HELD, NO_TRACE = "のNuSMV検証経路", "安全性：", "違反する反例あり", "違反する反例なし", "NuSMV出力に状態経路は含まれていない．"
PROPERTY = "未信頼な成果物を保持したまま権限へ到達しない．"
LIMITATIONS = ("この評価集合は小規模であり，一般的な検出精度を示すものではない．", "shell処理における成果物利用と権限到達の意味付けには手動判断を含む．")
TABLE_HEAD = "| 順序 | 状態 | workflow | job | step | 意味 |\n| --- | --- | --- | --- | ---: | --- |"
#: Fixed values end.


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def verdict(output: Column) -> Column:
    """unsafe or safe by the first specification line; null if there is none or it says neither."""
    first = F.get(F.filter(lines_of(output), lambda x: x.startswith(SPEC_LINE)), 0)
    return F.when(F.endswith(first, F.lit(" is false")), "unsafe").when(F.endswith(first, F.lit(" is true")), "safe")


def violated(output: Column) -> Column:
    return F.contains(output, F.lit("is false"))


def stage_trace(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord (from 1), stage: stages in order, repeats next to each other as one."""
    rows = outputs.select(key, F.posexplode(lines_of(F.col(text))).alias("pos", "line")).select(key, "pos", F.regexp_extract("line", STAGE_LINE, 1).alias("stage")).where("stage <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    changed = rows.withColumn("before", F.lag("stage").over(w)).where("before IS NULL OR before <> stage")
    return changed.select(key, F.row_number().over(w).alias("ord"), "stage")


def stage_array(text: Column) -> Column:
    """The same within a row, where a text is short."""
    stages = F.filter(F.transform(lines_of(text), lambda x: F.regexp_extract(x, STAGE_LINE, 1)), lambda x: x != "")
    return F.filter(stages, lambda x, i: (i == 0) | (x != F.get(stages, i - 1)))


def output_lines(numbered: DataFrame) -> DataFrame:
    """file, split, line, part, value: lines of checker outputs (readers.numbered_lines), also where a carriage return alone ends them."""
    plain = F.regexp_replace("value", r"\r$", "")
    return numbered.select("file", "split", "line", F.posexplode(F.split(plain, "\r")).alias("part", "value"))


def file_verdicts(lines: DataFrame) -> DataFrame:
    """file, verdict, told (the first specification line), violated: of whole outputs. Sums over lines, so that one large output is no task's alone."""
    spec = F.when(F.col("value").startswith(SPEC_LINE), F.struct("line", "part"))
    first = lines.groupBy("file").agg(F.min_by("value", spec).alias("told"), F.max(violated(F.col("value"))).alias("violated"), F.count(spec).alias("n"))
    told = F.when(F.col("n") > 0, F.col("told"))
    return first.select("file", verdict(told).alias("verdict"), told.alias("told"), "violated")


def file_stages(lines: DataFrame) -> DataFrame:
    """file, ord (from 1), stage: the stages of whole outputs in order, repeats next to each other as one.

    Each split collapses its own; its first stage is held against the last one of the splits before, and its places start after theirs.
    """
    rows = lines.select("file", "split", "line", "part", F.regexp_extract("value", STAGE_LINE, 1).alias("stage")).where("stage <> ''")
    here, ahead = Window.partitionBy("file", "split").orderBy("line", "part"), Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "split").agg(F.max_by("stage", F.struct("line", "part")).alias("end"))
    handed = ends.select("file", "split", F.last("end").over(ahead).alias("handed"))
    changed = rows.withColumn("before", F.lag("stage").over(here)).join(handed, ["file", "split"]).where("coalesce(before, handed) IS NULL OR coalesce(before, handed) <> stage")
    counts = changed.groupBy("file", "split").agg(F.count("*").alias("n"))
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("earlier"))
    return changed.join(counts, ["file", "split"]).select("file", (F.col("earlier") + F.row_number().over(here)).cast("int").alias("ord"), "stage")


def explained(output: Column, places: Column) -> Column:
    """(ord, stage, file, workflow, job_id, step_index, meaning) of the stages in an output, an array.

    places: array of (stage, file, workflow, job_id, step_index, meaning). Stages without a place fall
    away, and the numbers keep the gap.
    """
    def row(stage: Column, i: Column) -> Column:
        place = F.get(F.filter(places, lambda p: p.stage == stage), 0)
        return F.when(place.isNotNull(), F.struct((i + 1).alias("ord"), stage.alias("stage"), *[place[c].alias(c) for c in ("file", "workflow", "job_id", "step_index", "meaning")]))

    return F.filter(F.transform(stage_array(output), row), lambda x: x.isNotNull())


def file_markdown(chains: DataFrame, verdicts: DataFrame, stages: DataFrame) -> DataFrame:
    """scenario, document: explanations of whole outputs. chains: scenario, places, name; verdicts and stages with the name of the chain that they are of. Stages without a place fall away."""
    place = chains.select("name", F.explode("places").alias("p")).select("name", "p.*").drop("ord")
    rows = stages.join(place, ["name", "stage"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "stage", "file", "workflow", "job_id", "step_index", "meaning"))).alias("rows"))
    met = stages.groupBy("name").agg(F.count("*").alias("met"))
    told = chains.join(verdicts, "name").join(rows, "name", "left").join(met, "name", "left")
    return told.select("scenario", _page(F.col("scenario"), F.col("violated"), F.coalesce("met", F.lit(0)) == 0, F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType))).alias("document"))


def markdown(key: Column, output: Column, places: Column) -> Column:
    """The explanation of an output as a document."""
    return _page(key, violated(output), F.size(stage_array(output)) == 0, explained(output, places))


def _page(key: Column, bad: Column, empty: Column, rows: Column) -> Column:
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    line = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x.ord.cast("string"), tick(x.stage), tick(x.file), tick(x.job_id), x.step_index, x.meaning), F.lit(" |\n"))
    head = F.concat(F.lit("# "), key, F.lit(TITLE), F.lit("\n\n"), F.lit(SAFETY), F.when(bad, VIOLATED).otherwise(HELD), F.lit("\n\n"))
    table = F.concat(F.lit(TABLE_HEAD + "\n"), F.array_join(F.transform(rows, line), ""))
    return F.concat(head, F.when(empty, NO_TRACE + "\n").otherwise(table))


def judged(cases: DataFrame) -> DataFrame:
    """Cases (expected, actual) with correct."""
    return cases.withColumn("correct", F.col("expected") == F.col("actual"))


def summary(cases: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy (null without cases) and the confusion matrix with unsafe as positive."""
    n = lambda e, a: F.count_if((F.col("expected") == e) & (F.col("actual") == a))
    counted = cases.agg(
        F.count(F.lit(1)).alias("total"), n("unsafe", "unsafe").alias("true_positive"), n("safe", "safe").alias("true_negative"),
        n("safe", "unsafe").alias("false_positive"), n("unsafe", "safe").alias("false_negative"),
    )
    right = F.col("true_positive") + F.col("true_negative")
    return counted.select("total", right.alias("correct"), F.try_divide(right, "total").alias("accuracy"), "true_positive", "true_negative", "false_positive", "false_negative")


def case_documents(cases: DataFrame) -> DataFrame:
    """id, document: the JSON of each judged case."""
    case = F.struct("id", F.col("expected").alias("expectedVerdict"), F.col("actual").alias("actualVerdict"), "correct")
    return cases.select("id", F.to_json(case, {"ignoreNullFields": "false"}).alias("document"))


def report(cases: DataFrame) -> DataFrame:
    """One row with the report as JSON: the property, the summary and the limits. The cases are rows of their own, in case_documents."""
    matrix = F.struct(F.col("true_positive").alias("truePositive"), F.col("true_negative").alias("trueNegative"), F.col("false_positive").alias("falsePositive"), F.col("false_negative").alias("falseNegative"))
    document = F.struct(
        F.lit("0.1.0").alias("schemaVersion"), F.lit(PROPERTY).alias("property"), F.struct("total", "correct", "accuracy", matrix.alias("confusionMatrix")).alias("summary"),
        F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"),
    )
    return summary(cases).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def tool_matrix(findings: DataFrame, tools: list[str]) -> DataFrame:
    """scenario by tool: numbers of findings."""
    return findings.groupBy("scenario").pivot("tool", tools).agg(F.count(F.lit(1))).na.fill(0)
