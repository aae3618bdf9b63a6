"""From model documents, configurations and checker outputs on disk to what is asked of them."""

from __future__ import annotations

import json

import pytest

from boundarylens import api
from boundarylens.operators import evaluation, verdicts, violations
from boundarylens.sources import readers


def operation(id_, kind, step=1, name=None, run_id=None):
    return {"id": id_, "kind": kind, "jobId": "build", "stepIndex": step, "key": None if name else "k", "path": "out", "name": name, "runId": run_id}


def model(name, operations, event="pull_request", privileged=False, seen=(), **facts):
    return {
        "schemaVersion": "0.1.0", "source": {"type": "codeqlTable", "file": "t.csv", "staticAnalysisOnly": True},
        "workflow": {"name": name, "file": f"{name.lower()}.yml", "events": [{"name": event, "externallyTriggerable": True, "privileged": privileged}], "permissions": [], "jobs": [], "expressions": []},
        "sharedStateOperations": operations,
        "verificationFacts": {"sameObject": "unknown", "consumerUsesObject": "unknown", "integrityVerified": "unknown", "privilegedConsumer": "unknown", "hasAuthority": "unknown"} | facts,
        "runtimeObservations": [{"id": i, "platform": "p", "platformPolicy": {"cacheWriteDecision": d}, "operationResults": [{"operationId": o, "outcome": r} for o, r in results]} for i, d, results in seen],
    }


def put(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(document if isinstance(document, str) else json.dumps(document, ensure_ascii=False))


def test_cache_models_of_documents(spark, tmp_path):
    write, other, read = operation("w1", "cacheWriteIntent"), operation("w2", "cacheWriteIntent"), operation("r1", "cacheReadIntent")
    put(tmp_path / "m/one.json", model("One", [write, read], seen=[("o1", "denied", [("w1", "failed")])], hasAuthority=True, sameObject="false"))
    put(tmp_path / "m/plain.json", model("Plain", [write]))
    put(tmp_path / "m/two.json", model("Two", [write, other], seen=[("o1", "allowed", [("w2", "succeeded"), ("w1", "unknown")]), ("o2", "unknown", [])]))
    with pytest.raises(violations.Violations, match=r"not one cache write: .*two\.json: 2"):
        api.cache_models(spark, str(tmp_path / "m"))
    found = api.cache_models(spark, str(tmp_path / "m"), strict=False, output=str(tmp_path / "out"))
    texts = {r.file: r.document for r in found.documents.collect()}
    assert set(texts) == {"one.smv", "plain.smv"} == {p.name for p in (tmp_path / "out").iterdir()}
    assert all((tmp_path / "out" / n).read_text() == t for n, t in texts.items())
    for line in ("write_intent := TRUE;", "write_authorized := FALSE;", "write_succeeded := FALSE;", "has_authority := TRUE;", "same_object := FALSE;", "integrity_verified : boolean;"):
        assert line in texts["one.smv"]
    assert "write_authorized : boolean;" in texts["plain.smv"] and "write_succeeded : boolean;" in texts["plain.smv"]
    assert {(r.rule, r.entity.rsplit("/")[-1]) for r in found.violations.collect()} == {("not one cache write", "two.json"), ("several observations", "two.json")}
    named = api.cache_models(spark, str(tmp_path / "m/two.json"), "w2", "o1")
    text = named.documents.first().document
    assert "write_authorized := TRUE;" in text and "write_succeeded := TRUE;" in text and named.documents.first().op_id == "w2"
    for op, observation, rule in (("gone", None, "not one cache write"), ("r1", None, "no cache write"), ("w1", "o9", "not one observation")):
        with pytest.raises(violations.Violations, match=rule):
            api.cache_models(spark, str(tmp_path / "m/one.json"), op, observation)
    assert verdicts.CACHE_FACTS[0] == "write_intent"


def config(id_, producer, consumer, facts=None, producer_op="artifact-write:build:1", consumer_op="artifact-read:build:0"):
    names = ("writeAuthorized", "writeSucceeded", "sameObject", "readSucceeded", "consumerUsesObject", "hasAuthority")
    return {
        "schemaVersion": "0.2.0", "scenario": {"id": id_, "platform": "P", "description": "説明", "evidenceStatus": "observed"}, "producerModel": producer, "consumerModel": consumer,
        "producerOperationId": producer_op, "consumerOperationId": consumer_op, "facts": {n: "true" for n in names} | {"integrityCheckPresent": "false", "integrityCheckPassed": "false"} | (facts or {}),
        "sharedObject": {"kind": "artifact", "producerRunSelector": "a", "consumerRunSelector": "b", "identityBasis": ["x", "y"]}, "useStepIndex": 1, "integrityStepIndex": 2,
        "authority": {"jobId": "deploy", "stepIndex": 3, "meaning": "reached"}, "evidence": [{"kind": "static", "source": "s", "claim": "c"}],
    }


@pytest.fixture
def configured(tmp_path):
    put(tmp_path / "models/w.json", model("Writer", [operation("artifact-write:build:1", "artifactWriteIntent", 1, "out")]))
    put(tmp_path / "models/r.json", model("Reader", [operation("artifact-read:build:0", "artifactReadIntent", 0, "out", "${{ x }}"), operation("other", "artifactReadIntent", 2, "else")], "workflow_run", True))
    put(tmp_path / "models/unused.json", model("Writer", []))
    put(tmp_path / "configs/good.json", config("CASE-1", "models/w.json", "./models/r.json"))
    return tmp_path


def test_configured_chains_of_documents(spark, configured):
    put(configured / "one/w.json", (configured / "models/w.json").read_text())
    put(configured / "one/r.json", (configured / "models/r.json").read_text())
    put(configured / "configs/good.json", config("CASE-1", "one/w.json", "./one/r.json"))
    found = api.configured_chains(spark, str(configured / "configs"), str(configured / "one"), root=str(configured), output=str(configured / "chains"))
    assert found.documents.first().file == "case-1.json" and [p.name for p in (configured / "chains").iterdir()] == ["case-1.json"]
    text = (configured / "chains/case-1.json").read_text()
    document = json.loads(text)
    assert text == json.dumps(document, ensure_ascii=False, indent=2) + "\n" and json.loads(found.documents.first().document) == document
    assert list(document) == ["schemaVersion", "scenario", "producer", "consumer", "sharedObject", "facts", "traceMap", "evidence"]
    assert document["scenario"] == {"id": "CASE-1", "platform": "P", "description": "説明", "evidenceStatus": "observed"} and document["schemaVersion"] == "0.2.0"
    assert document["sharedObject"] == {"kind": "artifact", "producerRunSelector": "a", "consumerRunSelector": "b", "identityBasis": ["x", "y"], "name": "out"}
    assert document["facts"]["producerUntrusted"] == "true" == document["facts"]["privilegedConsumer"] and document["facts"]["integrityCheckPresent"] == "false"
    assert document["consumer"]["operation"] == {"id": "artifact-read:build:0", "kind": "artifactReadIntent", "jobId": "build", "stepIndex": 0, "name": "out", "path": "out", "runId": "${{ x }}"}
    assert document["traceMap"]["authority_reached"] == {"workflowFile": "reader.yml", "workflowName": "Reader", "jobId": "deploy", "stepIndex": 3, "meaning": "reached"}
    assert document["evidence"] == [{"kind": "static", "source": "s", "claim": "c"}]
    assert api.evaluate(spark, _manifest(configured, "case-1.json", "unsafe"), str(configured / "chains")).cases.first().correct


def _manifest(path, name, expected):
    put(path / "manifest.json", {"schemaVersion": "0.1.0", "cases": [{"id": "a", "model": f"chains/{name}", "expectedVerdict": expected}]})
    return str(path / "manifest.json")


@pytest.mark.parametrize(("change", "rule"), [
    ({"producer": "models/gone.json"}, "no such model"), ({"producer_op": "nothing"}, "not one operation"), ({"consumer_op": "other"}, "names differ"), ({"facts": {"hasAuthority": "maybe"}}, "no such fact value"),
])
def test_configurations_that_stop(spark, configured, change, rule):
    (configured / "models/unused.json").unlink()
    put(configured / "configs/good.json", config(**({"id_": "CASE-1", "producer": "models/w.json", "consumer": "models/r.json"} | change)))
    with pytest.raises(violations.Violations, match=rule):
        api.configured_chains(spark, str(configured / "configs"), str(configured / "models"), root=str(configured))


def test_checker_outputs_in_splits(spark, tmp_path):
    """First specification line, stages that repeat over split borders, carriage returns; as the functions of one text have it."""
    stages = ["start", "start", "object_written", "object_written", "object_restored", "start", "authority_reached", "authority_reached"]
    long = "*** note\n" + "".join(f"-> State: 1.{i} <-\n" + "  filler = 0\n" * 7 + f"  stage = {s}\n" for i, s in enumerate(stages * 6)) + f"{evaluation.SPEC_LINE}(x)  is false\n{evaluation.SPEC_LINE}(y)  is true\n"
    outputs = {
        "long.txt": long, "crlf.out": f"a\r\n{evaluation.SPEC_LINE}(x)  is true\r\n  stage = start\r\n  stage = start\r\nz", "cr.txt": f"{evaluation.SPEC_LINE}(x)  is false\r  stage = start\rx\r  stage = object_used",
        "none.txt": "nothing\n", "odd.txt": f"{evaluation.SPEC_LINE}(x) is unsure\n  stage = start\n",
    }
    for name, text in outputs.items():
        (tmp_path / name).write_bytes(text.encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = evaluation.output_lines(readers.numbered_lines(spark, str(tmp_path))).cache()
        got = {r.file.rsplit("/")[-1]: (r.verdict, r.violated) for r in evaluation.file_verdicts(lines).collect()}
        found = {}
        for r in evaluation.file_stages(lines).orderBy("ord").collect():
            found.setdefault(r.file.rsplit("/")[-1], []).append((r.ord, r.stage))
        assert lines.select("split").distinct().count() > 5
        lines.unpersist()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    one = spark.createDataFrame(list(outputs.items()), "name string, output string")
    from pyspark.sql import functions as F

    for r in one.select("name", evaluation.verdict(F.col("output")).alias("v"), evaluation.violated(F.col("output")).alias("b"), evaluation.stage_array(F.col("output")).alias("s")).collect():
        assert got[r.name] == (r.v, r.b) and found.get(r.name, []) == [(i + 1, s) for i, s in enumerate(r.s)], r.name


def test_evaluation_and_explanation_from_output_files(spark, configured):
    (configured / "models/unused.json").unlink()
    put(configured / "configs/b.json", config("CASE-2", "models/w.json", "models/r.json", {"hasAuthority": "false"}))
    api.configured_chains(spark, str(configured / "configs"), str(configured / "models"), root=str(configured), output=str(configured / "chains"))
    bad = f"{evaluation.SPEC_LINE}(x)  is false\n  stage = start\n  stage = object_written\n  stage = nowhere\n  stage = authority_reached\n"
    put(configured / "outputs/case-1.txt", bad)
    put(configured / "outputs/case-2.log", f"{evaluation.SPEC_LINE}(x)  is true\n")
    put(configured / "m.json", {"schemaVersion": "0.1.0", "cases": [{"id": n, "model": f"x/{n.lower()}.json", "expectedVerdict": v} for n, v in (("CASE-1", "unsafe"), ("CASE-2", "unsafe"))]})
    done = api.evaluate(spark, str(configured / "m.json"), str(configured / "chains"), outputs_path=str(configured / "outputs"))
    assert {(r.id, r.actual, r.correct) for r in done.cases.collect()} == {("CASE-1", "unsafe", True), ("CASE-2", "safe", False)} and done.violations.count() == 0
    told = {r.scenario: r.document for r in api.explain(spark, str(configured / "chains"), str(configured / "outputs"), output=str(configured / "pages")).collect()}
    whole = {r.scenario: r.document for r in api.explain(spark, str(configured / "chains"), spark.createDataFrame([("CASE-1", bad), ("CASE-2", f"{evaluation.SPEC_LINE}(x)  is true\n")], "scenario string, output string")).collect()}
    assert told == whole and "| 4 | `authority_reached` |" in told["CASE-1"] and evaluation.NO_TRACE in told["CASE-2"]
    assert {p.name: p.read_text() for p in (configured / "pages").iterdir()} == {f"{k.lower()}.md": v for k, v in told.items()}
    (configured / "outputs/case-2.log").write_text("nothing")
    put(configured / "m2.json", {"schemaVersion": "0.1.0", "cases": [{"id": n, "model": f"{m}.json", "expectedVerdict": "safe"} for n, m in (("a", "case-2"), ("b", "case-9"))]})
    with pytest.raises(violations.Violations, match="no output: b: case-9.json; no specification line: a: case-2.json; no such chain: b"):
        api.evaluate(spark, str(configured / "m2.json"), str(configured / "chains"), outputs_path=str(configured / "outputs"))


def test_documents_against_a_schema_file(spark, configured):
    put(configured / "schema.json", {"type": "object", "required": ["schemaVersion", "extra"], "properties": {"schemaVersion": {"const": "0.1.0"}, "workflow": {"type": "object", "properties": {"name": {"enum": ["Writer"]}}}}})
    got = {(r.path.rsplit("/")[-1], r.at, r.rule) for r in api.check_documents(spark, str(configured / "models"), str(configured / "schema.json")).collect()}
    assert got == {(n, "", "required: extra") for n in ("w.json", "r.json", "unused.json")} | {("r.json", "/workflow/name", "enum")}
