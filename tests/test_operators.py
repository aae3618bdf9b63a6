"""Operators on small tables typed in by hand."""

from __future__ import annotations

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from boundarylens.functions import expressions as X
from boundarylens import api
from boundarylens.operators import chains, evaluation, identity, model, pairing, verdicts, violations
from boundarylens.sources import readers

COLUMNS = "file_path string, line int, workflow string, job_id string, step_index string, kind string, name string, detail string, row_seq long"


def rows(workflow, file, *given):
    return [(file, 1, workflow, job, step, kind, name, detail) for job, step, kind, name, detail in given]


READER = [
    ("-", "-", "workflow", "Reader", "-"), ("r", "-", "job", "r", "runs-on=linux"), ("r", "1", "uses-step", "-", "actions/download-artifact@commit"),
    ("-", "-", "event", "workflow_run", "externally-triggerable;privileged"), ("-", "-", "event-property", "workflow_run.workflows", "Writer"),
    ("-", "-", "event-property", "workflow_run.workflows", "Writer"), ("r", "1", "uses-argument", "name", "out"),
    ("r", "1", "uses-argument", "run-id", " ${{ github.event.workflow_run.id }}\n"),
]
WRITER = [
    ("-", "-", "workflow", "Writer", "-"), ("-", "-", "event", "pull_request", "externally-triggerable;not-privileged"), ("w", "-", "job", "w", "runs-on=a"),
    ("w", "-", "job", "w", "runs-on=b"), ("w", "2", "uses-argument", "name", "old"), ("w", "2", "uses-argument", "name", "out"),
    ("w", "2", "uses-step", "-", "actions/upload-artifact@v@4"), ("w", "3", "uses-step", "-", "actions/cache@v1"), ("w", "3", "uses-argument", "key", "k"),
    ("w", "4", "uses-step", "-", "x/y@1"), ("w", "4", "run-step", "-", "make a"), ("w", "4", "run-step", "-", "make b"), ("lost", "0", "uses-step", "-", "actions/cache@v1"),
    ("w", "5", "uses-argument", "path", "p"), ("w", "6", "step", "-", "-"), ("-", "-", "permission", "permission", " contents : read:all "),
]


def frame(spark, *parts):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(itertools.chain(*parts))], COLUMNS)


@pytest.fixture(scope="module")
def pair(spark):
    return frame(spark, rows("Reader", "r.yml", *READER), rows("Writer", "w.yml", *WRITER))


def test_later_rows_win(pair):
    steps = {(r.job_id, r.step_index): r for r in model.steps(pair).collect()}
    assert steps["w", "2"].arg_name == "out" and (steps["w", "2"].action, steps["w", "2"].version) == ("actions/upload-artifact@v", "4")
    assert (steps["w", "4"].type, steps["w", "4"].command, steps["w", "4"].action) == ("run", "make b", None)
    assert (steps["w", "5"].action, steps["w", "5"].arg_path) == ("", "p") and ("w", "6") not in steps
    job = model.jobs(pair).where("workflow = 'Writer'").first()
    assert (job.label, job.labels) == ("b", ["a", "b"])
    assert model.permissions(pair).first()[1:4] == (None, "contents", "read:all")


def test_operations_of_known_jobs(pair):
    ops = {r.op_id: r for r in model.operations(pair).collect()}
    assert set(ops) == {"artifact-read:r:1", "cache-write:w:3", "cache-read:w:3"}
    # v@4: the name before the last @ is no known action.
    fixed = pair.withColumn("detail", F.regexp_replace("detail", "@v@4", "@v4"))
    assert {r.op_id for r in model.operations(fixed).collect()} == set(ops) | {"artifact-write:w:2"}
    assert ops["cache-write:w:3"].key == "k" and ops["cache-write:w:3"].name is None


def fixed(t):
    return t.withColumn("detail", F.regexp_replace("detail", "@v@4", "@v4"))


def test_pairing_and_its_ids(spark, pair):
    one = pairing.candidates(fixed(pair)).collect()
    assert [(r.producer_op, r.consumer_op, r.pairing) for r in one] == [("artifact-write:w:2", "artifact-read:r:1", "unique")]
    assert one[0].id == "artifact-" + hashlib.sha256(b"w.yml|artifact-write:w:2|r.yml|artifact-read:r:1").hexdigest()[:12]
    twice = [*WRITER, ("w", "7", "uses-step", "-", "actions/upload-artifact@v1"), ("w", "7", "uses-argument", "name", "out")]
    two = pairing.candidates(fixed(frame(spark, rows("Reader", "r.yml", *READER), rows("Writer", "w.yml", *twice)))).collect()
    assert sorted(r.pairing for r in two) == ["ambiguous", "ambiguous"]
    other = [(j, s, k, n, d.replace("event.workflow_run.id", "run_id")) for j, s, k, n, d in READER]
    assert pairing.candidates(fixed(frame(spark, rows("Reader", "r.yml", *other), rows("Writer", "w.yml", *WRITER)))).isEmpty()
    away = [(j, s, k, n, d.replace("Writer", "Nobody")) for j, s, k, n, d in READER]
    assert pairing.candidates(fixed(frame(spark, rows("Reader", "r.yml", *away), rows("Writer", "w.yml", *WRITER)))).isEmpty()
    again = [*READER, ("-", "-", "event", "workflow_run", "externally-triggerable;privileged")]
    assert pairing.candidates(fixed(frame(spark, rows("Reader", "r.yml", *again), rows("Writer", "w.yml", *WRITER)))).isEmpty()


def test_chain_of_the_pair(pair):
    made = chains.assembled(pairing.candidates(fixed(pair)), {n: F.lit("true" if n != "integrityCheckPresent" else "false") for n in chains.ANNOTATED} | {"integrityCheckPassed": F.lit("false")})
    row = made.select("*", verdicts.chain_class().alias("class")).first()
    assert (row.producerUntrusted, row.privilegedConsumer, row["class"]) == ("true", "true", "unsafe")
    assert len(chains.required_elements()) == 46 == len(set(chains.required_elements()))
    told = [chains.record(f"facts.{n}", "manual-judgment", "s", "c") for n in chains.ANNOTATED] + [chains.record(f"traceMap.{s}", "runtime-observation", "s", "c") for s in chains.PLACES]
    whole = made.withColumn("records", chains.provenance("t", "a", "p", F.array(*told)))
    faults = lambda df: sorted(tuple(r) for r in df.select(F.inline(chains.provenance_faults(F.col("records")))).collect())
    assert whole.select(F.size("records"), chains.provenance_exact(F.col("records"))).first()[:] == (46, True) and faults(whole) == []
    odd = whole.withColumn("records", F.concat(F.slice("records", 2, 45), F.array(chains.record("facts.writeIntent", "hearsay", "s", "c"), chains.record("more", "manual-judgment", "s", "c"))))
    assert faults(odd) == [("duplicate", "facts.writeIntent"), ("missing", "scenario.id"), ("source kind", "facts.writeIntent")]
    assert not odd.select(chains.provenance_exact(F.col("records"))).first()[0]


HEADER = "filePath,line,workflowName,jobId,stepIndex,kind,name,detail\n"


def write_table(path, *parts):
    lines = [",".join(f'"{x}"' for x in (file, line, workflow, job, step, kind, name, detail.replace('"', '""'))) for file, line, workflow, job, step, kind, name, detail in itertools.chain(*parts)]
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


def annotation(facts=chains.ANNOTATED, kind="manual-judgment", consumer="Reader", id_="CASE-1"):
    told = lambda v: {"value": v, "sourceKind": kind, "source": "s", "claim": "c"}
    place = {"jobId": "", "stepIndex": 2, "sourceKind": "runtime-observation", "source": "s", "claim": "reached"}
    return {"id": id_, "producerWorkflow": "Writer", "consumerWorkflow": consumer, "description": "d", "evidenceStatus": "observed",
            "facts": {n: told("false" if n.startswith("integrity") else "true") for n in facts}, "locations": {p: place for p in chains.PLACES.values()}}


def test_from_files_to_chains_and_reports(spark, tmp_path):
    good = [(j, s, k, n, d.replace("@v@4", "@v4")) for j, s, k, n, d in WRITER]
    table = write_table(tmp_path / "t.csv", rows("Reader", "r.yml", *READER), rows("Writer", "w.yml", *good))
    notes = tmp_path / "notes.json"
    notes.write_text(json.dumps({"schemaVersion": "0.1.0", "scenarios": [annotation()]}))
    assert api.discover(spark, table).documents.count() == 1
    found = api.discover(spark, table, str(notes), output=str(tmp_path / "chains"))
    row = found.documents.first()
    document = json.loads(row.document)
    assert row.file == "case-1.json" and list(document) == ["schemaVersion", "scenario", "producer", "consumer", "sharedObject", "facts", "traceMap", "evidence", "provenance"]
    assert document["producer"]["operation"] == {"id": "artifact-write:w:2", "kind": "artifactWriteIntent", "jobId": "w", "stepIndex": 2, "name": "out", "path": None, "runId": None}
    assert document["consumer"]["workflow"] == {"name": "Reader", "file": "r.yml", "event": "workflow_run"} and set(document["facts"]) == set(verdicts.CHAIN_FACTS)
    assert document["traceMap"]["authority_reached"] == {"workflowFile": "r.yml", "workflowName": "Reader", "jobId": "r", "stepIndex": 2, "meaning": "reached"}
    assert len(document["provenance"]) == 46 and {r["sourceKind"] for r in document["provenance"]} == set(chains.SOURCE_KINDS)
    text = api.state_models(spark, str(tmp_path / "chains")).first().text
    assert "-- TRACE start: w.yml:w:2 - " in text and "producer_untrusted := TRUE;" in text and "FROZENVAR" not in text
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"schemaVersion": "0.1.0", "cases": [{"id": "a", "model": "x/case-1.json", "expectedVerdict": "unsafe"}, {"id": "b", "model": "gone.json", "expectedVerdict": "safe"}]}))
    with pytest.raises(violations.Violations, match=r"no such chain: b: gone\.json"):
        api.evaluate(spark, str(manifest), str(tmp_path / "chains"))
    done = api.evaluate(spark, str(manifest), str(tmp_path / "chains"), output=str(tmp_path / "out"), strict=False)
    cases, report = done.cases, done.report
    assert {(r.id, r.actual, r.correct) for r in cases.collect()} == {("a", "unsafe", True), ("b", None, None)}
    assert json.loads(report.first().document)["summary"]["confusionMatrix"]["truePositive"] == 1
    told = api.explain(spark, str(tmp_path / "chains"), spark.createDataFrame([("CASE-1", OUTPUT)], "scenario string, output string")).first().document
    assert "| 1 | `start` | `w.yml` | `w` | 2 |" in told


def test_violations_of_scenarios_stop_or_are_told(spark, tmp_path):
    good = [(j, s, k, n, d.replace("@v@4", "@v4")) for j, s, k, n, d in WRITER]
    table = write_table(tmp_path / "t.csv", rows("Reader", "r.yml", *READER), rows("Writer", "w.yml", *good))
    notes = tmp_path / "notes.json"
    cases = [annotation(), annotation(chains.ANNOTATED[1:], id_="CASE-2"), annotation(kind="hearsay", id_="CASE-3"), annotation(consumer="Nobody", id_="CASE-4")]
    notes.write_text(json.dumps({"schemaVersion": "0.1.0", "scenarios": cases}))
    with pytest.raises(violations.Violations, match="CASE-2"):
        api.discover(spark, table, str(notes))
    found = api.discover(spark, table, str(notes), strict=False)
    assert [r.scenario for r in found.documents.collect()] == ["CASE-1"]
    told = {(r.rule, r.entity) for r in found.violations.collect()}
    assert {("missing fact", "CASE-2"), ("source kind of fact", "CASE-3"), ("not one pair", "CASE-4")} <= told


def test_models_with_observations(spark, tmp_path):
    table = write_table(tmp_path / "t.csv", rows("Reader", "r.yml", *READER), rows("Writer", "w.yml", *WRITER))
    seen = tmp_path / "o.json"
    one = {"workflow": "Writer", "id": "run-1", "platformPolicy": {"cacheWriteDecision": "denied"}, "operationResults": [{"operationId": "cache-write:w:3", "outcome": "failed"}]}
    seen.write_text(json.dumps([one, one | {"id": "run-2", "operationResults": [{"operationId": "gone", "outcome": "failed"}]}]))
    with pytest.raises(violations.Violations, match="unknown operation observed"):
        api.models(spark, table, ["Writer"], str(seen))
    found = api.models(spark, table, ["Writer", "Nobody"], str(seen), strict=False)
    model_ = found.documents.first()
    assert [o.id for o in model_.runtimeObservations] == ["run-1"] and model_.source.file == table
    assert {("no rows", "Nobody"), ("several observations", "Writer"), ("unknown operation observed", "Writer")} <= {(r.rule, r.entity) for r in found.violations.collect()}
    jobs = {j.id: j for j in model_.jobs}
    assert [s["index"] for s in jobs["w"].steps] == [2, 3, 4, 5] and jobs["w"].steps[1].arguments == {"key": "k"} and jobs["w"].steps[2].arguments is None


def test_choices(spark):
    ops = spark.createDataFrame([("a", "x", "cacheWriteIntent"), ("a", "y", "cacheReadIntent"), ("b", "x", "cacheWriteIntent"), ("b", "z", "cacheWriteIntent")], "workflow string, op_id string, op_kind string")
    told = lambda df: {tuple(r) for r in df.collect()}
    assert told(verdicts.cache_choices(ops)) == {("a", 1, "x", "cacheWriteIntent"), ("b", 2, None, None)}
    wanted = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "q")], "workflow string, op_id string")
    named = verdicts.cache_choices(ops, wanted)
    assert told(named) == {("a", 1, "y", "cacheReadIntent"), ("b", 1, "z", "cacheWriteIntent"), ("c", 0, None, None)}
    assert {(r.rule, r.entity) for r in violations.of_cache_choices(named).collect()} == {("no cache write", "a"), ("not one cache write", "c")}
    seen = spark.createDataFrame([("a", "o1", "denied"), ("b", "o2", "allowed"), ("b", "o3", "unknown")], "workflow string, observation string, decision string")
    assert told(verdicts.chosen_observations(seen)) == {("a", 1, "o1", "denied"), ("b", 2, None, None)}
    assert told(verdicts.chosen_observations(seen, spark.createDataFrame([("b", "o3"), ("a", "o9")], "workflow string, observation string"))) == {("b", 1, "o3", "unknown"), ("a", 0, None, None)}
    results = spark.createDataFrame([("a", "x", "failed"), ("b", "x", "failed"), ("b", "x", "unknown")], "workflow string, op_id string, outcome string")
    facts = {(r.workflow, r.op_id): (r.write_authorized, r.write_succeeded) for r in verdicts.runtime_facts(ops.where("op_kind = 'cacheWriteIntent'"), seen, results).collect()}
    assert facts == {("a", "x"): ("false", "false"), ("b", "x"): (None, None), ("b", "z"): (None, "unknown")}


def test_final_taint(spark):
    """Against walking the states one by one, for every assignment."""
    vectors = list(itertools.product(("true", "false"), repeat=11))
    df = spark.createDataFrame(vectors, ", ".join(f"{f} string" for f in verdicts.CHAIN_FACTS)).select("*", verdicts.tainted_at_end().alias("t"), verdicts.final_stage().alias("s"))
    for row in df.toPandas().itertuples(index=False):
        pu, wi, wa, ws, same, rs, uses, present, passed, priv, auth = (x == "true" for x in row[:11])
        restored = pu and wi and wa and ws and same and rs
        assert row.t == (pu and not (restored and present and passed))
        used = restored and uses and (passed if present else True)
        assert row.s == ("authority_reached" if used and priv and auth else "blocked")


def test_stored_table_is_read_by_part(spark, pair, tmp_path):
    readers.store_extraction(pair, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == pair.count() and {r.op_id for r in model.operations(back).collect()} == {r.op_id for r in model.operations(pair).collect()}
    assert "part=workflow" in str(model.events(back).inputFiles()) or model.events(back).count() == 2


@pytest.mark.parametrize(("text", "expected"), [
    (None, None), (" a ", "a"), ("${{ x.y }}", "x.y"), ("\t${{x}}\n", "x"), ("${{ a }} ${{ b }}", "a }} ${{ b"), ("p ${{ a }}", "p ${{ a }}"), ("${{ a\nb }}", "${{ a\nb }}"), ("", ""),
])
def test_normalized_expression(spark, text, expected):
    assert spark.createDataFrame([(text,)], "x string").select(X.normalized_expression(F.col("x"))).first()[0] == expected


# Verdicts against exploring every state

def explore_chain(f):
    """Reaches a tainted authority from the start, whatever the taint's way."""
    if (f["ws"] and not f["wa"]) or (f["rs"] and not f["ws"]) or (f["passed"] and not f["present"]):
        return None
    stage, tainted = "start", f["pu"]
    for _ in range(8):
        if stage == "start":
            nxt = "object_written" if f["pu"] and f["wi"] and f["wa"] and f["ws"] else "blocked"
        elif stage == "object_written":
            nxt = "object_restored" if f["same"] and f["rs"] else "blocked"
        elif stage == "object_restored":
            nxt = "integrity_checked" if f["present"] and f["passed"] else "blocked" if f["present"] else "object_used" if f["uses"] else "blocked"
            tainted = tainted and not (f["present"] and f["passed"])
        elif stage == "integrity_checked":
            nxt = "object_used" if f["uses"] else "blocked"
        elif stage == "object_used":
            nxt = "authority_reached" if f["priv"] and f["auth"] else "blocked"
        else:
            break
        stage = nxt
    return stage == "authority_reached" and tainted


def test_every_chain_verdict(spark):
    keys = ("pu", "wi", "wa", "ws", "same", "rs", "uses", "present", "passed", "priv", "auth")
    known = {v: explore_chain(dict(zip(keys, v, strict=True))) for v in itertools.product((True, False), repeat=11)}
    vectors = list(itertools.product(("true", "false", "unknown"), repeat=11))
    df = spark.createDataFrame(vectors, ", ".join(f"{f} string" for f in verdicts.CHAIN_FACTS))
    got = df.select(*verdicts.CHAIN_FACTS, verdicts.chain_unsafe().alias("u"), verdicts.chain_consistent().alias("c"), verdicts.chain_always_unsafe().alias("a")).toPandas()
    assert len(got) == 3**11
    # Merge the values of the unknowns one fact at a time: (some state is unsafe, some state exists, some state is safe).
    table = {tuple("true" if x else "false" for x in v): (r is True, r is not None, r is False) for v, r in known.items()}
    for i in range(11):
        for v in list(table):
            if v[i] == "true":
                t, f = table[v], table[(*v[:i], "false", *v[i + 1 :])]
                table[(*v[:i], "unknown", *v[i + 1 :])] = tuple(x or y for x, y in zip(t, f, strict=True))
    for row in got.itertuples(index=False):
        some, exists, safe = table[tuple(row[:11])]
        # A vector without any legal state holds vacuously.
        assert (row.u and row.c) == some and row.c == exists and row.a == (some and not safe)


def test_every_cache_verdict(spark):
    def explore(wi, wa, ws, same, uses, verified, priv, auth):
        if ws and not (wi and wa):
            return None
        return wi and wa and ws and same and uses and not verified and priv and auth

    table = {tuple("true" if x else "false" for x in v): ((r := explore(*v)) is True, r is False) for v in itertools.product((True, False), repeat=8)}
    for i in range(8):
        for v in list(table):
            if v[i] == "true":
                other = table[(*v[:i], "false", *v[i + 1 :])]
                table[(*v[:i], "unknown", *v[i + 1 :])] = tuple(x or y for x, y in zip(table[v], other, strict=True))
    df = spark.createDataFrame(list(table), ", ".join(f"{f} string" for f in verdicts.CACHE_FACTS))
    for row in df.select("*", verdicts.cache_unsafe().alias("u"), verdicts.cache_class().alias("k")).toPandas().itertuples(index=False):
        some, safe = table[tuple(row[:8])]
        assert row.u == some and row.k == ("blocked" if not some else "incomplete" if safe else "unsafe")


@pytest.mark.parametrize(("changed", "verdict", "stage"), [
    ({}, "unsafe", "authority_reached"), ({"integrityCheckPresent": "true"}, "safe", "blocked"), ({"consumerUsesObject": "false"}, "safe", "blocked"),
    ({"hasAuthority": "false"}, "safe", "blocked"), ({"integrityCheckPresent": "true", "integrityCheckPassed": "true"}, "safe", "authority_reached"),
])
def test_published_scenarios(spark, changed, verdict, stage):
    facts = {f: "false" if f.startswith("integrity") else "true" for f in verdicts.CHAIN_FACTS} | changed
    got = spark.range(1).select(*[F.lit(facts[f]).alias(f) for f in verdicts.CHAIN_FACTS]).select(verdicts.chain_class(), verdicts.final_stage()).first()
    assert tuple(got) == (verdict, stage)


# Evaluation, traces, identity, readers

OUTPUT = "*** x\n-- specification AG !(a)  is false\n-> State: 1.1 <-\n  stage = start\n-> State: 1.2 <-\n  stage = start\r\n  stage = object_written\n stage = blocked\n  stage = start\n  stage = Bad\n"


def test_outputs_are_read(spark):
    rows_ = [("a", OUTPUT), ("b", "-- specification AG !(a)  is true\n"), ("c", "-- specification AG stage != x is false"), ("d", "-- specification AG !(a) is odd\n-- specification AG !(a) is true")]
    df = spark.createDataFrame(rows_, "id string, output string")
    assert [r[0] for r in df.orderBy("id").select(evaluation.verdict(F.col("output"))).collect()] == ["unsafe", "safe", None, None]
    assert [tuple(r) for r in evaluation.stage_trace(df, "id", "output").orderBy("ord").collect()] == [("a", 1, "start"), ("a", 2, "object_written"), ("a", 3, "blocked"), ("a", 4, "start")]
    assert df.where("id = 'a'").select(evaluation.stage_array(F.col("output"))).first()[0] == ["start", "object_written", "blocked", "start"]
    place = lambda s, n: F.struct(F.lit(s).alias("stage"), *[F.lit(v).alias(k) for k, v in (("file", "f"), ("workflow", "w"), ("job_id", "j"), ("step_index", n), ("meaning", "m"))])
    document = df.where("id = 'a'").select(evaluation.markdown(F.col("id"), F.col("output"), F.array(place("start", "1"), place("object_written", "2")))).first()[0]
    assert [line.split(" | ")[0] for line in document.splitlines() if "`" in line] == ["| 1", "| 2", "| 4"]


def test_summary(spark):
    cases = spark.createDataFrame([("unsafe", "unsafe"), ("unsafe", "safe"), ("safe", "safe"), ("safe", "unsafe")], "expected string, actual string")
    assert tuple(evaluation.summary(cases).first()) == (4, 2, 0.5, 1, 1, 1, 1)
    assert evaluation.summary(cases.where("1 = 0")).first().accuracy is None


def test_payload_digest(spark):
    assert spark.range(1).select(identity.payload_digest(F.lit("publish=false"))).first()[0] == hashlib.sha256(b"publish=false\n").hexdigest()


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('filePath,line,workflowName,jobId,stepIndex,kind,name,detail\na.yml,1,W,j,0,run-step,,"echo ""x""\nmore"\na.yml,2,W,-,-,workflow,W,-\n')
    got = readers.read_extraction(spark, str(path)).orderBy("row_seq").collect()
    assert got[0].detail == 'echo "x"\nmore' and got[0].name == "" and got[1].kind == "workflow"
