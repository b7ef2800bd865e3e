import json

import pytest

from assaykit import cli
from assaykit.operators import adjudication, scoring

REPORT = "<center><b>CT OF THE HEAD</b></center><br><br><b>Findings</b><br>Acute subdural hematoma on the left.<br><br><b>Impression</b><br>Acute left subdural hematoma of the convexity."


@pytest.fixture
def files(tmp_path):
    cases = [{"id": f"c{k}", "exam": "CT of the head", "findings": "acute subdural hematoma on the left", "locale": "en-US", "goldFindings": [{"finding": "Acute subdural hematoma", "severity": "critical", "laterality": "left"}]} for k in range(2)]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    given = [{"instance_id": "c0", "model_output": REPORT}, {"instance_id": "c1", "model_output": REPORT.replace("Acute subdural hematoma on the left", "No subdural hematoma").replace("Acute left subdural hematoma of the convexity", "Normal head without subdural hematoma")}]
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, given)))
    (tmp_path / "short.jsonl").write_text(json.dumps(given[0]))
    check = lambda ok: [{"dim": "CRIT", "id": "CG01", "name": "recall", "severity": "critical", "passed": ok, "evidence": "x"}]
    for folder, names in (("runs", "abc"), ("a", "a"), ("b", "b")):
        (tmp_path / folder).mkdir()
        for n in names:
            results = [{"case": {"id": f"c{k}"}, "checks": check(k > 0 or n != "b"), "combinedOverall": 80.0 + k - (n == "b"), "verdict": "PASS" if k or n != "b" else "FAIL"} for k in range(5)]
            run = {"manifest": {"runName": n, "comparableKey": "k", "judgeModel": "j", "validation": {"valid": n != "c"}}, "summary": {"averageOverall": 82.0 - (n == "b"), "passRate": 90.0}, "results": results}
            (tmp_path / folder / f"{n}.json").write_text(json.dumps(run))
    (tmp_path / "suites").mkdir()
    (tmp_path / "suites" / "s.json").write_text(json.dumps({"benchmarkName": "x", "id": "s", "label": "S"}))
    (tmp_path / "release").mkdir()
    (tmp_path / "release" / "x.csv").write_text("a,b")
    label = lambda who: {"reviewer": who, "acceptable": True, "verdicts": {d: "PASS" for d in scoring.DIMS}, "notes": "", "signed_at": "2025-01-02T03:04:05Z"}
    record = {"schema_version": "1.0", "suite_id": "s", "suite_hash": "h", "locked_at": "2025-01-02T03:04:05Z", "case_ids": ["a"], "adjudicators": ["x", "y"], "cases": [{"case_id": "a", "reviewed": {f: True for f in adjudication.REVIEWED}, "labels": [label("x"), label("y")]}]}
    (tmp_path / "record.json").write_text(json.dumps(record))
    return tmp_path


def run(spark, files, *argv):
    out = files / f"out-{argv[0]}"
    code = cli.main(["--out", str(out), *argv], spark)
    return code, [json.loads(line) for p in sorted(out.glob("part-*")) for line in p.read_text().splitlines()]


def test_commands_on_submissions(spark, files):
    cases = str(files / "cases.json")
    assert run(spark, files, "validate-submission", cases, str(files / "good.jsonl"))[0] == 0
    code, rows = run(spark, files, "validate-submission", cases, str(files / "short.jsonl"))
    assert code == 1 and rows[0]["missing"] == 1
    with pytest.raises(SystemExit):
        run(spark, files, "eval-submission", cases, str(files / "short.jsonl"))
    _, rows = run(spark, files, "eval-submission", cases, str(files / "good.jsonl"))
    by = {r["case_id"]: r for r in rows}
    assert by["c1"]["verdict"] == "FAIL" and by["c0"]["overall"] > by["c1"]["overall"]
    _, rows = run(spark, files, "perturb-matrix", cases, "--kinds", "laterality_flip", "critical_invent")
    assert {(r["case_id"], r["kind"]) for r in rows} == {(c, k) for c in ("c0", "c1") for k in ("laterality_flip", "critical_invent")}


def test_commands_on_runs(spark, files):
    _, rows = run(spark, files, "leaderboard", str(files / "runs"), "--unverified")
    assert {r["run"]: r.get("rank") for r in rows} == {"a": 1, "b": 2, "c": None}
    _, rows = run(spark, files, "compare", str(files / "a"), str(files / "b"), "--unverified")
    assert len(rows) == 5 and all(r["delta"] == 1.0 for r in rows)
    _, rows = run(spark, files, "discriminate", str(files / "a"), str(files / "b"), "--resamples", "200", "--unverified")
    assert rows[0]["mean_diff"] == 1.0 and rows[0]["n"] == 5
    _, rows = run(spark, files, "bootstrap", str(files / "a"), "--resamples", "200", "--unverified")
    assert rows[0]["mean"] == 82.0 and rows[0]["lower"] <= 82 <= rows[0]["upper"]
    _, rows = run(spark, files, "reliability", str(files / "runs"), "3", "--unverified")
    assert rows[0]["case_count"] == 5 and rows[0]["pass_power_k_safe"] == 0.8
    _, rows = run(spark, files, "report", str(files / "runs"), "--unverified")
    assert [r["value"] for r in rows][-1] == "| b | critical_finding | 1 | 1 |"
    _, rows = run(spark, files, "calibrate", str(files / "runs"), "--unverified")
    assert rows[0]["case_count"] == 5 and rows[0]["judges"] == ["judge:j"]


def test_commands_on_files(spark, files):
    assert run(spark, files, "suites", str(files / "suites"))[1][0]["id"] == "s"
    assert run(spark, files, "adjudication", str(files / "record.json"))[0] == 0
    assert run(spark, files, "adjudication", str(files / "record.json"), "--suite-hash", "other")[0] == 1
    code, rows = run(spark, files, "release-guard", str(files / "release"), "--mode", "public")
    assert code == 1 and {r["rule"] for r in rows} == {"raw-data-extension"}
    assert len(run(spark, files, "provenance", str(files / "release"))[1]) == 2
    # Outputs are searched, not the artifacts, which name their own token.
    rows = run(spark, files, "contamination", str(files / "runs"), "--token", "Run Name", "--unverified")[1]
    assert [(r["run"], r["verdict"]) for r in rows] == [("a", "clean"), ("b", "clean"), ("c", "clean")]
