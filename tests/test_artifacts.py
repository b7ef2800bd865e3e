"""Run artifacts, their verification, hashes, reports, and the files of a repository."""

import hashlib
import json
import os
import random
import subprocess

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from assaykit import cli
from assaykit.operators import evaluators, integrity, pairing, provenance, release, reporting, robustness, scoring, submission, summary
from assaykit.sources import artifacts, tracked


def manifest(**more):
    names = {"benchmarkVersion": F.lit("1"), "runName": F.col("run"), "suiteId": F.lit("s"), "suiteHash": F.lit("h"), "locale": F.lit("en-US"), "track": F.lit("model"), "provider": F.lit("p"), "modelLabel": F.col("run"), "submissionMode": F.lit("predictions"), "canaryToken": F.lit("CANARY-1")}
    names |= {c: F.lit(None).cast("string") for c in ("comparisonClass", "scaffoldId", "judgeProvider", "judgeModel", "scoreMode", "policyId")} | {"judgeTemperature": F.lit(None).cast("double"), "judgeMaxTokens": F.lit(None).cast("int")}
    return F.struct(*(x.alias(c) for c, x in (names | more).items()))


@pytest.fixture(scope="module")
def made(spark):
    """Three runs of twelve cases, as dicts: `a` passes all, `b` fails a critical check of c3, `c` misses a minor one in every case."""
    rows = []
    for run in "abc":
        for k in range(12):
            for i, d in enumerate(("CRIT", "QUAL", "TERM")):
                for j in range(4):
                    failed = run == "b" and k == 3 and d == "CRIT" and j == 0 or run == "c" and d == "TERM" and j == k % 4
                    rows.append((run, f"c{k:02}", d, f"{d[0]}{i}{j}", "x", "critical" if d == "CRIT" else "minor", not failed, "seen"))
    checks = spark.createDataFrame(rows, "run string, case_id string, dim string, id string, name string, severity string, passed boolean, evidence string")
    counts = scoring.case_counts(checks, scoring.KEYS, F.lit(20.0).alias("latency_ms"), F.lit(0.5).alias("cost_usd"))
    results = scoring.combine(scoring.score_dimensions(counts)).withColumn("difficulty", F.when(F.col("case_id") < "c06", "easy").otherwise("hard"))
    listed = checks.groupBy("run", "case_id").agg(F.array_sort(F.collect_list(F.struct("dim", "id", "name", "severity", "passed", "evidence"))).alias("checks"))
    found = integrity.artifacts(results.join(listed, ["run", "case_id"]), manifest()).collect()
    return {r.run: {k: v for k, v in r.asDict(True).items() if k != "run"} for r in found}


def put(folder, runs):
    folder.mkdir(exist_ok=True)
    drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
    for name, r in runs.items():
        (folder / f"{name}.json").write_text(json.dumps(drop(r)))
    return str(folder)


def copy(runs):
    return json.loads(json.dumps(runs))


def test_honest_runs_are_read(spark, made, tmp_path):
    seen = Observation("read")
    rows = artifacts.read_suite_runs(spark, put(tmp_path / "runs", made), observation=seen)
    got = {r.manifest.runName: r for r in rows.collect()}
    assert seen.get == {"runs": 3, "cases": 36, "mismatches": 0}
    assert [len(got[x].results) for x in "abc"] == [12, 12, 12] and [c.case.id for c in got["a"].results] == [f"c{k:02}" for k in range(12)]
    assert got["b"].results[3].verdict == "FAIL" and got["a"].summary.averageOverall == 100.0 and got["c"].summary.allPassRate == 0.0
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan json") == 1  # one pass


def test_forged_runs_stop_the_read(spark, made, tmp_path):
    def flip(r):
        r["results"][3]["verdict"] = "PASS"
        r["results"][3]["combinedOverall"] = 90.0
        r["results"][5]["allPass"] = False
        r["results"][6]["costUsd"] = -3.0
        r["summary"]["passRate"] = 100.0

    judge = {"verdict": "FAIL", "scores": {}, "overall": None, "critical_failures": [{"issue": "x"}], "missing": [], "hallucinated": []}
    changes = {
        "flip": flip, "twice": lambda r: r["results"][1]["case"].update(id="c00"), "short": lambda r: r["results"].pop(), "nameless": lambda r: r["results"][0]["case"].pop("id"), "mode": lambda r: r["manifest"].update(scoreMode="judge-primary"),
        "dims": lambda r: r["results"][2]["detDims"].pop("RAG"), "none": lambda r: r.update(results=[]), "absent": lambda r: r["summary"]["averagePerDim"].update(GUIDE=50.0), "counts": lambda r: r["summary"]["verdictCounts"].update(PASS=12),
        "summary": lambda r: r.pop("summary"), "veto": lambda r: r["results"][0].update(judge=judge), "honest": lambda r: None,
    }
    runs = {name: copy(made["b"]) for name in changes}
    for name, change in changes.items():
        change(runs[name])
    read = lambda folder: spark.read.json(folder, schema=artifacts.RUN, multiLine=True).withColumn("source", F.col("_metadata.file_name"))
    found = {x.source.removesuffix(".json"): x.errors for x in integrity.audited(read(put(tmp_path / "all", runs))).select("source", "errors").collect()}
    said = {k: "; ".join(v) for k, v in found.items()}
    assert found["honest"] == [] and found["summary"] == ["missing summary"]
    for part in ("case c03 verdict mismatch: expected FAIL, got PASS", "case c03 combinedOverall mismatch: expected 59.9, got 90", "case c03 verdict must be FAIL", "case c05 allPass mismatch: expected true, got false", "case c06 has negative cost", "summary.passRate mismatch: expected 91.7, got 100", "summary.averageOverall mismatch", "summary.totalCostUsd mismatch: expected 2.5, got 6"):
        assert part in said["flip"], (part, said["flip"])
    assert said["flip"].index("case c03") < said["flip"].index("case c05") < said["flip"].index("summary.")
    assert "valid run has duplicate case ids" in said["twice"] and "expected 12 unique ids, got 11" in said["short"] and "a result row with no case id" in said["nameless"]
    assert "comparableKey mismatch: expected 1::s::en-US::model::model::none::none::none::judge-primary, got 1::s::en-US::model::model::none::none::none::conservative-min" in said["mode"]
    assert "case c02: missing deterministic dimension summaries" in said["dims"] and "run has no case results" in said["none"] and "summary.averagePerDim.GUIDE should be absent" in said["absent"]
    assert "summary.verdictCounts.PASS mismatch: expected 11, got 12" in said["counts"] and "case c00 verdict must be FAIL" in said["veto"]
    with pytest.raises(Exception, match="integrity check failed") as e:
        artifacts.read_suite_runs(spark, put(tmp_path / "one", {"flip": runs["flip"]})).select("source").collect()
    assert said["flip"] in str(e.value)  # all mismatches in one error
    loose = integrity.audited(read(put(tmp_path / "empty", {"none": runs["none"]})), require_results=False).first().errors
    assert not any("no case results" in x for x in loose) and any("id-set" in x for x in loose)


def test_judged_runs(spark, made, tmp_path):
    """A run whose judge's scores count, in both modes."""
    runs = copy(made)
    for mode in ("conservative-min", "judge-primary"):
        r = copy(runs["c"])
        for c in r["results"]:
            c["judge"] = {"verdict": "PASS", "scores": {"TERM": 90.0}, "overall": 90.0, "critical_failures": [], "missing": [], "hallucinated": []}
            c["combined"]["TERM"] = 90.0 if mode == "judge-primary" else 75.0
        r["manifest"] |= {"scoreMode": mode, "judgeProvider": "q", "judgeModel": "j", "comparableKey": f"1::s::en-US::model::model::none::q::j::{mode}"}
        r["summary"]["averagePerDim"]["TERM"] = r["results"][0]["combined"]["TERM"]
        # TERM fails by its own share of 75, so its gate holds the overall under the mark in either mode.
        assert {(c["combinedOverall"], c["verdict"]) for c in r["results"]} == {(83.9, "PARTIAL")}
        read = lambda: integrity.audited(spark.read.json(put(tmp_path / mode, {"c": r}), schema=artifacts.RUN, multiLine=True)).first().errors  # noqa: B023, E731
        assert read() == []
        for c in r["results"]:
            c["judge"]["scores"] = {"CRIT": 70.0}
        assert {x.split(" mismatch")[1] for x in read() if "combinedOverall" in x} == {": expected 81.3, got 83.9"}


# ---- Commands on honest runs


def run(spark, tmp_path, *argv):
    out = tmp_path / f"out-{len(list(tmp_path.iterdir()))}"
    code = cli.main(["--out", str(out), *argv], spark)
    return code, [json.loads(line) for p in sorted(out.glob("part-*")) for line in p.read_text().splitlines()]


def test_commands_verify_runs(spark, made, tmp_path):
    folder = put(tmp_path / "runs", made)
    _, rows = run(spark, tmp_path, "leaderboard", folder)
    assert [(r["run"], r["rank"]) for r in rows] == [("a", 1), ("b", 2), ("c", 3)] and rows[0]["total_cost_usd"] == 6.0 and rows[1]["all_pass_rate"] == 91.7
    bad = copy(made)
    bad["a"]["results"][0]["verdict"] = "FAIL"
    with pytest.raises(Exception, match="case c00 verdict mismatch"):
        run(spark, tmp_path, "leaderboard", put(tmp_path / "bad", bad))


def test_calibrate_compares_checks_and_judge(spark, made, tmp_path):
    runs = copy(made)
    for name in "ac":
        for k, c in enumerate(runs[name]["results"]):
            c["judge"] = {"verdict": "PASS", "scores": {}, "overall": 50.0 + 2 * k, "critical_failures": [], "missing": [], "hallucinated": []}
            c["detOverall"] = 60.0 + 3 * k
    _, rows = run(spark, tmp_path, "calibrate", put(tmp_path / "runs", runs), "--unverified")
    assert rows[0]["spearman"] == 1.0 and rows[0]["n"] == 24
    for c in runs["c"]["results"]:
        c["judge"]["overall"] = 100 - c["judge"]["overall"]
    _, rows = run(spark, tmp_path, "calibrate", put(tmp_path / "other", runs), "--unverified")
    assert rows[0]["spearman"] < 0.5 and rows[0]["verdict"] == "uncalibrated"


def test_contamination_of_each_run(spark, made, tmp_path):
    runs = copy(made)
    runs["a"]["results"][2]["rawHtml"] = "text C a​nary\n-１ text"
    runs["b"]["results"][1]["judge"] = {"verdict": "FAIL", "critical_failures": [{"issue": "Contamination-suspect"}]}
    _, rows = run(spark, tmp_path, "contamination", put(tmp_path / "runs", runs), "--unverified")
    assert [(r["run"], r["verdict"], r["canary_hits"], r["judge_flagged"], r["suspicious"]) for r in rows] == [("a", "contaminated", 1, 0, ["c02"]), ("b", "suspicious", 0, 1, ["c01"]), ("c", "clean", 0, 0, [])]
    _, rows = run(spark, tmp_path, "contamination", put(tmp_path / "runs", runs), "--token", "elsewhere", "--unverified")
    assert [r["verdict"] for r in rows] == ["clean", "suspicious", "clean"]


def test_reliability_heeds_the_judge(spark, made, tmp_path):
    folder = put(tmp_path / "runs", made)
    assert run(spark, tmp_path, "reliability", folder, "3")[1][0]["pass_power_k_safe"] == 0.9167
    runs = copy(made)
    runs["a"]["results"][0]["judge"] = {"verdict": "FAIL", "critical_failures": [{"issue": "missed"}]}
    folder = put(tmp_path / "judged", runs)
    assert run(spark, tmp_path, "reliability", folder, "3", "--unverified")[1][0]["pass_power_k_safe"] == 0.8333
    lines = [r["value"] for r in run(spark, tmp_path, "reliability", folder, "3", "--unverified", "--markdown")[1]]
    assert lines[0] == "# Reliability (pass^3)" and "| **Critical-safe pass^3** (headline) | 83.3% |" in lines and lines[-1] == "Flaky (critical-safe in some but not all runs): c00, c03"


def test_whole_report(spark, made, tmp_path):
    folder, base = put(tmp_path / "runs", made), put(tmp_path / "base", {"c": made["c"]})
    (tmp_path / "record.json").write_text(json.dumps({"scoringHash": "abc", "suites": [{"suiteId": "s", "suiteHash": "listed"}]}))
    lines = [r["value"] for r in run(spark, tmp_path, "report", folder, "--kind", "whole", "--baseline", base, "--provenance", str(tmp_path / "record.json"), "--resamples", "200")[1]]
    assert lines[0] == "# Consolidated Report: a" and "| Mean overall | 100.00% |" in lines and "| n cases | 12 |" in lines and "| CRIT | 100.00% |" in lines
    assert "- **Verdict:** CLEAN" in lines and "## Discrimination vs baseline (c)" in lines and "- **Verdict:** DISCRIMINATES" in lines
    text = {"benchmarkVersion": "1", "judgeMaxTokens": None, "judgeModel": None, "judgeProvider": None, "judgeTemperature": None, "locale": "en-US", "modelLabel": "a", "policyId": None, "provider": "p", "scaffoldId": None, "scoreMode": "conservative-min", "submissionMode": "predictions", "suiteId": "s", "track": "model"}
    want = hashlib.sha256(f"listed|{json.dumps(text, sort_keys=True, separators=(',', ':'))}|abc".encode()).hexdigest()
    assert f"- Run hash: `{want}`" in lines and "- Suite hash: `listed`" in lines
    other = provenance.run_hashes(artifacts.read_runs(spark, base), "abc", spark.createDataFrame([("t", "x")], "suiteId string, suiteHash string")).first()
    assert other.suiteHash == "h"  # the run's own, where the record doesn't list its suite


# ---- Hashes


def brute_tree(own, depth):
    nodes = {hashlib.sha256(n.encode()).hexdigest(): hashlib.sha256((n + "\n" + ("-" if c is None else "=" + hashlib.sha256(c.encode()).hexdigest())).encode()).hexdigest() for n, c in own}
    out = {}
    for level in range(depth, -1, -1):
        up = {}
        for at in sorted(nodes):
            up.setdefault(at[: 2 * level], []).append(nodes[at])
        nodes = {p: hashlib.sha256("".join(hs).encode()).hexdigest() for p, hs in up.items()} or {"": hashlib.sha256(b"").hexdigest()}
        out |= {(level, p): h for p, h in nodes.items()}
    return out


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_tree_equals_brute_force(spark, depth):
    r = random.Random(depth)
    own = [(f"f{k}", r.choice([None, "", "x" * k])) for k in range(400)]
    files = spark.createDataFrame(own, "path string, content string").repartition(3)
    assert {(x.level, x.prefix): x.hash for x in provenance.tree(provenance.leaves(files), depth).collect()} == brute_tree(own, depth)
    after = [*((n, "new" if k == 7 else c) for k, (n, c) in enumerate(own) if k != 9), ("more", "m")]
    got = provenance.changed(provenance.leaves(files), provenance.leaves(spark.createDataFrame(after, "path string, content string")))
    assert {tuple(x) for x in got.collect()} == {("f7", "changed"), ("f9", "removed"), ("more", "added")}
    none = provenance.root(provenance.leaves(files.limit(0))).first()
    assert none.n == 0 and none.hash == hashlib.sha256(b"").hexdigest()


def test_depths():
    assert [provenance.depth_for(n) for n in (0, 1, 256, 257, 65_536, 65_537, 1 << 30)] == [0, 0, 0, 1, 1, 2, 3]


def test_hashes_of_cases_code_and_runs(spark, made, tmp_path):
    cases = [{"id": "a", "exam": 'é "x"', "findings": "f\n1", "locale": "en-US", "label": "not hashed", "goldFindings": [{"severity": "minor", "finding": "z", "negated": False}], "patientContext": {"sex": "f", "age": 3}}, {"id": "b", "exam": "", "findings": "", "difficulty": "easy", "retrievalGold": [{"relevance": 2, "documentId": "d"}]}]
    (tmp_path / "s.json").write_text(json.dumps(cases, ensure_ascii=False))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    hashes = sorted(sha(dump({k: c.get(k) for k in provenance.CASE_FIELDS})) for c in cases)
    rows = artifacts.read_case_objects(spark, str(tmp_path / "s.json")).withColumns({"suiteId": F.lit("s"), "locale": F.lit("x")})
    suite = provenance.suite_hashes(rows).first()
    assert suite.suiteHash == sha(dump(hashes)) and suite.caseCount == 2
    (tmp_path / "code").mkdir()
    for n in ("b.ts", "a.ts", "other.ts"):
        (tmp_path / "code" / n).write_text(f"code of {n}")
    code = sha(dump([{"path": n, "sha256": sha(f"code of {n}")} for n in ("a.ts", "b.ts")]))
    folder = put(tmp_path / "runs", {"a": made["a"]})
    _, rows = run(spark, tmp_path, "provenance", str(tmp_path / "code"), "--cases", str(tmp_path / "s.json"), "--scoring", "b.ts", "a.ts", "--runs", folder)
    by = {(r["kind"], r["name"]): r["hash"] for r in rows}
    assert by["scoring", "*"] == code and len([k for k in by if k[0] == "file"]) == 3 and ("root", "*") in by and by["suite", "s en-US"] != by["suite", "s "]
    assert len(by["run", "a"]) == 64
    with pytest.raises(Exception, match="missing scoring files: gone.ts"):
        provenance.scoring_hash(spark.createDataFrame([("a.ts", "x")], "path string, content string"), ["a.ts", "gone.ts"]).collect()
    record = provenance.manifest(artifacts.read_case_objects(spark, str(tmp_path / "s.json")).withColumns({"suiteId": F.lit("s"), "locale": F.lit("x")}), tracked.tracked_files(spark, str(tmp_path / "code")), ["a.ts"], "2").first()
    assert record.benchmarkVersion == "2" and record.suites[0].suiteHash == suite.suiteHash and [f.path for f in record.scoringFiles] == ["a.ts"]
    zero = copy(made["a"])
    zero["manifest"] |= {"judgeTemperature": 0.0, "judgeMaxTokens": 900}
    one = provenance.run_hashes(spark.read.json(put(tmp_path / "z", {"a": zero}), schema=artifacts.RUN, multiLine=True), "k").first().runHash
    text = {"benchmarkVersion": "1", "judgeMaxTokens": 900, "judgeModel": None, "judgeProvider": None, "judgeTemperature": 0, "locale": "en-US", "modelLabel": "a", "policyId": None, "provider": "p", "scaffoldId": None, "scoreMode": "conservative-min", "submissionMode": "predictions", "suiteId": "s", "track": "model"}
    assert one == sha(f"h|{dump(text)}|k")


# ---- Files of a repository


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    to = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", *a], cwd=to, check=True, capture_output=True)
    git("init")
    (to / "cases" / "private").mkdir(parents=True)
    for name, text in (("a.txt", "alpha"), ("cases/private/b.md", "béta"), ("cases/big.csv", "x" * 3000), ("pic.PNG", "p"), ("gone.txt", "g"), ("untracked.csv", "1,2")):
        (to / name).write_text(text)
    (to / "bad.txt").write_bytes(b"a\xffb")
    os.symlink("a.txt", to / "link")
    git("add", "a.txt", "cases", "pic.PNG", "gone.txt", "link", "bad.txt")
    (to / "gone.txt").unlink()
    return to, git


@pytest.mark.parametrize("version", ["2", "3", "4"])
def test_tracked_files(spark, repository, version):
    to, git = repository
    git("update-index", "--index-version", version)
    got = {x.path: x.content for x in tracked.tracked_files(spark, str(to), most=2000).collect()}
    assert got == {"a.txt": "alpha", "cases/private/b.md": "béta", "cases/big.csv": None, "pic.PNG": None, "gone.txt": None, "link": None, "bad.txt": "a�b"}
    found = release.issues(tracked.tracked_files(spark, str(to)), "private")
    assert {(x.path, x.rule) for x in found.collect()} == {("cases/big.csv", "raw-data-extension"), ("cases/private/b.md", "private-path-tracked")}  # untracked.csv isn't there


def test_sizes_are_pruned_before_files_are_opened(spark, repository, monkeypatch):
    from pyspark.sql.datasource import EqualTo, LessThan, StringStartsWith

    to, _ = repository
    reader = tracked.Reader(str(to), 2000)
    left = list(reader.pushFilters([LessThan(("size",), 100), StringStartsWith(("path",), "cases/"), EqualTo(("content",), "x")]))
    assert [type(f) for f in left] == [EqualTo] and [e.path for p in reader.partitions() for e in p.own] == ["cases/private/b.md"]
    assert [x.path for x in tracked.tracked_files(spark, str(to)).where("size < 100 and path like 'cases/%' and content <> 'y'").collect()] == ["cases/private/b.md"]
    monkeypatch.setattr(tracked, "FILES", 2)
    assert [len(p.own) for p in tracked.Reader(str(to), 2000).partitions()] == [2, 2, 2, 1]


def test_folders_without_a_repository(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "sub/b.txt", "runs/c.txt"):
        (tmp_path / name).write_text(name)
    assert {x.path for x in tracked.tracked_files(spark, str(tmp_path)).collect()} == {"a.txt", "sub/b.txt"}
    with pytest.raises(ValueError, match="not an index"):
        list(tracked.read_index(b"XXXX" + bytes(20)))


# ---- Locales, reports


def test_no_row_of_another_locale_is_lost(spark):
    rows = [("1", "en-US", "CT of the head", "x"), ("2", None, "CT of the head", "x")]
    cases = spark.createDataFrame([*rows, ("3", "de-DE", "CT", "x")], "case_id string, locale string, exam string, html string").withColumn("findings", F.lit("a mass"))
    good = cases.where("case_id <> '3'")
    assert evaluators.quality(good).count() == 2 and submission.checked(good).count() == 2
    assert {x.case_id for x in robustness.matrix(good.withColumn("reference", F.lit("No mass on the left."))).collect()} == {"1", "2"}
    for step in (evaluators.quality, submission.checked, robustness.matrix):
        with pytest.raises(Exception, match="no words for the locale de-DE"):
            step(cases).collect()


def test_groups_come_in_locale_order(spark):
    names = ["b", "A", "a", "B", "Z", "ä", "z"]
    rows = spark.createDataFrame([(n, 1) for n in names], "comparable_key string, position int")
    assert [x.comparable_key for x in summary.in_groups(rows).collect()] == ["a", "A", "ä", "b", "B", "z", "Z"]


def test_report_tables(spark):
    rows = [("x", "s1", "CRIT", f"c{k}", "system_error", 4.0) for k in range(3)] + [("y", "s2", "QUAL", "c1", "review_needed", 1.0)]
    cube = reporting.audit_cube(spark.createDataFrame(rows, "run string, stratum string, dim string, case_id string, adjudication string, weight double"))
    got = {(x.part, x.run, x.stratum, x.dim): (x.failed_checks, x.system_weight, x.raw_weight) for x in cube.collect()}
    assert got["", None, None, None] == (4, 12.0, 13.0) and got["run,stratum", "x", "s1", None] == (3, 12.0, 12.0) and got["dim", None, None, "QUAL"] == (1, 0.0, 1.0) and len(got) == 11
    per_case = spark.createDataFrame([("c1", 2, 2, 2), ("c2", 2, 2, 1)], "case_id string, runs long, safe_runs long, passed_runs long")
    lines = [x.value for x in reporting.reliability_lines(per_case, 2).collect()]
    assert lines[-1].startswith("No flaky") and "| Verdict pass@1 | 75.0% |" in lines
    issues = spark.createDataFrame([("c1", "a", "s1", "system_error", 2.0), ("c1", "b", "s1", "system_error", 4.0), ("c2", "b", "s|2", "system_error", 4.0)], "case_id string, side string, stratum string, adjudication string, weight double")
    lines = [x.value for x in reporting.comparison_lines(pairing.strata_comparison(pairing.strata_by_case(issues)), "one", "two").collect()]
    assert lines[-2:] == ["| s/2 | 0 | 1 | 0 | 1 | 0 | 4.0 |", "| s1 | 1 | 1 | 0 | 0 | 1 | 2.0 |"]
    tex = [x.value for x in reporting.summary_tex(spark.createDataFrame([("a_b & c", 90.0, 1.0, 2.0, 3.0, 4.0), ("z", 95.0, 1.0, 2.0, 3.0, 4.0)], "run string, average_overall double, all_pass_rate double, criterion_pass_rate double, strict_pass_rate double, pass_rate double")).collect()]
    assert tex[4].startswith("z & 95.0") and tex[5].startswith(r"a\_b \& c & 90.0")
    board = spark.createDataFrame([("en-US", "s", "h", 5, "model", None, 2, "m2"), ("en-US", "s", "h", 5, "agent", "judge-primary", 1, "m1")], "locale string, suite_id string, suite_hash string, cases long, track string, score_mode string, position int, label string")
    site = reporting.site_data(board).first()
    assert [e.label for e in site.entries] == ["m1", "m2"] and site.scoring == "judge-primary" and site.track == "agent"


@pytest.mark.parametrize("most", [0, 1000])
def test_passages_equal_brute_force(spark, most):
    from assaykit.operators import contamination

    r = random.Random(most)
    word = lambda: "".join(r.choice("abé漢1") for _ in range(r.randint(1, 6)))
    texts = [(k % 40 if k % 41 else None, "".join(word() for _ in range(r.randint(0, 40)))) for k in range(60)] + [(7, None), (8, ""), (9, "a" * 500), (9, "a" * 500)]
    items = [(k, (t or "x")[i : i + r.choice([1, 2, 7, 8, 9, 15, 16, 17, 30, 200])]) for k, (_, t) in enumerate(texts) for i in (0, 3)] + [(900, "a" * 300), (901, "a" * 501), (902, None), (903, "a" * 300), (904, "never there at all")]
    got = contamination.passages_in(spark.createDataFrame(texts, "doc_id long, c string").repartition(3), spark.createDataFrame(items, "item_id int, c string"), most)
    want = sorted(((d, i) for d, t in texts if t for i, c in items if c and c in t), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and got.schema["item_id"].dataType.simpleString() == "int"


# ---- The greedy step and its scores against loops


def brute_greedy(rated):
    used, out = [], []
    for x in rated:
        free = [(i, c) for i, c in enumerate(x["candidates"]) if i not in used]
        same = max((c["alike"], -i) for i, c in free) if free else (0, 0)
        agreeing = [(c["total"], -i) for i, c in free if c["agrees"]]
        reach, at = max(agreeing) if agreeing else (0, 0)
        at, reach = (-at, reach) if reach > 0 else (None, 0.0)
        if x["literal"]:
            kind, taken = ("exact", -same[1] if same[0] > 0 else None) if x["agrees"] else ("missed", None)
        else:
            kind = "exact" if reach >= 0.7 else "partial" if reach >= 0.4 or x["ratio"] >= 0.55 and x["loose"] else "missed"
            taken = at if reach >= 0.4 else None
        used += [taken] if taken is not None else []
        partial = reach if reach >= 0.4 else max(0.55, min(0.78, x["ratio"] * 0.9))
        out.append((x["finding"], x["severity"], kind, {"exact": 1.0, "missed": 0.0}.get(kind, partial)))
    return used, out


def brute_score(matches, invented):
    weight = {"critical": 4.0, "major": 2.5, "minor": 1.0, "incidental": 0.5}
    if not matches:
        return 100.0
    missed = [m for m in matches if m[2] == "missed"]
    share = (len(matches) - len(missed)) / len(matches)
    if any(m[1] == "critical" for m in missed):
        floor = 0
    elif missed and all(m[1] in ("minor", "incidental") for m in missed):
        floor = 84
    elif "high" in invented:
        floor = 72 if share >= 0.8 else 0
    else:
        floor = 88 if not missed else 84 if share >= 0.9 else 80 if share >= 0.8 else 0
    total = sum(weight.get(m[1], 0) for m in matches)
    base = sum(weight.get(m[1], 0) * m[3] for m in matches) / total * 100 if total else 100.0
    return max(floor, max(0.0, min(100.0, base - sum(5 if h == "high" else 1 for h in invented))))


def test_greedy_matching_equals_loops(spark):
    r = random.Random(17)
    rows = []
    for k in range(400):
        n = r.randint(0, 5)
        rated = [{
            "finding": f"g{i}", "severity": r.choice(["critical", "major", "minor", "incidental"]), "literal": r.random() < 0.3, "agrees": r.random() < 0.7, "ratio": r.choice([0.0, 0.5, 0.55, 0.8, 1.0]), "loose": r.random() < 0.5,
            "candidates": [{"alike": a, "total": min(1.0, a + r.choice([0, 0.1, 0.2])), "agrees": r.random() < 0.7} for a in (r.choice([0.0, 0.3, 0.4, 0.6, 0.7, 0.9]) for _ in range(n))],
        } for i in range(r.randint(0, 6))]
        rows.append((k, rated, [(f"h{i}", r.choice(["high", "medium"])) for i in range(r.randint(0, 3))]))
    kind = "array<struct<finding:string,severity:string,literal:boolean,agrees:boolean,ratio:double,loose:boolean,candidates:array<struct<alike:double,total:double,agrees:boolean>>>>"
    table = spark.createDataFrame(rows, f"id long, _rated {kind}, invented array<struct<text:string,confidence:string>>")
    got = table.withColumn("g", evaluators._greedy()).withColumn("score", evaluators.finding_score(F.col("g")["out"], F.col("invented"))).collect()
    for x in got:
        used, out = brute_greedy(rows[x.id][1])
        assert (list(x.g.used), [tuple(m) for m in x.g.out]) == (used, out)
        assert x.score == pytest.approx(brute_score(out, [h for _, h in rows[x.id][2]]))


def brute_tokens(text):
    """Words that count, by the lexicon's own tables."""
    import re

    from assaykit.functions import lexicon

    x = f" {re.sub('<[^>]+>', '', text)} "
    for p, by in lexicon.CAPITALS:
        x = re.sub(p, by, x)
    x = re.sub("[^a-z0-9]+", " ", fold_plain(x))
    for p, by in lexicon.WRITTEN_OUT:
        x = re.sub(p, by, x)
    return list(dict.fromkeys(t for t in x.split() if len(t) > 2 and t not in lexicon.STOPWORDS))


def fold_plain(t):
    import re
    import unicodedata

    return re.sub(r"\s+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t))).strip().lower()


def test_folding_and_tokens_equal_python(spark):
    from assaykit.functions import clinical, text

    r = random.Random(19)
    pieces = ["Éffusão", "nódulo", "<b>", "</b>", "CT", "RM", "the", " ", "  ", "\t", " ", " ", "é", "left lung", "5 mm", "ÅNGSTRÖM", "ﬁbrosis", "\n", "US", "no", "of"]
    texts = [None, "", " a ", "plain ascii  text\twith\x0bruns \r\n of blanks"] + ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", text.fold(F.col("t")).alias("f"), text.fold(F.concat("t", F.lit(" x"))).alias("g"), clinical.tokens(F.col("t")).alias("w"))
    for x in rows.collect():
        t = texts[x.id]
        assert (x.f, x.g) == ((None, None) if t is None else (fold_plain(t), fold_plain(t + " x")))
        assert x.w == (None if t is None else brute_tokens(t))


def test_cases_of_a_suite(spark, tmp_path):
    (tmp_path / "suites").mkdir()
    (tmp_path / "cases").mkdir()
    put_ = lambda name, x: (tmp_path / name).write_text(json.dumps(x))
    put_("cases/c.json", [{"id": "a", "exam": "CT"}, {"id": "b"}])
    put_("cases/one.json", {"id": "a"})
    put_("suites/s.json", {"benchmarkName": "n", "id": "s", "casesPath": "../cases/c.json"})
    put_("suites/bad.json", {"benchmarkName": "n", "id": "t", "casesPath": "../cases/one.json"})
    put_("suites/none.json", {"benchmarkName": "n", "id": "u"})
    read = lambda n: artifacts.read_suite_cases(spark, str(tmp_path / "suites" / n))
    assert [(x.id, x.exam, x.suite_id) for x in read("s.json").orderBy("id").collect()] == [("a", "CT", "s"), ("b", None, "s")]
    with pytest.raises(ValueError, match="must be a JSON array"):
        read("bad.json")
    with pytest.raises(ValueError, match="suite u does not ship cases"):
        read("none.json")


def test_lines_of_audits_and_robustness(spark, made, tmp_path):
    lines = [r["value"] for r in run(spark, tmp_path, "report", put(tmp_path / "runs", made), "--kind", "audit")[1]]
    assert lines[0] == "# Audit of failed checks" and "| all runs | 13 | 13 | 0 | 0 | 16.0 | 16.0 |" in lines and "## b" in lines and lines[-1] == "| **total** | 12 | 12 | 0 | 0 | 12.0 | 12.0 |"
    rows = [("x", s, "D", f"c{k}", a, w) for k, (s, a, w) in enumerate([("low", "system_error", 1.0), ("high", "system_error", 4.0), ("many", "review_needed", 1.0), ("many", "review_needed", 1.0), ("none", "review_needed", 1.0)])]
    cube = reporting.audit_cube(spark.createDataFrame(rows, "run string, stratum string, dim string, case_id string, adjudication string, weight double"))
    got = [x.value.split(" | ")[0][2:] for x in reporting.audit_lines(cube).collect() if x.value.startswith("| ") and "Stratum" not in x.value and "---" not in x.value]
    assert got == ["Runs", "all runs", "high", "low", "many", "none", "**total**"]
    kinds = spark.createDataFrame([("b", 2, 1, 50.0), ("a", 3, 3, 100.0)], "kind string, n long, caught long, rate double")
    assert [x.value for x in reporting.robustness_lines(kinds).collect()][-2:] == ["| a | 3 | 3 | 100.0% |", "| b | 2 | 1 | 50.0% |"]


def test_telemetry_records(spark):
    rows = [(1, "t", "page_view<>", "/a", "x" * 200, "l", "DE", "https://user@some.host.org:8080/p?q=1", "1.2.3.4, 5.6.7.8", "agent"), (2, "t", "other", None, None, None, None, None, None, None), (3, "t", "page_view", None, "", None, None, "not an address", "", None)]
    got = {x.id: x for x in release.telemetry_record(spark.createDataFrame(rows, "id long, ts string, event string, path string, target string, label string, country string, referrer string, ip string, user_agent string"), ("page_view",), "A1", "salt").collect()}
    assert got.keys() == {1, 3} and got[1].event == "page_view" and len(got[1].target) == 180 and got[1].referrer_host == "some.host.org" and got[1].artifact_id == "A1"
    assert got[1].ip_hash == hashlib.sha256(b"salt:1.2.3.4").hexdigest()[:24] and got[3].ip_hash is None and got[3].ua_hash is None and got[3].target is None and got[3].referrer_host is None


def test_retrieval_evaluator_equals_loops(spark):
    import math

    r = random.Random(23)
    rows = []
    for k in range(300):
        graded = {f"d{i}": r.randint(0, 3) for i in range(r.randint(0, 6))}
        rows.append((str(k), "x", "x", [f"d{r.randrange(9)}" for _ in range(r.randint(0, 8))], graded))
    table = spark.createDataFrame(rows, "case_id string, html string, findings string, retrieved array<string>, relevance map<string,int>")
    half_up = lambda x: math.floor(x + 0.5)
    gain = lambda grades: sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(grades))
    for x in evaluators.retrieval(table).collect():
        _, _, _, said, graded = rows[int(x.case_id)]
        docs = list(dict.fromkeys(said))
        if not graded or not docs:
            assert x.retrieval_mode == ("retrieval-gold-present-no-pipeline" if graded else "unscored") and x.retrieval_score == -1
            continue
        grades, k = [graded.get(d, 0) for d in docs], min(5, len(docs))
        top, ideal = grades[:k], sorted(graded.values(), reverse=True)[:k]
        found, wanted = sum(g >= 1 for g in top), sum(g >= 1 for g in graded.values())
        first = next((i + 1 for i, g in enumerate(grades) if g >= 1), None)
        p, rc, n, m = found / len(top), found / wanted if wanted else 1.0, gain(top) / gain(ideal) if gain(ideal) else 0.0, 1 / first if first else 0.0
        assert x.retrieval_score == min(100, half_up(rc * 40 + p * 20 + n * 25 + m * 15)), x
        assert [(c.id, c.passed) for c in x.retrieval_checks] == [("RG01", p >= 0.6), ("RG02", rc >= 0.5), ("RG03", n >= 0.5), ("RG04", m >= 0.5)]


def test_shares_of_checks_and_rates_equal_loops(spark):
    import math

    r = random.Random(29)
    weights = evaluators.CHECK_WEIGHTS
    rows = [(k, [(r.choice(["critical", "major", "minor", "odd"]), r.random() < 0.6) for _ in range(r.randint(0, 7))], r.randint(0, 4), r.randint(0, 4), r.randint(0, 4)) for k in range(200)]
    table = spark.createDataFrame(rows, "id long, checks array<struct<severity:string,passed:boolean>>, tp int, fn int, fp int")
    recall, precision, f1 = evaluators.rates(F.col("tp"), F.col("fn"), F.col("fp"))
    for x in table.select("id", evaluators.weighted_share(F.col("checks"), weights).alias("share"), recall.alias("r"), precision.alias("p"), f1.alias("f")).collect():
        _, checks, tp, fn, fp = rows[x.id]
        w = lambda s: weights.get(s, weights["minor"])
        assert x.share == (math.floor(sum(w(s) for s, ok in checks if ok) / sum(w(s) for s, _ in checks) * 100 + 0.5) if checks else 100)
        want = (tp / (tp + fn) if tp + fn else 1.0, tp / (tp + fp) if tp + fp else 1.0)
        assert (x.r, x.p) == want and x.f == pytest.approx(2 * want[0] * want[1] / sum(want) if sum(want) else 0.0)
