"""Commands of the harness over files. Each reads its files as tables, runs the same operators as the queries, and writes its result.

python -m assaykit.cli COMMAND --help
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import fold_any
from .operators import adjudication, agreement, board, calibration, contamination, pairing, provenance, release, reporting, robustness, submission, summary
from .sources import artifacts, scratch, tracked
from .sources.scratch import with_position


def cases_of(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a file in the columns of the evaluators."""
    c = artifacts.read_cases(spark, path)
    gold = F.transform("goldFindings", lambda g: F.struct(*(g[n].alias(n) for n in ("finding", "severity", "location", "laterality", "measurements", "negated"))))
    wanted = F.transform("guidelineExpectations", lambda e: F.struct(e["guidelineId"].alias("guideline"), e["expectedClassification"].alias("classification"), e["expectedRecommendation"].alias("recommendation"), e["recommendationRequired"].alias("required")))
    grades = F.map_from_entries(F.transform("retrievalGold", lambda r: F.struct(r["documentId"], r["relevance"])))
    return c.select(F.col("id").alias("case_id"), F.coalesce("exam", F.lit("")).alias("exam"), F.coalesce("findings", F.lit("")).alias("findings"), F.coalesce("locale", F.lit("pt-BR")).alias("locale"), F.col("referenceReport").alias("reference"), gold.alias("gold"), F.col("criticalFindings").alias("urgent"), wanted.alias("expectations"), grades.alias("relevance"), "difficulty")


def predictions_of(spark: SparkSession, path: str) -> DataFrame:
    """Predictions in order of the file."""
    rows = artifacts.read_predictions(spark, path)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def _runs(spark: SparkSession, path: str, a) -> DataFrame:
    """Run artifacts that follow from their checks; with --unverified as they are."""
    return artifacts.read_runs(spark, path) if a.unverified else artifacts.read_suite_runs(spark, path)


def _results(runs: DataFrame) -> DataFrame:
    """One row for each case of the runs."""
    m, judge = F.col("manifest"), F.concat_ws(":", F.coalesce("manifest.judgeProvider", F.lit("judge")), F.coalesce("manifest.judgeModel", F.lit("none")))
    rows = runs.select(m["runName"].alias("run"), judge.alias("judge"), m["comparableKey"].alias("comparable_key"), m["canaryToken"].alias("token"), F.explode("results").alias("r"))
    return rows.select(
        "run", "judge", "comparable_key", "token", F.col("r.case.id").alias("case_id"), F.col("r.combinedOverall").alias("overall"), F.col("r.verdict").alias("verdict"), F.col("r.checks").alias("checks"),
        F.col("r.detOverall").alias("det_overall"), F.col("r.judge.overall").alias("judge_overall"), F.col("r.rawHtml").alias("html"),
        F.coalesce("r.judge.critical_failures", F.array().cast("array<map<string,string>>")).alias("judge_failures"), F.coalesce("r.detDims.CRIT.critFails", F.lit(0)).alias("crit_CRIT"),
    )


def suites(spark, a) -> DataFrame:
    return artifacts.read_suite(spark, f"{a.path}/*.json").orderBy("id")


def single(spark, a) -> DataFrame:
    """One report against one case."""
    html = artifacts.read_text(spark, a.report).select(F.col("value").alias("html"))
    return submission.results(cases_of(spark, a.cases).where(F.col("case_id") == a.case).crossJoin(html))  # one row each


def suite(spark, a) -> DataFrame:
    """Reports of a generator (a program that reads the prompt) for all cases, evaluated."""
    cases = cases_of(spark, a.cases)
    prompts = cases.select(F.col("case_id").alias("id"), F.concat_ws("\n", "exam", "findings").alias("prompt"))
    made = artifacts.generate(board.limited(prompts, a.limit, "id") if a.limit else prompts, artifacts.command(a.command.split()))
    html = made.select(F.col("instance_id").alias("_id"), F.col("model_output").alias("html"), F.col("error").isNotNull().alias("failed"), F.col("error").alias("failure"))
    return submission.results(cases.join(html, cases["case_id"].cast("string") == html["_id"]).drop("_id"))


def matrix(spark, a) -> DataFrame:
    """Several generators over the same cases."""
    parts = []
    for line in a.commands:
        one = argparse.Namespace(cases=a.cases, command=line, limit=a.limit)
        parts.append(suite(spark, one).withColumn("run", F.lit(line)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_submission(spark, a) -> DataFrame:
    return pairing.validation(cases_of(spark, a.cases).select(F.col("case_id").cast("string").alias("case_id")), predictions_of(spark, a.predictions))


def eval_submission(spark, a) -> DataFrame:
    """Results by case; a submission that isn't valid stops here."""
    check = validate_submission(spark, a).first()
    if not check.valid and not a.partial:
        raise SystemExit(f"invalid submission: {check.asDict()}")
    return submission.evaluate_submission(cases_of(spark, a.cases), predictions_of(spark, a.predictions), a.policy)


def leaderboard(spark, a) -> DataFrame:
    """Groups of comparable runs in order; runs that aren't valid have no rank. Of the optional rates a missing one is 0."""
    s, zero = F.col("summary"), F.lit(0.0)
    rows = _runs(spark, a.runs, a).select(
        F.col("manifest.runName").alias("run"), F.col("manifest.comparableKey").alias("comparable_key"), F.coalesce("manifest.validation.valid", F.lit(False)).alias("eligible"),
        F.coalesce(s["allPassRate"], zero).alias("all_pass_rate"), F.coalesce(s["criterionPassRate"], zero).alias("criterion_pass_rate"), s["averageOverall"].alias("average_overall"),
        F.coalesce(s["accuracyRate"], s["strictPassRate"], zero).alias("strict_pass_rate"), s["passRate"].alias("pass_rate"), F.coalesce(s["totalCostUsd"], zero).alias("total_cost_usd"), F.coalesce(s["averageLatencyMs"], zero).alias("average_latency_ms"),
    )
    return summary.in_groups(summary.rank_entries(rows))


def compare(spark, a) -> DataFrame:
    one, two = (_results(_runs(spark, p, a)) for p in (a.a, a.b))
    return pairing.compare(one, two, "comparable_key").orderBy(F.abs("delta").desc(), "case_id")


def discriminate(spark, a) -> DataFrame:
    """Paired difference of two runs with its interval and p value."""
    one, two = (_results(_runs(spark, p, a)) for p in (a.a, a.b))
    rows = pairing.align(one, two, ["overall"]).select("case_id", F.round((F.col("a_overall") - F.col("b_overall")) * 10).cast("long").alias("tenths"))
    return agreement.paired_bootstrap(with_position(rows, "case_id"), a.resamples)


def calibrate(spark, a) -> DataFrame:
    """Agreement of the runs' judges with themselves, with each other, and with the checks."""
    return calibration.calibrate(_results(_runs(spark, a.runs, a)))


def contamination_(spark, a) -> DataFrame:
    """Outputs that hold their run's canary token (or the one given), and cases that a judge suspects."""
    return contamination.scan_runs(_results(_runs(spark, a.runs, a)), a.token).orderBy("run")


def perturb_matrix(spark, a) -> DataFrame:
    return robustness.matrix(cases_of(spark, a.cases), tuple(a.kinds) if a.kinds else None, a.applicable)


def perturb_run(spark, a) -> DataFrame:
    """Perturbed texts of a matrix evaluated, and how many the checks notice."""
    cases = cases_of(spark, a.cases)
    links = perturb_matrix(spark, a).withColumn("prediction_id", F.concat_ws("__", "prediction_id", "kind"))
    texts = links.select(F.col("case_id").alias("_case"), F.col("prediction_id").alias("_id"), F.col("text").alias("html"))
    changed = cases.join(texts, F.col("case_id") == F.col("_case")).drop("case_id", "_case").withColumnRenamed("_id", "case_id")
    return robustness.summarize_links(submission.results(changed), links).orderBy("kind")


def bootstrap(spark, a) -> DataFrame:
    rows = _results(_runs(spark, a.run, a)).select("case_id", F.round(F.col("overall") * 10).cast("long").alias("tenths"))
    return agreement.bootstrap_interval(with_position(rows, "case_id"), a.resamples)


def provenance_(spark, a) -> DataFrame:
    """(kind, name, hash, n): the hash of each tracked file and the root over all; with --cases, --scoring and --runs the hashes of suites, scoring code and runs."""
    files = tracked.tracked_files(spark, a.path)
    own = scratch.stored(provenance.leaves(files))
    rows = own.select(F.lit("file").alias("kind"), "name", "hash", F.lit(1).cast("long").alias("n")).union(provenance.root(own).select(F.lit("root"), F.lit("*"), "hash", "n"))
    suites, scoring = None, ""
    if a.cases:
        cases = artifacts.read_case_objects(spark, a.cases)
        suites = scratch.stored(provenance.suite_hashes(cases.select(F.regexp_extract("path", r"([^/]+?)(?:\.json)?$", 1).alias("suiteId"), F.coalesce(F.variant_get("case", "$.locale", "string"), F.lit("")).alias("locale"), "case")))
        rows = rows.union(suites.select(F.lit("suite"), F.concat_ws(" ", "suiteId", "locale"), "suiteHash", "caseCount"))
    if a.scoring:
        code = scratch.stored(provenance.scoring_hash(files, a.scoring))
        scoring = code.first().scoringHash
        rows = rows.union(code.select(F.lit("scoring"), F.lit("*"), "scoringHash", F.size("scoringFiles").cast("long")))
    if a.runs:
        rows = rows.union(provenance.run_hashes(_runs(spark, a.runs, a), scoring, suites).select(F.lit("run"), "runName", "runHash", F.lit(1).cast("long")))
    return rows


def report(spark, a) -> DataFrame:
    """Markdown lines: the failed checks by run and stratum, with --kind audit with what is to blame, or with --kind whole the report of the first run by name."""
    runs = scratch.stored(_runs(spark, a.runs, a))
    if a.kind == "strata":
        return reporting.strata_lines(reporting.strata(_results(runs)))
    if a.kind == "audit":
        flat = _results(runs).select("run", "case_id", fold_any("html").alias("report"), F.inline("checks")).withColumn("report", F.coalesce("report", F.lit("")))
        return reporting.audit_lines(reporting.audit_cube(pairing.failed_issues(flat).withColumns({"stratum": pairing.stratum(), "adjudication": pairing.adjudication(True)})))
    given = artifacts.read_json(spark, a.provenance, "scoringHash string, suites array<struct<suiteId:string,suiteHash:string>>") if a.provenance else None
    return reporting.consolidated_lines(runs, _results(runs), scratch.stored(_results(_runs(spark, a.baseline, a))) if a.baseline else None, given, a.resamples)


def reliability(spark, a) -> DataFrame:
    """Shares of cases that are safe in all of k runs; with --markdown as lines."""
    rows = _results(_runs(spark, a.runs, a)).withColumn("safe", (F.col("crit_CRIT") == 0) & (F.size("judge_failures") == 0) & ~F.exists("checks", lambda c: ~c["passed"] & (c["severity"] == "critical")))
    per_case = scratch.stored(pairing.case_reliability(rows))
    return reporting.reliability_lines(per_case, a.k) if a.markdown else pairing.pass_power_k(per_case, a.k)


def adjudication_(spark, a) -> DataFrame:
    return adjudication.validated(artifacts.read_json(spark, a.file, adjudication.SCHEMA), a.suite_id, a.suite_hash).select("valid", "errors", "reviewer_count", "case_count", "clinical_agreement", "dimension_agreement")


def release_guard(spark, a) -> DataFrame:
    """Rules that tracked files break; --records: signed adjudication records that may back a claim."""
    files = scratch.stored(tracked.tracked_files(spark, a.path))
    backed = bool(a.records) and release.backed(files, adjudication.validated(artifacts.read_json(spark, a.records, adjudication.SCHEMA)))
    return release.issues(files, a.mode, backed)


#: Runs are verified as they are read, unless this is given.
UNVERIFIED = "--unverified!"
#: command: (function, arguments)
COMMANDS = {
    "suites": (suites, ["path"]), "single": (single, ["cases", "case", "report"]), "suite": (suite, ["cases", "command", "--limit:float"]), "matrix": (matrix, ["cases", "commands+", "--limit:float"]),
    "validate-submission": (validate_submission, ["cases", "predictions"]), "eval-submission": (eval_submission, ["cases", "predictions", "--policy=research", "--partial!"]), "leaderboard": (leaderboard, ["runs", UNVERIFIED]),
    "compare": (compare, ["a", "b", UNVERIFIED]), "discriminate": (discriminate, ["a", "b", "--resamples:int=10000", UNVERIFIED]), "calibrate": (calibrate, ["runs", UNVERIFIED]), "contamination": (contamination_, ["runs", "--token=", UNVERIFIED]),
    "perturb-matrix": (perturb_matrix, ["cases", "--kinds+", "--applicable!"]), "perturb-run": (perturb_run, ["cases", "--kinds+", "--applicable!"]), "bootstrap": (bootstrap, ["run", "--resamples:int=10000", UNVERIFIED]),
    "provenance": (provenance_, ["path", "--cases=", "--scoring+", "--runs=", UNVERIFIED]), "report": (report, ["runs", "--kind=strata", "--baseline=", "--provenance=", "--resamples:int=10000", UNVERIFIED]), "reliability": (reliability, ["runs", "k:int", "--markdown!", UNVERIFIED]), "adjudication": (adjudication_, ["file", "--suite-id=", "--suite-hash="]), "release-guard": (release_guard, ["path", "--mode=private", "--records="]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assaykit")
    top.add_argument("--out", help="folder for the result as JSON lines; without it the rows are shown")
    subs = top.add_subparsers(dest="name", required=True)
    for name, (make, arguments) in COMMANDS.items():
        sub = subs.add_parser(name, help=(make.__doc__ or "").split("\n")[0])
        for spec in arguments:
            label, _, default = spec.rstrip("!+").partition("=")
            label, _, kind = label.partition(":")
            extra: dict = {"action": "store_true"} if spec.endswith("!") else {"type": {"int": int, "float": float}.get(kind, str)}
            if spec.endswith("+"):
                extra["nargs"] = "+"
            if label.startswith("--") and not spec.endswith("!"):
                extra["default"] = extra["type"](default) if default else None
            sub.add_argument(label, **extra)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command. Exit code 1: an invalid submission or record, or a release with blocking issues."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"assaykit-{a.name}").getOrCreate()
    out = COMMANDS[a.name][0](spark, a)
    if a.out:
        artifacts.write_json(out, a.out)
        out = spark.read.schema(out.schema).json(a.out)
    else:
        out.show(1000, truncate=False)
    if a.name in ("validate-submission", "adjudication"):
        code = int(out.where(~F.col("valid")).limit(1).count() > 0)
    else:
        code = int(a.name == "release-guard" and out.where("severity = 'error'").limit(1).count() > 0)
    scratch.clean(spark)
    return code


if __name__ == "__main__":
    sys.exit(main())
