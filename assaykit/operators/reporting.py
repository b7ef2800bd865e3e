"""Reports of runs: the tables and totals of one come from one aggregation with grouping sets; lines are made of what it returns.

Only figures reach the lines: a row for each run, stratum or dimension, never cases, but for flaky ones, which are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..sources.artifacts import markdown_table
from ..sources.scratch import with_position
from . import agreement, calibration, contamination, pairing, provenance
from .scoring import DIMS

#: Every table of an audit: by run and stratum, run and dimension, run, stratum, dimension, and over all.
SETS = (("run", "stratum"), ("run", "dim"), ("run",), ("stratum",), ("dim",), ())


def audit_cube(issues: DataFrame, sets=SETS) -> DataFrame:
    """(part, keys, totals): pairing's audit totals for each of the sets in one pass. part names the keys of a row's table, '' is the total over all.

    issues: failed checks with case_id, weight and adjudication. Keys that a table doesn't have are null, as a null key itself is.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    system = F.col("adjudication") == "system_error"
    rows = issues.select(*keys, "case_id", "adjudication", "weight")
    # A key's bit is set where the row's table doesn't have it.
    part = F.concat_ws(",", *(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))
    return rows.groupingSets([list(s) for s in sets], *keys).agg(
        part.alias("part"), F.count("*").alias("failed_checks"), F.count_if(system).alias("system_errors"), F.count_if(F.col("adjudication") == "evaluator_limitation").alias("evaluator_limitations"),
        F.count_if(F.col("adjudication") == "review_needed").alias("review_needed"), F.sum(F.when(system, F.col("weight")).otherwise(0.0)).alias("system_weight"), F.sum("weight").alias("raw_weight"),
        F.approx_count_distinct("case_id").alias("about_cases"),
    ).select("part", *keys, "failed_checks", "system_errors", "evaluator_limitations", "review_needed", "system_weight", "raw_weight", "about_cases")


def score_cube(results: DataFrame, keys=("run", "modality", "difficulty")) -> DataFrame:
    """(part, keys, cases, mean, pass_rate, strict_rate, all_pass_rate) by every subset of the keys: CUBE, one pass. Keys without a value count as 'unspecified'."""
    tenths = F.sum(F.round(F.col("overall") * 10).cast("long")).cast("double")
    rate = lambda x: to_fixed(F.count_if(x).cast("double") / F.count("*") * 100.0, 1)
    part = F.concat_ws(",", *(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys))
    rows = results.select(*(F.coalesce(F.col(k).cast("string"), F.lit("unspecified")).alias(k) for k in keys), "overall", "verdict", "all_pass")
    return rows.cube(*keys).agg(
        part.alias("part"), F.count("*").alias("cases"), to_fixed(tenths / 10.0 / F.count("*"), 1).alias("mean"), rate(F.col("verdict") != "FAIL").alias("pass_rate"),
        rate(F.col("verdict") == "PASS").alias("strict_rate"), rate(F.col("all_pass")).alias("all_pass_rate"),
    ).select("part", *keys, "cases", "mean", "pass_rate", "strict_rate", "all_pass_rate")


# ---- Lines


def _lines(spark, lines: list[str]) -> DataFrame:
    """Numbered lines, a partition each report."""
    return spark.createDataFrame(list(enumerate(lines)), "line int, value string").coalesce(1).orderBy("line").select("value")


def _table(head: list[str], rows, right: int = 1) -> list[str]:
    """A pipe table whose columns from `right` on are numbers."""
    clean = lambda x: " ".join(str("-" if x is None else x).replace("|", "/").split())
    return [f"| {' | '.join(head)} |", f"| {' | '.join('---' if k < right else '---:' for k in range(len(head)))} |", *(f"| {' | '.join(map(clean, r))} |" for r in rows)]


def strata(results: DataFrame) -> DataFrame:
    """(run, stratum, failed, cases) of the failed checks. results: run, case_id and checks."""
    flat = results.select("run", "case_id", F.inline("checks")).withColumn("report", F.lit(""))
    issues = pairing.failed_issues(flat).withColumn("stratum", pairing.stratum())
    return issues.groupBy("run", "stratum").agg(F.count("*").alias("failed"), F.count_distinct("case_id").alias("cases"))


def strata_lines(counts: DataFrame) -> DataFrame:
    head = counts.sparkSession.createDataFrame([("| run | stratum | failed | cases |",), ("| --- | --- | --- | --- |",)], "value string")
    return head.union(markdown_table(counts.orderBy("run", F.desc("failed"), "stratum"), ["run", "stratum", "failed", "cases"]))


def reliability_lines(per_case: DataFrame, k: int) -> DataFrame:
    """Lines on k runs of the same cases (see pairing.case_reliability)."""
    r = pairing.pass_power_k(per_case, k).first()
    flaky = [x.case_id for x in pairing.flaky_cases(per_case, k).select("case_id").orderBy("case_id").collect()]  # they are listed
    share = lambda v: f"{(v or 0) * 100:.1f}%"
    rows = [(f"**Critical-safe pass^{k}** (headline)", share(r.pass_power_k_safe)), ("Critical-safe pass@1", share(r.pass_at_1_safe)), (f"Verdict pass^{k}", share(r.pass_power_k_verdict)), ("Verdict pass@1", share(r.pass_at_1_verdict))]
    said = f"Flaky (critical-safe in some but not all runs): {', '.join(map(str, flaky))}" if flaky else "No flaky critical cases: every case was critical-safe in all-or-none of the runs."
    lines = [f"# Reliability (pass^{k})", "", f"Cases: {r.case_count} | Runs (k): {k}", "", *_table(["Metric", "Value"], rows), "", said]
    return _lines(per_case.sparkSession, lines)


def discrimination(a: DataFrame, b: DataFrame, resamples: int = 10_000, alpha: float = 0.05, least: float = 2.0) -> DataFrame:
    """The paired difference of two runs over the cases that both have, with a verdict."""
    rows = pairing.align(a, b, ["overall"]).select("case_id", F.round((F.col("a_overall") - F.col("b_overall")) * 10).cast("long").alias("tenths"))
    found = agreement.paired_bootstrap(with_position(rows, "case_id"), resamples, alpha)
    apart = (F.col("p_value") < alpha) & (F.col("lower") > 0)
    return found.withColumn("verdict", F.when(apart & (F.abs("mean_diff") >= least), "discriminates").when(apart, "weak").otherwise("fails"))


def provenance_of(run: DataFrame, record: DataFrame) -> DataFrame:
    """(suiteHash, runHash, scoringHash) of a run by a published record: the suite's hash is looked up, and is the run's own where the record doesn't list it."""
    suites = record.select(F.inline("suites")).select("suiteId", "suiteHash")
    scoring = record.first().scoringHash
    return provenance.run_hashes(run, scoring, suites).withColumn("scoringHash", F.lit(scoring))


def consolidated_lines(runs: DataFrame, results: DataFrame, baseline: DataFrame | None = None, record: DataFrame | None = None, resamples: int = 10_000, perturbed: DataFrame | None = None) -> DataFrame:
    """Lines on one run, the first by name: its figures, contamination, and what more is given: other runs of the suite (calibration of
    their judges), a baseline's results, a provenance record, a perturbation summary by kind (kind, n, caught, rate)."""
    spark = runs.sparkSession
    m = runs.select("manifest", "summary").orderBy("manifest.runName").first()
    if m is None:
        return _lines(spark, ["# Consolidated Report", "", "No runs."])
    name, s, mf = m.manifest.runName, m.summary, m.manifest
    own = results.where(F.col("run") == name)
    scores = with_position(own.select("case_id", F.round(F.col("overall") * 10).cast("long").alias("tenths")), "case_id")
    ci, scan = agreement.bootstrap_interval(scores, resamples).first(), contamination.scan_runs(own).first()
    fixed = lambda x, d=2: f"{(x or 0):.{d}f}"
    lines = [f"# Consolidated Report: {name}", "", f"**Benchmark version:** {mf.benchmarkVersion}  ", f"**Suite:** {mf.suiteId} ({mf.locale})  ", f"**Judge:** {mf.judgeProvider or 'none'}:{mf.judgeModel or 'none'}  ", "", "## Primary metrics", ""]
    lines += _table(["Metric", "Value"], [
        ("n cases", ci.n), ("All-pass completion", f"{fixed(s.allPassRate)}%"), ("Criterion pass rate", f"{fixed(s.criterionPassRate)}%"), ("Mean overall", f"{fixed(ci.mean)}%"), ("95% CI", f"[{fixed(ci.lower)}, {fixed(ci.upper)}]"),
        ("Pass rate", f"{fixed(s.passRate)}%"), ("Strict pass rate", f"{fixed(s.strictPassRate)}%"), ("Cost (USD)", f"${fixed(s.totalCostUsd, 4)}"), ("Avg latency", f"{fixed(s.averageLatencyMs, 1)}ms"),
    ], 2)
    per_dim = [(d, f"{s.averagePerDim[d]:.2f}%") for d in DIMS if s.averagePerDim is not None and s.averagePerDim[d] is not None]
    lines += ["", "### Per-dimension averages", "", *_table(["Dim", "Mean"], per_dim), ""]
    lines += ["## Contamination scan", f"- **Verdict:** {scan.verdict.upper()}", f"- Canary token: {mf.canaryToken or '(none)'}", f"- Canary hits: {scan.canary_hits}", f"- Judge-flagged: {scan.judge_flagged}", ""]
    if runs.count() > 1:
        c = calibration.calibrate(results).first()
        lines += ["## Judge calibration", f"- **Verdict:** {c.verdict.upper()}", f"- Judges: {', '.join(c.judges)}", f"- Spearman of checks and judge: {fixed(c.spearman, 3)} (n={c.n})", ""]
    if baseline is not None:
        d, other = discrimination(own, baseline, resamples).first(), baseline.agg(F.min("run")).first()[0]
        lines += [f"## Discrimination vs baseline ({other})", f"- **Verdict:** {d.verdict.upper()}", f"- Mean difference: {fixed(d.mean_diff)}pp", f"- 95% CI: [{fixed(d.lower)}, {fixed(d.upper)}]", f"- p-value: {fixed(d.p_value, 4)}", ""]
    if perturbed is not None:
        kinds = perturbed.orderBy("kind").collect()  # a row for each kind
        n, caught = sum(k.n for k in kinds), sum(k.caught for k in kinds)
        lines += ["## Adversarial perturbation robustness", f"- Overall catch rate: {fixed(100 * caught / n if n else 0)}%", "", *_table(["Kind", "n", "caught", "rate"], [(k.kind, k.n, k.caught, f"{k.rate}%") for k in kinds]), ""]
    if record is not None:
        p = provenance_of(runs.where(F.col("manifest.runName") == name), record).first()
        lines += ["## Provenance", f"- Suite hash: `{p.suiteHash}`", f"- Run hash: `{p.runHash}`", f"- scoringHash={p.scoringHash}", ""]
    return _lines(spark, [*lines, "---"])


def comparison_lines(totals: DataFrame, a: str, b: str) -> DataFrame:
    """Lines on the strata of two runs (see pairing.strata_comparison): where the second one's system failures weigh more comes first."""
    gap = F.col("b_system_weighted") - F.col("a_system_weighted")
    rows = totals.withColumn("gap", gap).orderBy(F.desc("gap"), "stratum").collect()  # a row for each stratum
    table = _table(["Stratum", f"{a} failures", f"{b} failures", f"{a} only", f"{b} only", "Shared", "Weighted gap"], [(r.stratum, r.a_failures, r.b_failures, r.a_only, r.b_only, r.shared, f"{r.gap:.1f}") for r in rows])
    return _lines(totals.sparkSession, [f"# Stratified comparison: {a} and {b}", "", *table])


def audit_lines(cube: DataFrame) -> DataFrame:
    """Lines of an audit (see audit_cube): totals, then each run's strata, what weighs more as a failure of the system first."""
    rows = [r.asDict() for r in cube.where("part in ('', 'run', 'run,stratum')").orderBy("part", "run", F.desc("system_weight"), F.desc("failed_checks"), "stratum").collect()]  # a row for each run and stratum
    head = ["Stratum", "Failed", "System", "Evaluator", "Review", "System weight", "Weight"]
    figures = lambda r: (r["failed_checks"], r["system_errors"], r["evaluator_limitations"], r["review_needed"], f"{r['system_weight']:.1f}", f"{r['raw_weight']:.1f}")
    whole = [("all runs", *figures(r)) for r in rows if r["part"] == ""]
    lines = ["# Audit of failed checks", "", *_table(["Runs", *head[1:]], whole)]
    for run in [r for r in rows if r["part"] == "run"]:
        own = [(r["stratum"], *figures(r)) for r in rows if r["part"] == "run,stratum" and r["run"] == run["run"]]
        lines += ["", f"## {run['run']}", "", *_table(head, [*own, ("**total**", *figures(run))])]
    return _lines(cube.sparkSession, lines)


def robustness_lines(per_kind: DataFrame) -> DataFrame:
    """Lines on perturbations that were noticed, by kind in order of name (kind, n, caught, rate)."""
    rows = per_kind.orderBy("kind").collect()  # a row for each kind
    return _lines(per_kind.sparkSession, ["# Robustness", "", *_table(["Kind", "n", "caught", "rate"], [(r.kind, r.n, r.caught, f"{r.rate}%") for r in rows])])


def summary_tex(summaries: DataFrame) -> DataFrame:
    """Lines of a LaTeX table of run summaries (run, average_overall, all_pass_rate, criterion_pass_rate, strict_pass_rate, pass_rate), best first."""
    safe = lambda x: "".join("\\" + c if c in "&%$#_{}" else {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}.get(c, c) for c in str(x))
    rows = summaries.orderBy(F.desc("average_overall"), "run").collect()  # a row for each run
    body = [f"{safe(r.run)} & {r.average_overall:.1f} & {r.all_pass_rate:.1f} & {r.criterion_pass_rate:.1f} & {r.strict_pass_rate:.1f} & {r.pass_rate:.1f} \\\\" for r in rows]
    return _lines(summaries.sparkSession, [r"\begin{tabular}{lrrrrr}", r"\toprule", r"Run & Score & All-pass & Criteria & Strict & Non-fail \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def site_data(entries: DataFrame, keys=("locale",)) -> DataFrame:
    """(keys, suite, suite_hash, cases, track, scoring, entries): the board of each locale as one row, entries in the board's order.

    entries: board.public rows with position (see summary.board_order), suite_id, suite_hash, cases, track, score_mode. A board has a row for each published run.
    """
    shown = [c for c in entries.columns if c not in (*keys, "suite_id", "suite_hash", "cases", "score_mode")]
    first = lambda c: F.min_by(c, "position")
    listed = F.array_sort(F.collect_list(F.struct("position", F.struct(*shown).alias("entry"))))
    return entries.groupBy(*keys).agg(
        first("suite_id").alias("suite"), first("suite_hash").alias("suite_hash"), first("cases").alias("cases"), first("track").alias("track"), F.coalesce(first("score_mode"), F.lit("conservative-min")).alias("scoring"),
        F.transform(listed, lambda e: e["entry"]).alias("entries"),
    )

