"""Verification of run artifacts: a run's manifest, cases and summary must follow from its checks and dimension scores.

Each case is scored again by the gated combination, with the run's own score mode; its verdict, overall and counts are
compared, and the summary is derived from what was found, never from stored verdicts. One aggregation by run (a suite's
cases) puts the artifact together again with its mismatches, so whoever reads verified runs scans them once.

Edge cases: a run without manifest, summary or results has that as its only mismatch; a stored number that is missing
where the format needs one is a mismatch, an optional one isn't; runs of one name in several files are runs of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..sources.artifacts import JUDGED
from .scoring import DIMS, WEIGHTS, combine, weighted
from .summary import TOLERANCE, comparable_key, summarize

VERDICTS = ("PASS", "PARTIAL", "FAIL")


def said(x: Column) -> Column:
    """A number as text, whole ones without a fraction; null as such."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("undefined"))


def _differs(actual: Column, wanted: Column) -> Column:
    return ~F.coalesce(F.abs(actual - wanted) <= TOLERANCE, F.lit(False))


def _against(what: Column, wanted: Column, actual: Column) -> Column:
    return F.concat(what, F.lit(" mismatch: expected "), wanted, F.lit(", got "), actual)


def expected_key(manifest: Column) -> Column:
    """The key of runs that may be compared with this one."""
    m = manifest
    return comparable_key(m["benchmarkVersion"], m["suiteId"], m["locale"], m["track"], F.coalesce(m["comparisonClass"], m["track"]), m["scaffoldId"], m["judgeProvider"], m["judgeModel"], F.coalesce(m["scoreMode"], F.lit("conservative-min")))


def _cases(runs: DataFrame) -> DataFrame:
    """One row for each case (for a run without any, one row with a null case), in the columns of scoring.combine()."""
    rows = runs.select("_run", "source", "manifest", "summary", F.col("results").isNull().alias("_none"), F.posexplode_outer("results").alias("_at", "r"))
    checks = F.col("r.checks")
    failed = lambda severity: F.coalesce(F.size(F.filter(checks, lambda c: ~c["passed"] & (c["severity"] == severity))), F.lit(0))
    passed = F.when(checks.isNull(), 0).otherwise(F.size(F.filter(checks, lambda c: c["passed"])))
    total = F.when(checks.isNull(), 0).otherwise(F.size(checks))
    judge = F.col("r.judge")
    listed = lambda c: F.when(judge[c].isNull(), 0).otherwise(F.size(judge[c]))
    return rows.select(
        "*", *(F.col(f"r.detDims.{d}.score").alias(f"score_{d}") for d in DIMS), *(F.col(f"r.detDims.{d}.verdict").alias(f"verdict_{d}") for d in DIMS),
        F.greatest(failed("critical"), F.lit(0)).alias("critical_failed"), F.greatest(failed("major"), F.lit(0)).alias("major_failed"),
        passed.cast("long").alias("criteria_passed"), total.cast("long").alias("criteria_total"), ((total > 0) & (passed == total)).alias("all_pass"),
        judge.isNotNull().alias("has_judge"), *(judge["scores"][d].alias(f"judge_{d}") for d in DIMS), judge["overall"].alias("judge_overall"),
        listed("critical_failures").alias("judge_critical"), listed("missing").alias("judge_missing"), listed("hallucinated").alias("judge_hallucinated"),
        F.forall(F.array(*(F.col(f"r.detDims.{d}") for d in DIMS)), lambda d: d["verdict"].isNotNull() & d["appliedWeight"].isNotNull()).alias("_whole"),
    )


def _ungated() -> Column:
    """The weighted mean of the stored dimensions, for cases whose dimension summaries are missing."""
    return to_fixed(weighted({d: F.col(f"r.combined.{d}") for d in DIMS}, WEIGHTS), 1)


def _case_errors() -> Column:
    r, who = F.col("r"), F.concat(F.lit("case "), F.coalesce(F.col("r.case.id"), F.col("_at").cast("string")))
    message = lambda text: F.concat(who, F.lit(f" {text}"))
    optional = lambda field, wanted: F.when(r[field].isNotNull() & (r[field] != F.col(wanted)), _against(message(field), F.col(wanted).cast("string"), r[field].cast("string")))
    critical = (F.col("critical_failed") > 0) | (F.col("judge_critical") > 0)
    return F.when(r.isNotNull(), F.array_compact(F.array(
        F.when(~F.col("_whole"), F.concat(who, F.lit(": missing deterministic dimension summaries (cannot re-verify through the gated combiner)"))),
        F.when(_differs(r["combinedOverall"], F.col("_overall")), _against(message("combinedOverall"), said(F.col("_overall")), said(r["combinedOverall"]))),
        F.when(F.col("_verdict").isNotNull() & ~r["verdict"].eqNullSafe(F.col("_verdict")), _against(message("verdict"), F.col("_verdict"), F.coalesce(r["verdict"], F.lit("undefined")))),
        F.when(critical & ~r["verdict"].eqNullSafe(F.lit("FAIL")), F.concat(who, F.lit(" verdict must be FAIL: a critical finding failure cannot be rescued (got "), F.coalesce(r["verdict"], F.lit("undefined")), F.lit(")"))),
        optional("allPass", "all_pass"), optional("criteriaPassed", "criteria_passed"), optional("criteriaTotal", "criteria_total"),
        F.when(r["costUsd"] < 0, message("has negative cost")), F.when(r["latencyMs"] < 0, message("has negative latency")),
    )))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.round(x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def audited(runs: DataFrame, require_results: bool = True) -> DataFrame:
    """(source, manifest, summary, results, errors): each run with its mismatches, in the order manifest, cases, summary."""
    named = runs if "source" in runs.columns else runs.withColumn("source", F.lit("suite run"))
    mode = F.coalesce(F.col("manifest.scoreMode"), F.lit("conservative-min")) == "judge-primary"
    rows = combine(_cases(named.select("source", "manifest", "summary", "results").withColumn("_run", F.monotonically_increasing_id())), True, judge_primary=mode)
    rows = rows.withColumns({"_overall": F.when(F.col("_whole"), F.col("overall")).otherwise(_ungated()), "_verdict": F.when(F.col("_whole"), F.col("verdict"))})
    veto = (F.col("critical_failed") > 0) | (F.col("judge_critical") > 0)
    rows = rows.withColumns({"_errors": _case_errors(), "_told": F.coalesce(F.col("_verdict"), F.when(veto, F.lit("FAIL")), F.col("r.verdict"))})
    there = F.col("r").isNotNull()
    by = rows.groupBy("_run").agg(
        F.any_value("source").alias("source"), F.any_value("manifest").alias("manifest"), F.any_value("summary").alias("summary"), F.bool_or("_none").alias("_none"),
        F.array_sort(F.collect_list(F.when(there, F.struct("_at", "r", "_errors"))), lambda a, b: a["_at"] - b["_at"]).alias("_cases"),
        F.count_if(there).alias("n"), F.count("r.case.id").alias("_named"), F.collect_set("r.case.id").alias("_ids"),
        *(F.count_if(there & (F.col("_told") == v)).alias(f"n_{v}") for v in VERDICTS), F.count_if(there & F.col("all_pass")).alias("_all"),
        F.coalesce(F.sum("criteria_passed"), F.lit(0)).alias("_passed"), F.coalesce(F.sum("criteria_total"), F.lit(0)).alias("_total"),
        _exact(F.col("r.combinedOverall")).alias("_sum"), _exact(F.col("r.latencyMs")).alias("_ms"), _exact(F.col("r.costUsd")).alias("_cost"),
        *((_exact(F.col(f"r.combined.{d}")) / F.nullif(F.count(f"r.combined.{d}"), F.lit(0))).alias(f"_mean_{d}") for d in DIMS),
    )
    over = F.greatest(F.col("n"), F.lit(1))
    part = lambda x: to_fixed(F.coalesce(x, F.lit(0)).cast("double") / over * 100.0, 1)
    mean = lambda x, digits: to_fixed(F.coalesce(F.col(x), F.lit(0.0)) / over, digits)
    strict = part(F.col("n_PASS"))
    wanted = {
        "averageOverall": mean("_sum", 1), "accuracyRate": strict, "strictPassRate": strict, "passRate": part(F.col("n") - F.col("n_FAIL")), "averageLatencyMs": mean("_ms", 1), "totalCostUsd": to_fixed(F.coalesce("_cost", F.lit(0.0)), 6),
        "allPassRate": part(F.col("_all")), "allPassCount": F.col("_all").cast("double"), "criterionPassRate": F.when(F.col("_total") > 0, to_fixed(F.col("_passed").cast("double") / F.col("_total") * 100.0, 1)).otherwise(0.0),
        "criteriaPassed": F.col("_passed").cast("double"), "criteriaTotal": F.col("_total").cast("double"),
    }
    must, m, s = list(wanted)[:6], F.col("manifest"), F.col("summary")
    by = by.withColumns({f"_w_{k}": x for k, x in wanted.items()} | {f"_mean_{d}": to_fixed(F.col(f"_mean_{d}"), 1) for d in DIMS})
    key, ids = expected_key(m), F.array_distinct(m["validation"]["expectedIds"])
    locked = F.when(F.col("_named") != F.col("n"), F.lit("valid run has a result row with no case id")).when(F.size("_ids") != F.col("_named"), F.lit("valid run has duplicate case ids in results")).when(
        (F.size("_ids") != F.size(ids)) | (F.size(F.array_except(ids, "_ids")) > 0), F.concat(F.lit("valid run result id-set does not match the locked suite (expected "), F.size(ids).cast("string"), F.lit(" unique ids, got "), F.size("_ids").cast("string"), F.lit(")")))
    first = [
        F.when(F.lit(require_results) & (F.col("n") == 0), F.lit("run has no case results")), F.when(~m["comparableKey"].eqNullSafe(key), _against(F.lit("comparableKey"), key, F.coalesce(m["comparableKey"], F.lit("undefined")))),
        F.when(m["validation"]["valid"], locked),
    ]
    last = [F.when((F.lit(k in must) | s[k].isNotNull()) & _differs(s[k], F.col(f"_w_{k}")), _against(F.lit(f"summary.{k}"), said(F.col(f"_w_{k}")), said(s[k]))) for k in wanted]
    last += [F.when(~s["verdictCounts"][v].eqNullSafe(F.col(f"n_{v}")), _against(F.lit(f"summary.verdictCounts.{v}"), F.col(f"n_{v}").cast("string"), said(s["verdictCounts"][v]))) for v in VERDICTS]
    for d in DIMS:
        have, want = s["averagePerDim"][d], F.col(f"_mean_{d}")
        last.append(F.when(want.isNull() & have.isNotNull(), F.lit(f"summary.averagePerDim.{d} should be absent")).when(want.isNotNull() & _differs(have, want), _against(F.lit(f"summary.averagePerDim.{d}"), said(want), said(have))))
    missing = F.array_compact(F.array(*(F.when(bad, F.lit(f"missing {what}")) for what, bad in (("manifest", m.isNull()), ("summary", s.isNull()), ("results array", F.col("_none"))))))
    found = F.concat(F.array_compact(F.array(*first)), F.flatten(F.transform("_cases", lambda c: c["_errors"])), F.array_compact(F.array(*last)))
    return by.select("source", "manifest", "summary", F.transform("_cases", lambda c: c["r"]).alias("results"), F.when(F.size(missing) > 0, missing).otherwise(found).alias("errors"))


def verified(runs: DataFrame, require_results: bool = True, observation=None) -> DataFrame:
    """(source, manifest, summary, results) of the runs; one with mismatches stops whatever reads them, with all of its mismatches in the error."""
    rows = audited(runs, require_results)
    if observation is not None:
        rows = rows.observe(observation, F.count("*").alias("runs"), F.coalesce(F.sum(F.size("results")), F.lit(0)).alias("cases"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("mismatches"))
    wrong = F.raise_error(F.concat(F.col("source"), F.lit(": integrity check failed: "), F.array_join("errors", "; ")))
    return rows.where(F.when(F.size("errors") == 0, F.lit(True)).otherwise(wrong.cast("boolean"))).drop("errors")


# ---- Artifacts from results


def artifacts(results: DataFrame, manifest: Column, keys=("run",)) -> DataFrame:
    """(manifest, summary, results): run artifacts of scored cases, with the columns of scoring.combine() and `checks` (an array).

    manifest: the manifest of a run, from its keys; the comparable key and the expected ids (those of the cases) are added.
    """
    dims = lambda make: F.struct(*(make(d).alias(d) for d in DIMS))
    scored = sum((F.when(F.col(f"score_{d}").isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    det = lambda d: F.struct(F.col(f"score_{d}").alias("score"), F.col(f"pass_{d}").cast("int").alias("pass"), F.col(f"total_{d}").cast("int").alias("total"), F.col(f"crit_{d}").cast("int").alias("critFails"), F.col(f"verdict_{d}").alias("verdict"), F.when(F.col(f"score_{d}").isNotNull(), WEIGHTS[d] / scored).otherwise(0.0).alias("appliedWeight"))
    case = F.struct(F.struct(F.col("case_id").cast("string").alias("id"), F.col("difficulty")).alias("case"), "checks", dims(det).alias("detDims"), F.col("det_overall").alias("detOverall"), F.lit(None).cast(JUDGED).alias("judge"), dims(lambda d: F.col(f"combined_{d}")).alias("combined"), F.col("overall").alias("combinedOverall"), F.col("all_pass").alias("allPass"), F.col("criteria_passed").alias("criteriaPassed"), F.col("criteria_total").alias("criteriaTotal"), "verdict", F.col("cost_usd").alias("costUsd"), F.col("latency_ms").alias("latencyMs"))  # noqa: E501
    sums = summarize(results, keys)
    listed = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("case_id", case.alias("c"))), lambda a, b: F.when(a["case_id"] < b["case_id"], -1).when(a["case_id"] > b["case_id"], 1).otherwise(0)).alias("_cases"))
    summary = F.struct(
        F.col("strict_pass_rate").alias("accuracyRate"), F.col("all_pass_rate").alias("allPassRate"), F.col("all_pass_count").cast("double").alias("allPassCount"), F.col("criterion_pass_rate").alias("criterionPassRate"),
        F.col("criteria_passed").cast("double").alias("criteriaPassed"), F.col("criteria_total").cast("double").alias("criteriaTotal"), F.col("average_overall").alias("averageOverall"), F.col("pass_rate").alias("passRate"),
        F.col("strict_pass_rate").alias("strictPassRate"), F.col("average_latency_ms").cast("double").alias("averageLatencyMs"), F.col("total_cost_usd").alias("totalCostUsd"),
        F.struct(*(F.col(f"n_{v.lower()}").alias(v) for v in VERDICTS)).alias("verdictCounts"), dims(lambda d: F.col(f"average_{d}")).alias("averagePerDim"),
    )
    rows = sums.join(listed, list(keys)).withColumn("m", manifest)
    ids = F.transform("_cases", lambda c: c["c"]["case"]["id"])
    validation = F.struct(F.lit(True).alias("valid"), ids.alias("expectedIds"))
    whole = F.col("m").withField("validation", validation).withField("comparableKey", expected_key(F.col("m")))
    return rows.select(*keys, whole.alias("manifest"), summary.alias("summary"), F.transform("_cases", lambda c: c["c"]).alias("results"))

