"""Joins of cases, predictions and runs: validation, comparison, strata of failed checks, reliability over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed

# ---- Submissions


def missing_ids(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases without a prediction."""
    return expected.join(predictions.select(F.col("instance_id").alias("case_id")), "case_id", "left_anti")


def extra_rows(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions without a case, row by row (repeated ones stay)."""
    return predictions.join(expected.select(F.col("case_id").alias("instance_id")), "instance_id", "left_anti")


def duplicate_ids(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("instance_id").agg(F.count("*").alias("n")).where("n > 1")


def empty_outputs(predictions: DataFrame) -> DataFrame:
    """Predictions whose output is null or blank."""
    return predictions.where(F.trim(F.regexp_replace(F.coalesce("model_output", F.lit("")), r"\s+", " ")) == "")


def latest_predictions(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """One prediction for each case: the last in order of pos. The maximum is combined before the shuffle."""
    last = predictions.groupBy("instance_id").agg(F.max(F.struct("pos", "model_output")).alias("x"))
    return expected.join(last.withColumnRenamed("instance_id", "case_id"), "case_id").select("case_id", "x.pos", "x.model_output")


def validation(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts of everything that makes a submission invalid, and whether it is valid: one aggregation by id, then one of its counts."""
    blank = F.trim(F.regexp_replace(F.coalesce("model_output", F.lit("")), r"\s+", " ")) == ""
    sides = predictions.select("instance_id", F.lit(0).alias("e"), F.lit(1).alias("p"), blank.cast("int").alias("b"))
    sides = sides.union(expected.select("case_id", F.lit(1), F.lit(0), F.lit(0)))
    by_id = sides.groupBy("instance_id").agg(*(F.sum(c).alias(c) for c in "epb"))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    sums = by_id.agg(
        total("e", "expected"), total("p", "received"), total(F.when(F.col("p") == 0, F.col("e")), "missing"), total(F.when(F.col("e") == 0, F.col("p")), "extra"),
        F.count_if(F.col("p") > 1).alias("duplicates"), total("b", "empty_outputs"),
    )
    return sums.withColumn("valid", F.expr("missing + extra + duplicates + empty_outputs = 0"))


# ---- Comparison of two runs


def align(a: DataFrame, b: DataFrame, columns: list[str], key: str = "case_id") -> DataFrame:
    """Cases that both runs have, with a_ and b_ columns."""
    side = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return side(a, "a").join(side(b, "b"), key)


def compare(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """Differences of two runs by case. key: the column that says what a run is comparable with; other keys are an error."""
    if key is not None:
        keys = [{r[0] for r in df.select(key).distinct().limit(3).collect()} for df in (a, b)]
        if len(keys[0] | keys[1]) > 1:
            raise ValueError(f"runs are not comparable: {sorted(map(str, keys[0]))} and {sorted(map(str, keys[1]))}")
    return align(a, b, ["overall", "verdict"]).withColumn("delta", to_fixed(F.col("a_overall") - F.col("b_overall"), 1))


# ---- Strata of failed checks
# Strata in order of precedence, patterns on "id:name:evidence"; weights of severities.
STRATA = [
    ("critical_finding", "CRIT", r"(?i)critical|critico|missed critical|^QG02\b|^CG\d", False),
    ("evidence_fidelity", "RAG", r"(?i)unsupported|^R\d|evidence|fidelity|invent", False),
    ("copy_synthesis", None, r"(?i)^QG0[67]\b|synthesizes|principal finding|principalCovered|copiedOutputRatio|copy", False),
    ("guideline", None, r"(?i)^GE-|^TC\d|BI-?RADS|TI-?RADS|Fleischner|Lung-RADS|guideline", False),
    ("terminology", "TERM", r"(?i)^T\d|terminology|termo", False),
    ("measurement_laterality", None, r"(?i)measurement|measure|laterality|lateralidade|^QG04\b|^QG05\b|^R02\b", False),
    ("anatomic_coverage", "GUIDE", r"(?i)^G\d\d\b|Anatomical coverage|missing:", True),
    ("report_quality", "QUAL", r"(?i)Q\d|quality|impression|hallucination", False),
]
SEVERITY_WEIGHT = {"critical": 4.0, "major": 2.0, "minor": 1.0, "incidental": 0.5}


def failed_issues(checks: DataFrame) -> DataFrame:
    """Failed checks with a signature; missing parts have defaults."""
    part = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return checks.where(~F.col("passed")).withColumns({
        "signature": F.concat_ws(":", part("id", "unknown"), part("name", ""), part("evidence", "")),
        "weight": F.coalesce(*(F.when(F.col("severity") == s, F.lit(w)) for s, w in SEVERITY_WEIGHT.items()), F.lit(1.0)),
    })


def stratum() -> Column:
    """The first stratum that holds: by dimension or by pattern, or by both for the anatomic one. The last looks at the dimension too."""
    out = F
    for name, dim, pattern, both in STRATA:
        text = F.concat_ws(":", "dim", "signature") if name == "report_quality" else F.col("signature")
        by_text = text.rlike(pattern)
        test = by_text if dim is None else (F.col("dim") == dim) & by_text if both else (F.col("dim") == dim) | by_text
        out = out.when(test, name)
    return out.otherwise("other")


def adjudication(audit: bool = False) -> Column:
    """system_error, evaluator_limitation or review_needed, by ordered rules on evidence and the folded text of the report.

    audit: the rules of the audit, where an operational failure comes first and a complete miss needs review as well.
    """
    evidence = F.lower(F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " ")))
    text = F.regexp_replace("report", ",", ".")
    five = text.rlike(r"\b5\s*mm\b") | text.rlike(r"\b0\.5\s*cm\b")
    got = [F.regexp_extract(evidence, r"exact=(\d+)\s+partial=(\d+)\s+missed=(\d+)\s+total=(\d+)", k) for k in range(1, 5)]
    whole = (got[3] != "") & (got[3] != "0") & (got[0] == "0") & (got[1] == "0") & (got[2] == got[3])
    out = F.when(F.lit(audit) & F.col("id").startswith("operational-failure"), "system_error").when(evidence == "ok", "evaluator_limitation")
    out = out.when(evidence.rlike("bi-?rads not mentioned") & F.col("report").rlike(r"bi[\s.\-]?rads"), "evaluator_limitation")
    out = out.when(F.col("id").isin("QG04", "R04") & evidence.rlike(r"5\s*mm") & five, "evaluator_limitation")
    out = out.when((F.col("id") == "QG05") & F.col("report").rlike("joelho esquerdo|knee left|left knee"), "evaluator_limitation")
    missed = (F.col("id") == "QG01") & evidence.rlike(r"missed=\d+")
    return out.when(missed & F.lit(not audit) & whole, "system_error").when(missed, "review_needed").otherwise("system_error")


def strata_by_case(issues: DataFrame) -> DataFrame:
    """One row for each case and stratum, with counts and weights of side a and b. Issues: case_id, side, stratum, adjudication, weight."""
    aggs = []
    for s in ("a", "b"):
        own = F.col("side") == s
        system = own & (F.col("adjudication") == "system_error")
        aggs += [
            F.count_if(own).alias(f"{s}_n"), F.count_if(system).alias(f"{s}_system"), F.count_if(own & (F.col("adjudication") == "evaluator_limitation")).alias(f"{s}_limits"),
            F.count_if(own & (F.col("adjudication") == "review_needed")).alias(f"{s}_review"), F.sum(F.when(own, F.col("weight")).otherwise(0.0)).alias(f"{s}_w"),
            F.sum(F.when(system, F.col("weight")).otherwise(0.0)).alias(f"{s}_sw"),
        ]
    return issues.groupBy("case_id", "stratum").agg(*aggs)


def strata_comparison(by_case: DataFrame) -> DataFrame:
    """Totals of each stratum. Excess is what one side has more than the other in a case, summed over cases."""
    more = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    aggs = []
    for s, o in (("a", "b"), ("b", "a")):
        aggs += [
            F.sum(f"{s}_n").alias(f"{s}_failures"), F.sum(f"{s}_system").alias(f"{s}_system_failures"), F.sum(f"{s}_limits").alias(f"{s}_limitations"), F.sum(f"{s}_review").alias(f"{s}_review_needed"),
            F.sum(f"{s}_w").alias(f"{s}_weighted"), F.sum(f"{s}_sw").alias(f"{s}_system_weighted"), F.count_if(F.col(f"{s}_n") > 0).alias(f"{s}_cases"),
            more(f"{s}_n", f"{o}_n").alias(f"{s}_excess"), more(f"{s}_w", f"{o}_w").alias(f"{s}_excess_weighted"),
            F.count_if((F.col(f"{s}_n") > 0) & (F.col(f"{o}_n") == 0)).alias(f"{s}_only"), F.count_if(F.col(f"{s}_sw") > F.col(f"{o}_sw")).alias(f"{s}_excess_cases"),
        ]
    return by_case.groupBy("stratum").agg(*aggs, F.count_if((F.col("a_n") > 0) & (F.col("b_n") > 0)).alias("shared"))


def audit_totals(issues: DataFrame, keys=("run", "stratum")) -> DataFrame:
    system = F.col("adjudication") == "system_error"
    return issues.groupBy(*keys).agg(
        F.count("*").alias("failed_checks"), F.count_if(system).alias("system_errors"), F.count_if(F.col("adjudication") == "evaluator_limitation").alias("evaluator_limitations"),
        F.count_if(F.col("adjudication") == "review_needed").alias("review_needed"), F.sum(F.when(system, F.col("weight")).otherwise(0.0)).alias("system_weight"), F.sum("weight").alias("raw_weight"),
    )


# Prefixes of check ids by failure category.
TAXONOMY = {
    "HALLUCINATION": {"contrast_hallucination": ["C01"], "laterality_confusion": ["R02"]},
    "CLINICAL_SAFETY": {"umbrella_phrase": ["C02", "C05", "C08"], "normal_conclusion_abnormal": ["C06"]},
    "STRUCTURAL": {"format_violation": ["C04", "Q03", "Q04", "Q06", "Q07", "Q09"], "title_error": ["Q01", "Q02", "R01"], "missing_section": ["Q05", "Q08", "Q11"], "section_duplication": ["Q10"]},
    "COVERAGE": {"incomplete_findings": ["C07", "R04", "R05"], "lost_laterality": ["R03"]},
}


def taxonomy() -> Column:
    """(category, subcategory) of a failed check, null where none holds."""
    pair = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("subcategory"))
    out, prefix, said = F, F.substring("id", 1, 3), F.lower(F.concat_ws(" ", "name", "evidence"))
    for category, subs in TAXONOMY.items():
        for sub, ids in subs.items():
            out = out.when(prefix.isin(*ids), pair(category, sub))
    term = F.col("id").startswith("T") & (F.col("dim") == "TERM")
    out = out.when(term & said.contains("opener"), pair("TERMINOLOGY", "forbidden_opener")).when(term & F.lower("name").rlike("modality|vocabulary"), pair("TERMINOLOGY", "crossmodality_vocab"))
    return out.when(term, pair("TERMINOLOGY", "forbidden_term")).when(F.col("id").startswith("G") & (F.col("dim") == "GUIDE"), pair("COVERAGE", "missing_anatomy"))


def detection_counts(evidence: Column) -> Column:
    """(exact, partial, missed, total) that the evidence of a detection rate states, or null."""
    pattern = r"(?i)exact=(\d+)\s+partial=(\d+)\s+missed=(\d+)\s+total=(\d+)"
    part = lambda k: F.regexp_extract(evidence, pattern, k).cast("int")
    return F.when(evidence.rlike(pattern), F.struct(part(1).alias("exact"), part(2).alias("partial"), part(3).alias("missed"), part(4).alias("total")))


# ---- Reliability over k runs


def case_reliability(results: DataFrame) -> DataFrame:
    """Runs of each case, in how many it was safe, in how many it passed. results: run, case_id, safe, verdict."""
    return results.groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if("safe").alias("safe_runs"), F.count_if(F.col("verdict") != "FAIL").alias("passed_runs"))


def pass_power_k(per_case: DataFrame, k: int) -> DataFrame:
    """Shares of cases that hold in all k runs, and mean shares in one run. Cases without all k runs are counted apart."""
    have = F.col("runs") == k
    n = F.count_if(have)
    share = lambda x: to_fixed(x.cast("double") / F.nullif(n, F.lit(0)), 4)
    return per_case.agg(
        F.lit(k).alias("k"), n.alias("case_count"), F.count_if(~have).alias("incomplete_cases"),
        share(F.count_if(have & (F.col("safe_runs") == k))).alias("pass_power_k_safe"), share(F.sum(F.when(have, F.col("safe_runs"))) / F.lit(float(k))).alias("pass_at_1_safe"),
        share(F.count_if(have & (F.col("passed_runs") == k))).alias("pass_power_k_verdict"), share(F.sum(F.when(have, F.col("passed_runs"))) / F.lit(float(k))).alias("pass_at_1_verdict"),
    )


def flaky_cases(per_case: DataFrame, k: int) -> DataFrame:
    return per_case.where((F.col("runs") == k) & (F.col("safe_runs") > 0) & (F.col("safe_runs") < k))
