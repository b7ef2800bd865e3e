"""Scoring of checks: one row for each case, with the dimensions as columns, from one aggregation.

A check is (keys, dim, severity, passed). All counts a case needs come from one conditional aggregation, so checks are
shuffled once whatever is derived later; scores, verdicts, weights and gates are expressions on the wide row.
A dimension without checks is unscored: its score is null and its weight goes to the scored ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import bound, to_fixed

# Dimensions, weights, thresholds.
DIMS = ("CRIT", "QUAL", "TERM", "GUIDE", "RAG")
WEIGHTS = {"CRIT": 0.30, "QUAL": 0.25, "TERM": 0.20, "GUIDE": 0.15, "RAG": 0.10}
CLINICAL = ("CRIT", "QUAL")
KEYS = ("run", "case_id")


@dataclass(frozen=True)
class Policy:
    name: str
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    pass_at: float = 84.0
    partial_at: float = 60.0
    critical_forces_fail: bool = True

    def share(self, dim: str) -> float:
        return self.weights[dim] / sum(self.weights.values())


# The three profiles.
POLICIES = {
    "strict": Policy("strict", {"CRIT": 0.35, "QUAL": 0.25, "TERM": 0.15, "GUIDE": 0.15, "RAG": 0.10}, 90.0, 70.0),
    "research": Policy("research"),
    "leaderboard": Policy("leaderboard"),
}


def policy_profiles(spark) -> DataFrame:
    """The profiles as a table, weights normalised."""
    rows = [(p.name, p.pass_at, p.partial_at, p.critical_forces_fail, *(p.share(d) for d in DIMS)) for p in POLICIES.values()]
    return spark.createDataFrame(rows, "policy string, pass_at double, partial_at double, critical_forces_fail boolean, " + ", ".join(f"w_{d} double" for d in DIMS))


def criterion_stats(checks: DataFrame, keys=KEYS) -> DataFrame:
    """Passed and all checks of each case; all_pass needs one check at least."""
    return checks.groupBy(*keys).agg(
        F.count_if("passed").alias("criteria_passed"), F.count("*").alias("criteria_total"), F.bool_and("passed").alias("all_pass")
    )


def case_counts(checks: DataFrame, keys=KEYS, *more: Column) -> DataFrame:
    """Counts of each case by dimension, in one aggregation; `more` are further aggregates."""
    failed = ~F.col("passed")
    per = []
    for d in DIMS:
        own = F.col("dim") == d
        per += [
            F.count_if(own & F.col("passed")).alias(f"pass_{d}"), F.count_if(own).alias(f"total_{d}"),
            F.count_if(own & failed & (F.col("severity") == "critical")).alias(f"crit_{d}"),
            F.count_if(own & failed & (F.col("severity") == "major")).alias(f"major_{d}"),
        ]
    return checks.groupBy(*keys).agg(
        *per, F.count_if("passed").alias("criteria_passed"), F.count("*").alias("criteria_total"), F.bool_and("passed").alias("all_pass"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical_failed"),
        F.count_if(failed & (F.col("severity") == "major")).alias("major_failed"), *more,
    )


def capped(score: Column, crit: Column, major: Column) -> Column:
    """Critical failures cap a dimension at 60, 40, 20; three major ones at 70."""
    by_crit = F.greatest(F.lit(20.0), F.lit(60.0) - F.least(crit - 1, F.lit(2)) * 20.0)
    return F.when(crit > 0, F.least(score, by_crit)).when(major >= 3, F.least(score, F.lit(70.0))).otherwise(score)


def share(passed: Column, total: Column, crit: Column, major: Column) -> Column:
    """Score of a dimension by its checks; null without any."""
    return F.when(total > 0, capped(to_fixed(passed.cast("double") / total * 100.0, 1), crit, major))


def given(e: Column) -> Column:
    """Score of a dimension that an evaluator gives. e: score, crit, major."""
    return capped(to_fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), e["score"])), 1), e["crit"], e["major"])


def weighted(score: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the scored dimensions, weights renormalised; summed in the fixed order, so both engines agree to the bit."""
    total = F.lit(0.0)
    for d in DIMS:
        total = total + F.when(score[d].isNotNull(), F.lit(weights[d])).otherwise(F.lit(0.0))

    def mean(total: Column) -> Column:
        overall = F.lit(0.0)
        for d in DIMS:
            overall = overall + F.coalesce(score[d] * (F.lit(weights[d]) / total), F.lit(0.0))
        return overall

    return bound(F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)), mean)


def score_dimensions(counts: DataFrame) -> DataFrame:
    """score_, verdict_ for each dimension, and the deterministic overall."""
    out = counts
    for d in DIMS:
        out = out.withColumn(f"score_{d}", share(*(F.col(f"{k}_{d}") for k in ("pass", "total", "crit", "major"))))
    verdicts = {}
    for d in DIMS:
        s = F.col(f"score_{d}")
        verdicts[f"verdict_{d}"] = (
            F.when(s.isNull(), "UNSCORED").when(F.col(f"crit_{d}") > 0, "FAIL").when(F.col(f"pass_{d}") == F.col(f"total_{d}"), "PASS").when(s >= 80, "PARTIAL").otherwise("FAIL")
        )
    return out.withColumns(verdicts | {"det_raw": weighted({d: F.col(f"score_{d}") for d in DIMS}, WEIGHTS)}).withColumn("det_overall", to_fixed(F.col("det_raw"), 1)).drop("det_raw")


def overlay_scores(scored: DataFrame, evaluator: DataFrame, keys=KEYS) -> DataFrame:
    """Scores that evaluators give directly replace a dimension's own; their verdict ladder is another one.

    evaluator: keys, dim, score (null: unscored), pass, total, crit, major.
    """
    wide = evaluator.where(F.col("score").isNotNull()).groupBy(*keys).agg(
        *(F.max(F.when(F.col("dim") == d, F.struct("score", "pass", "total", "crit", "major"))).alias(f"eval_{d}") for d in DIMS)
    )
    out = scored.join(wide, list(keys), "left")
    new = {}
    for d in DIMS:
        e = F.col(f"eval_{d}")
        own = given(e)
        ladder = F.when(e["crit"] > 0, "FAIL").when(own >= 80, F.when(e["pass"] == e["total"], "PASS").otherwise("PARTIAL")).when(own >= 50, "PARTIAL").otherwise("FAIL")
        new |= {f"score_{d}": F.when(e.isNull(), F.col(f"score_{d}")).otherwise(own), f"verdict_{d}": F.when(e.isNull(), F.col(f"verdict_{d}")).otherwise(ladder)}
        for k in ("pass", "total", "crit"):
            new[f"{k}_{d}"] = F.when(e.isNull(), F.col(f"{k}_{d}")).otherwise(e[k])
    out = out.withColumns(new).drop(*(f"eval_{d}" for d in DIMS))
    return out.withColumn("det_overall", to_fixed(weighted({d: F.col(f"score_{d}") for d in DIMS}, WEIGHTS), 1))


def dim_rows(scored: DataFrame, keys=KEYS) -> DataFrame:
    """One row for each dimension: the long form, with the applied weight."""
    total = sum((F.when(F.col(f"score_{d}").isNotNull(), F.lit(WEIGHTS[d])).otherwise(F.lit(0.0)) for d in DIMS), F.lit(0.0))
    rows = F.array(*(
        F.struct(
            F.lit(d).alias("dim"), F.col(f"score_{d}").alias("score"), F.col(f"pass_{d}").alias("pass"), F.col(f"total_{d}").alias("total"),
            F.col(f"crit_{d}").alias("crit_fails"), F.col(f"verdict_{d}").alias("verdict"),
            F.when(F.col(f"score_{d}").isNotNull(), F.lit(WEIGHTS[d]) / F.col("_w")).otherwise(F.lit(0.0)).alias("applied_weight"),
        ) for d in DIMS
    ))
    return scored.withColumn("_w", total).select(*keys, F.inline(rows))


def severity_cap(critical: Column, major: Column) -> Column:
    """Highest overall that failed checks allow; null if none failed severely."""
    weight = critical * 4 + major * 2
    return F.when(critical > 0, F.lit(59.9)).when(weight > 0, to_fixed(F.greatest(F.lit(0.0), F.lit(99.9) - weight.cast("double") * 4.0), 1))


JUDGE = (*(f"judge_{d}" for d in DIMS), "judge_overall", "judge_critical", "judge_missing", "judge_hallucinated")


def combine(scored: DataFrame, judged: bool = False, policy: Policy = POLICIES["research"], judge_primary: bool | Column = False) -> DataFrame:
    """combined_ for each dimension, overall, verdict, confidence, phase and gates.

    judged: the rows have the columns JUDGE and `has_judge`. judge_primary: for all rows, or by row. Gates apply in a fixed order to the overall before rounding:
    the cap of failed checks, a failed dimension, no clinical dimension, a weak clinical dimension.
    """
    none = F.lit(None).cast("double")
    judge = {d: F.col(f"judge_{d}") if judged else none for d in DIMS}
    has = F.col("has_judge") if judged else F.lit(False)
    judge_critical = F.coalesce(F.col("judge_critical"), F.lit(0)) if judged else F.lit(0)
    given = F.filter(F.array(*judge.values(), F.col("judge_overall") if judged else none), lambda x: x.isNotNull() & ~F.isnan(x))
    likert = (F.size(given) > 0) & F.forall(given, lambda x: x <= 5)
    out = scored.withColumn("_likert", likert)
    new = {}
    for d in DIMS:
        s, j = F.col(f"score_{d}"), F.when(F.isnan(judge[d]), none).otherwise(judge[d])
        hundred = to_fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), j * F.when(F.col("_likert"), 20.0).otherwise(1.0))), 1)
        both = F.least(s, hundred)
        if d not in CLINICAL and judge_primary is not False:
            both = hundred if judge_primary is True else F.when(judge_primary, hundred).otherwise(both)
        new[f"combined_{d}"] = F.when(s.isNull(), none).when(j.isNull(), s).otherwise(both)
    out = out.withColumns(new)
    combined = {d: F.col(f"combined_{d}") for d in DIMS}
    weights = {d: policy.share(d) for d in DIMS}
    below = F.lit(round(policy.pass_at - 0.1, 1))
    n_crit = F.col("critical_failed") + judge_critical
    out = out.withColumns({"_o0": weighted(combined, weights), "_cap": severity_cap(n_crit, F.col("major_failed"))})
    g1 = F.col("_cap").isNotNull() & (F.col("_o0") > F.col("_cap"))
    out = out.withColumns({"_g1": g1, "_o1": F.when(g1, F.col("_cap")).otherwise(F.col("_o0"))})
    failed_dim = F.array_contains(F.array(*(F.col(f"verdict_{d}") for d in DIMS)), "FAIL")
    out = out.withColumn("_g2", failed_dim & (F.col("_o1") >= policy.pass_at)).withColumn("_o2", F.when(F.col("_g2"), below).otherwise(F.col("_o1")))
    scored_any = combined["CRIT"].isNotNull() | combined["QUAL"].isNotNull()
    out = out.withColumn("_g3", ~scored_any & (F.col("_o2") >= policy.pass_at)).withColumn("_o3", F.when(F.col("_g3"), below).otherwise(F.col("_o2")))
    weak = F.filter(F.array(*(F.when(combined[d] < policy.pass_at, F.lit(d)) for d in CLINICAL)), lambda x: x.isNotNull())
    out = out.withColumn("_weak", weak).withColumn("_g4", (F.size("_weak") > 0) & (F.col("_o3") >= policy.pass_at)).withColumn("_o4", F.when(F.col("_g4"), below).otherwise(F.col("_o3")))
    det_critical, judge_fails, o = F.col("critical_failed") > 0, judge_critical > 0, F.col("_o4")
    reasons = F.array_compact(F.array(
        F.when(F.col("_g1"), F.when(n_crit > 0, F.lit("cap: critical failure")).otherwise(F.concat(F.lit("cap: severe weight "), (n_crit * 4 + F.col("major_failed") * 2).cast("string")))),
        F.when(F.col("_g2"), F.lit("cap: failed dimension")), F.when(F.col("_g3"), F.lit("no clinical dimension scored")),
        F.when(F.col("_g4"), F.concat(F.lit("weak clinical: "), F.array_join("_weak", "/"))),
        F.when(det_critical, F.lit("critical check failed")), F.when(judge_fails, F.lit("judge found critical failure")),
    ))
    forced = F.lit(policy.critical_forces_fail) & (det_critical | judge_fails)
    out = out.withColumns({
        "overall": to_fixed(o, 1), "gate_reasons": reasons, "phase": F.when(has, "complete").otherwise("degraded"),
        "verdict": F.when(forced, "FAIL").when(o >= policy.pass_at, "PASS").when(o >= policy.partial_at, "PARTIAL").otherwise("FAIL"),
    })
    doubts = (F.coalesce(F.col("judge_missing"), F.lit(0)) + F.coalesce(F.col("judge_hallucinated"), F.lit(0)) > 0) if judged else F.lit(False)
    confidence = (
        F.when(~has & (o >= 80) & ~det_critical, "medium").when(~has, "low").when(doubts | (o < policy.pass_at) | (F.size("gate_reasons") > 0), "medium").otherwise("high")
    )
    return out.withColumn("confidence", confidence).drop("_likert", "_o0", "_o1", "_o2", "_o3", "_o4", "_cap", "_g1", "_g2", "_g3", "_g4", "_weak")


def critical_safe(judge_critical: Column | int = 0) -> Column:
    """No critical failure in checks, dimension or judgement. judge_critical: the number that the judge named."""
    return (F.col("crit_CRIT") == 0) & (F.col("critical_failed") == 0) & (F.coalesce(F.lit(judge_critical), F.lit(0)) == 0)
