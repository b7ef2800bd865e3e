"""Calibration of judges: agreement of one judge with itself, of judges with each other, and of judges with checks.

results: run, judge, case_id, overall, verdict, det_overall, judge_overall (null without a judge). All are aggregations
over cases; nothing but one row of figures reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from . import agreement


def pearson(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """r (six decimals) and n over rows that have both; 0 without variance. Sums run over deviations from the means."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = both.agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("a"), F.stddev_pop("y").alias("b"))
    r = F.when((F.col("n") == 0) | (F.coalesce("a", F.lit(0.0)) == 0) | (F.coalesce("b", F.lit(0.0)) == 0), 0.0).otherwise(F.try_divide(F.col("c"), F.col("a") * F.col("b")))
    return sums.select(to_fixed(r, 6).alias("r"), "n")


def score_matrix(results: DataFrame, by: str = "run") -> DataFrame:
    """(unit, rater, value): the mean overall of each case under each run or judge."""
    return results.groupBy(F.col("case_id").alias("unit"), F.col(by).alias("rater")).agg((F.sum(F.round(F.col("overall") * 10)) / F.count("*") / 10.0).alias("value"))


def verdict_pairs(results: DataFrame, a: str, b: str) -> DataFrame:
    """(case_id, a, b): the first verdict of each of two judges on the cases that both have."""
    first = lambda judge, name: results.where(F.col("judge") == judge).groupBy("case_id").agg(F.min_by("verdict", "run").alias(name))
    return first(a, "a").join(first(b, "b"), "case_id")


def det_judge_pairs(results: DataFrame) -> DataFrame:
    """(x, y): overall by checks and by the judge, on one scale."""
    rows = results.select(F.col("det_overall").alias("x"), agreement.judge_to_hundred(F.col("judge_overall")).alias("y"))
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def grade(alpha: Column, rho: Column) -> Column:
    return F.when((alpha >= 0.8) & (rho >= 0.4), "calibrated").when((alpha >= 0.667) & (rho >= 0.2), "weak").otherwise("uncalibrated")


def calibrate(results: DataFrame) -> DataFrame:
    """One row: judges, cases, test_retest_alpha, cross_judge_alpha, cross_judge_kappa (null where they don't apply), spearman, n and verdict.

    Test-retest takes the first judge (by name) with two runs or more; kappa needs exactly two judges.
    """
    runs = [(r.judge, r.runs) for r in results.groupBy("judge").agg(F.count_distinct("run").alias("runs")).orderBy("judge").limit(1000).collect()]
    judges = [j for j, _ in runs]
    repeated = next((j for j, n in runs if n >= 2), None)
    none = results.sparkSession.createDataFrame([(None,)], "v double")
    retest = agreement.krippendorff_alpha(score_matrix(results.where(F.col("judge") == repeated))).select(F.col("alpha").alias("test_retest_alpha")) if repeated else none.toDF("test_retest_alpha")
    cross = agreement.krippendorff_alpha(score_matrix(results, "judge")).select(F.col("alpha").alias("cross_judge_alpha")) if len(judges) >= 2 else none.toDF("cross_judge_alpha")
    kappa = agreement.cohens_kappa(verdict_pairs(results, *judges)).select(F.col("kappa").alias("cross_judge_kappa")) if len(judges) == 2 else none.toDF("cross_judge_kappa")
    rho = agreement.spearman(det_judge_pairs(results)).select(F.col("rho").alias("spearman"), "n")
    cases = results.agg(F.count_distinct("case_id").alias("case_count"))
    row = cases.crossJoin(retest).crossJoin(cross).crossJoin(kappa).crossJoin(rho)  # one row each
    least = F.least(F.coalesce("test_retest_alpha", F.lit(1.0)), F.coalesce("cross_judge_alpha", F.lit(1.0)))
    return row.withColumns({"judges": F.array(*map(F.lit, judges)).cast("array<string>"), "verdict": grade(least, F.col("spearman"))})
