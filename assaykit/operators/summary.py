"""Run summaries, their verification, and ranking.

Means of scores are taken over integer tenths: scores have one decimal, so the sums are exact and don't depend on the
order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..sources.scratch import stored, with_position
from .scoring import DIMS

TOLERANCE = 0.11
DIFFICULTIES = ("easy", "medium", "hard")


def tenths(x: Column) -> Column:
    return F.round(x * 10).cast("long")


def mean_of_tenths(x: Column) -> Column:
    """Mean of one-decimal numbers, to one decimal; null without any."""
    return to_fixed(F.sum(tenths(x)).cast("double") / 10.0 / F.count(x), 1)


def rate(condition: Column) -> Column:
    return to_fixed(F.count_if(condition).cast("double") / F.count("*") * 100.0, 1)


def summarize(results: DataFrame, keys=("run",)) -> DataFrame:
    """Counts, rates and means of each run from its case rows; unscored dimensions are left out of their means."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "PARTIAL", "FAIL")),
        mean_of_tenths(F.col("overall")).alias("average_overall"),
        rate(F.col("verdict") != "FAIL").alias("pass_rate"), rate(F.col("verdict") == "PASS").alias("strict_pass_rate"),
        rate(F.col("all_pass")).alias("all_pass_rate"), F.count_if("all_pass").alias("all_pass_count"),
        F.sum("criteria_passed").alias("criteria_passed"), F.sum("criteria_total").alias("criteria_total"),
        F.coalesce(to_fixed(F.sum("criteria_passed").cast("double") / F.nullif(F.sum("criteria_total"), F.lit(0)) * 100.0, 1), F.lit(0.0)).alias("criterion_pass_rate"),
        to_fixed(F.sum("latency_ms") / F.count("*"), 1).alias("average_latency_ms"),
        to_fixed(F.sum(F.round(F.col("cost_usd") * 1e6).cast("long")).cast("double") / 1e6, 6).alias("total_cost_usd"),
        *(mean_of_tenths(F.col(f"combined_{d}")).alias(f"average_{d}") for d in DIMS),
    )


def by_difficulty(results: DataFrame, keys=("run",)) -> DataFrame:
    """The same rates for each difficulty; cases without one are left out."""
    return results.where(F.col("difficulty").isin(*DIFFICULTIES)).groupBy(*keys, "difficulty").agg(
        F.count("*").alias("case_count"), rate(F.col("all_pass")).alias("all_pass_rate"),
        to_fixed(F.sum("criteria_passed").cast("double") / F.sum("criteria_total") * 100.0, 1).alias("criterion_pass_rate"),
        mean_of_tenths(F.col("overall")).alias("average_overall"), rate(F.col("verdict") != "FAIL").alias("pass_rate"), rate(F.col("verdict") == "PASS").alias("strict_pass_rate"),
    )


def case_mismatches(results: DataFrame, keys=("run", "case_id")) -> DataFrame:
    """(keys, error) where stored_* columns disagree with what the checks give, one row for each error."""
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > TOLERANCE
    errors = F.array_compact(F.array(
        F.when(off("stored_overall", "overall"), F.lit("overall mismatch")),
        F.when(F.col("stored_verdict") != F.col("verdict"), F.lit("verdict mismatch")),
        F.when((F.col("critical_failed") > 0) & (F.col("stored_verdict") != "FAIL"), F.lit("critical failure must fail")),
        F.when(F.col("stored_all_pass") != F.col("all_pass"), F.lit("all_pass mismatch")),
        F.when(F.col("cost_usd") < 0, F.lit("negative cost")), F.when(F.col("latency_ms") < 0, F.lit("negative latency")),
    ))
    return results.select(*keys, F.explode(errors).alias("error"))


def summary_mismatches(stored: DataFrame, derived: DataFrame, keys=("run",)) -> DataFrame:
    """(keys, field, stored, derived) where two summaries differ by more than the tolerance, or only one has a value."""
    fields = [c for c in derived.columns if c not in keys]
    long = lambda df, name: df.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields))))
    both = long(stored, "stored").join(long(derived, "derived"), [*keys, "field"], "full")
    return both.where((F.abs(F.col("stored") - F.col("derived")) > TOLERANCE) | (F.col("stored").isNull() != F.col("derived").isNull()))


def forged_ids(results: DataFrame, expected: DataFrame, keys=("run",)) -> DataFrame:
    """(run, case_id, problem): ids missing from a run, ids that aren't expected, ids that a run has twice."""
    have = results.groupBy(*keys, "case_id").agg(F.count("*").alias("n"))
    want = expected.select(*keys, "case_id").distinct()
    problem = lambda df, text: df.select(*keys, "case_id", F.lit(text).alias("problem"))
    on = [*keys, "case_id"]
    return problem(want.join(have, on, "left_anti"), "missing").union(problem(have.join(want, on, "left_anti"), "extra")).union(problem(have.where("n > 1"), "duplicate"))


ORDER = (
    ("eligible", False), ("all_pass_rate", False), ("criterion_pass_rate", False), ("average_overall", False), ("strict_pass_rate", False),
    ("pass_rate", False), ("total_cost_usd", True), ("average_latency_ms", True),
)


def rank_entries(entries: DataFrame, group: str = "comparable_key", tie: str = "run") -> DataFrame:
    """position in each group, and rank: only eligible entries take ranks, so ineligible ones have none. Ties go by `tie`."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in ORDER] + [F.col(tie).asc()]
    by = Window.partitionBy(group).orderBy(*order)
    return entries.withColumn("position", F.row_number().over(by)).withColumn("rank", F.when(F.col("eligible"), F.col("position")))


def in_groups(ranked: DataFrame, group: str = "comparable_key") -> DataFrame:
    """Ranked entries, groups in the order of the root locale (upper and lower case side by side, accents after plain letters), then by position."""
    return ranked.orderBy(F.collate(F.col(group), "UNICODE"), group, "position")


def comparable_key(*parts: Column) -> Column:
    """Parts joined by '::'; nulls become 'none'."""
    return F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("none")) for p in parts))


def pareto_frontier(entries: DataFrame, cost: str, score: str, tie: str) -> DataFrame:
    """Entries that score above every cheaper one: a running maximum inside each range of costs, above the best of the ranges before."""
    parts = stored(entries.repartitionByRange(F.col(cost).asc(), F.col(tie).asc()).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(F.col(cost).asc(), F.col(tie).asc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy("_part").agg(F.max(score).alias("_top"))  # a row for each part
    before = tops.withColumn("_floor", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_floor")
    rated = parts.withColumn("_best", F.max(score).over(inside)).join(F.broadcast(before), "_part").withColumn("_best", F.greatest("_best", "_floor"))
    return rated.where(F.col("_best").isNull() | (F.col(score) > F.col("_best"))).select(*entries.columns)


def board_group(system_type: Column, entity_type: Column, track: Column, entity_name: Column) -> Column:
    """calibration before model before production."""
    fixture = (system_type == "mini-agent") | F.coalesce(entity_name, F.lit("")).rlike("(?i)baseline|fixture|mock")
    model = (system_type == "raw-model") | (entity_type == "model") | (track == "model")
    return F.when(fixture, "calibration").when(model, "model").otherwise("production")


def board_order(entries: DataFrame, tie: str = "run") -> DataFrame:
    """position over all groups: production first, then models, then calibration; inside by score, criteria, all-pass."""
    place = F.when(F.col("board_group") == "production", 0).when(F.col("board_group") == "model", 1).otherwise(2)
    placed = with_position(entries.withColumn("_place", place), F.col("_place").asc(), F.desc("average_overall"), F.desc("criterion_pass_rate"), F.desc("all_pass_rate"), F.col(tie).asc(), name="position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).select(*entries.columns, "position")
