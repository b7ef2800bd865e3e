"""A submission evaluated from its predictions to one result for each case: checks, evaluators, scores, verdicts.

The plan is one join of cases with the last prediction of each, projections for checks and evaluators, and one aggregation
of the checks by case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.models import judge_columns
from ..sources.scratch import spread, stored
from . import catalogue, evaluators, pairing, scoring
from .evaluators import CHECK, check
from .scoring import DIMS

# Structural checks that gate a case even where an evaluator scores their dimension.
GATES = r"^(?:C01|C03.*|C04|C08|T-LANG|Q07)$"
EVALUATED = {"QUAL": "quality", "CRIT": "critical", "GUIDE": "guide", "RAG": "retrieval"}


def has_rich_gold() -> Column:
    """The case has something that the evaluators can compare a report with."""
    return (F.size("gold") > 0) | (F.coalesce("reference", F.lit("")) != "") | (F.size("urgent") > 0) | (F.size("expectations") > 0) | (F.coalesce(F.size(F.map_keys("relevance")), F.lit(0)) > 0)


def trusted_latency(reported: Column, fallback: Column) -> Column:
    """What a submission reports of its latency, if it is a finite number from 0 on."""
    infinite = reported.cast("double").isin(float("inf"), float("-inf"))
    return F.when(reported.isNotNull() & ~F.isnan(reported.cast("double")) & ~infinite & (reported >= 0), reported).otherwise(fallback)


def failure_checks(message: Column, dims: tuple[str, ...] = DIMS) -> Column:
    """One failed critical check for each dimension."""
    return F.array(*(check(d, f"operational-failure-{d.lower()}", "Operational failure", "critical", F.lit(False), message) for d in dims)).cast(CHECK)


def merged_checks(dims: tuple[str, ...] = DIMS) -> Column:
    """Structural checks and the evaluators': an evaluator that scores owns its dimension, but for the checks that gate."""
    scores = {d: F.col(f"{p}_score") >= 0 for d, p in EVALUATED.items() if d in dims}
    own = F.concat(*(F.when(on, F.col(f"{EVALUATED[d]}_checks")).otherwise(F.expr(f"cast(array() as {CHECK})")) for d, on in scores.items()))
    owned = lambda c: F.coalesce(*(F.when(c["dim"] == d, on) for d, on in scores.items()), F.lit(False))
    ids = F.transform("_own", lambda c: c["id"])
    kept = F.filter("structural", lambda c: ~owned(c) | ((c["severity"] == "critical") & c["id"].rlike(GATES) & ~F.array_contains(ids, c["id"])))
    return own, F.when(F.col("_rich"), F.concat(kept, F.col("_own"))).otherwise(F.col("structural"))


def structured(cases: DataFrame, dims: tuple[str, ...] = DIMS) -> Iterator[tuple[catalogue.Pack, DataFrame]]:
    """cases (with html) with their structural checks of these dimensions, a stored table for each locale that occurs."""
    # Each step is stored: the next one names its columns many times, and its filters must not be rewritten into their expressions.
    # What joins leave in a few tasks is dealt out first.
    rows = stored(spread(cases.withColumn("html", text.normalize_generated(F.col("html"))), *(["case_id"] if "case_id" in cases.columns else [])))
    # Expressions for a locale take seconds to make, so only the locales that occur are evaluated (an unknown one is an error here).
    there = sorted(r.key for r in rows.select(evaluators.served(catalogue.PACKS).alias("key")).distinct().collect()) if "locale" in rows.columns else []
    some = () if dims == DIMS else (dims,)
    for key in there or ["en-US"]:
        pack = catalogue.PACKS[key]
        yield pack, stored(catalogue.with_checks(rows.where(evaluators.served(catalogue.PACKS) == key), pack, *some))


def checked(cases: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """cases (with html) with all_checks of these dimensions, and the evaluators' scores. failed (optional): an operational failure with its message in failure.

    Guidelines' checks and scores are no other dimension's, so without GUIDE they aren't made."""
    parts = [stored(evaluators.evaluate(evaluators.with_defaults(rows), (pack.words,), "GUIDE" in dims)) for pack, rows in structured(cases, dims)]
    out = reduce(DataFrame.unionByName, parts).withColumn("_rich", has_rich_gold())
    own, merged = merged_checks(dims)
    out = out.withColumn("_own", own).withColumn("all_checks", merged)
    if "failed" in cases.columns:
        message = F.coalesce("failure", F.lit("The evaluated agent did not return a valid report.")) if "failure" in cases.columns else F.lit("The evaluated agent did not return a valid report.")
        failed = F.coalesce("failed", F.lit(False))
        out = out.withColumn("all_checks", F.when(failed, failure_checks(message, dims)).otherwise(F.col("all_checks"))).withColumn("_rich", F.col("_rich") & ~failed)
    return out.drop("_own")


def evaluate_submission(cases: DataFrame, predictions: DataFrame, policy: str = "research") -> DataFrame:
    """One result for each case that has a prediction (the last one by pos counts): scores of dimensions, overall, verdict, gates.

    Metadata of predictions is the submitter's own, so neither its retrieved documents nor its latency are taken.
    """
    last = pairing.latest_predictions(cases.select(F.col("case_id").cast("string").alias("case_id")), predictions).select(F.col("case_id").alias("_id"), F.col("model_output").alias("html"))
    own = cases.drop("html", "retrieved")
    return results(own.join(last, own["case_id"].cast("string") == F.col("_id")).drop("_id"), policy)


def results(reports: DataFrame, policy: str = "research", judgements: DataFrame | None = None, judge_primary: bool = False, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Results of cases with their reports, see evaluate_submission. judgements (optional): case_id and judge (see models.judged).

    dims: the dimensions that are asked for; overall, verdict and gates are over these alone."""
    evaluated = {d: p for d, p in EVALUATED.items() if d in dims}
    # Only what the scores need is stored, not the reports again.
    rows = stored(checked(reports, dims).select("case_id", "_rich", "all_checks", *(f"{p}_{c}" for p in evaluated.values() for c in ("score", "checks"))))
    flat = rows.select(F.lit("run").alias("run"), "case_id", F.inline("all_checks"))
    counts = scoring.case_counts(flat, scoring.KEYS)
    scored = scoring.score_dimensions(counts)
    mine = rows.where("_rich").select(F.lit("run").alias("run"), "case_id", F.inline(F.array(*(given(d, p) for d, p in evaluated.items())))).where("score >= 0")
    scored = scoring.overlay_scores(scored, mine)
    if judgements is None:
        return scoring.combine(scored, policy=scoring.POLICIES[policy])
    told = judgements.select("case_id", "judge").join(scored, "case_id", "right")
    return scoring.combine(told.withColumns(judge_columns(F.col("judge"))).drop("judge"), True, scoring.POLICIES[policy], judge_primary)


def given(dim: str, name: str) -> Column:
    """An evaluator's score with the counts of its own checks."""
    own = F.col(f"{name}_checks")
    n = lambda keep: F.size(F.filter(own, keep))
    failed = lambda severity: n(lambda c: ~c["passed"] & (c["severity"] == severity))
    return F.struct(F.lit(dim).alias("dim"), F.col(f"{name}_score").cast("double").alias("score"), n(lambda c: c["passed"]).alias("pass"), F.size(own).alias("total"), failed("critical").alias("crit"), failed("major").alias("major"))
