"""Records of human adjudication: validation, agreement, and how cases are covered.

records: one row for each record with schema_version, suite_id, suite_hash, locked_at, case_ids, adjudicators and cases
(array of case_id, reviewed: map of field to boolean, labels: array of reviewer, acceptable, verdicts: map, notes, signed_at).
A record is one reviewed suite, so its arrays are bounded by the suite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import let
from ..functions.text import phi_risk
from .scoring import DIMS

# What reviewers must have looked at, the verdicts, and the least agreement in percent.
REVIEWED = ("goldFindingsReviewed", "criticalFindingsReviewed", "guidelineExpectationsReviewed", "polarityReviewed", "lateralityReviewed", "measurementsReviewed", "criticalResultPolicyReviewed")
VERDICTS = ("PASS", "PARTIAL", "FAIL")
LEAST_CLINICAL, LEAST_DIMENSION = 80.0, 70.0
LABEL = "struct<reviewer:string,acceptable:boolean,verdicts:map<string,string>,notes:string,signed_at:string>"
SCHEMA = f"schema_version string, suite_id string, suite_hash string, locked_at string, case_ids array<string>, adjudicators array<string>, cases array<struct<case_id:string,reviewed:map<string,boolean>,labels:array<{LABEL}>>>"
ERRORS = "cast(array() as array<string>)"


def is_iso(x: Column) -> Column:
    """A timestamp that can be read, with a date and a T."""
    return F.coalesce(F.try_to_timestamp(x).isNotNull() & x.rlike(r"\d{4}-\d{2}-\d{2}T"), F.lit(False))


def _error(when: Column, message) -> Column:
    return F.when(F.coalesce(when, F.lit(True)), message if isinstance(message, Column) else F.lit(message))


def _text(*parts) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("undefined")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _same(values: Column) -> Column:
    return let(values, lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.eqNullSafe(F.get(v, F.lit(0)))))


def _label_errors(case_id: Column, labels: Column, known: Column) -> Column:
    def of(x: Column, i: Column) -> Column:
        who = _text(case_id, "/", x["reviewer"])
        found = [
            _error(~F.array_contains(known, x["reviewer"]), _text(case_id, ": unknown reviewerId ", x["reviewer"])),
            _error(F.array_position(F.transform(labels, lambda y: y["reviewer"]), x["reviewer"]) != i + 1, _text(case_id, ": duplicate reviewerId ", x["reviewer"])),
            _error(~is_iso(x["signed_at"]), F.concat(who, F.lit(": signedAt must be an ISO timestamp"))),
            _error(phi_risk(F.coalesce(x["notes"], F.lit(""))), F.concat(who, F.lit(": reviewer notes contain PHI/PII-like text"))),
            *(_error(~F.coalesce(x["verdicts"][d].isin(*VERDICTS), F.lit(False)), F.concat(who, F.lit(f": invalid {d} verdict"))) for d in DIMS),
        ]
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(labels, of))


def validated(records: DataFrame, suite_id: str | None = None, suite_hash: str | None = None) -> DataFrame:
    """records with errors, valid, reviewer_count, case_count, clinical_agreement and dimension_agreement (percent, one decimal)."""
    c = F.col
    ids, known = F.coalesce("case_ids", F.expr(ERRORS)), F.array_distinct(F.coalesce("adjudicators", F.expr(ERRORS)))
    rows = records.withColumns({"_ids": ids, "_known": known})
    # The last of several cases with one id counts.
    safe = lambda i: F.try_element_at(F.filter(F.coalesce("cases", F.array().cast(records.schema["cases"].dataType)), lambda x: x["case_id"] == i), F.lit(-1))
    rows = rows.withColumn("_cases", F.transform("_ids", lambda i: F.struct(i.alias("id"), safe(i).alias("x"))))

    def case_errors(k: Column) -> Column:
        x, labels = k["x"], F.coalesce(k["x"]["labels"], F.expr(f"cast(array() as array<{LABEL}>)"))
        unseen = F.array_compact(F.array(*(_error(~F.coalesce(x["reviewed"][f], F.lit(False)), _text(k["id"], f": {f} must be true")) for f in REVIEWED)))
        few = F.array(_text(k["id"], ": at least two reviewerLabels are required"))
        return F.when(x.isNull(), F.array(_text("missing adjudication case: ", k["id"]))).otherwise(F.concat(unseen, F.when(F.size(labels) < 2, few).otherwise(_label_errors(k["id"], labels, c("_known")))))

    judged = F.filter("_cases", lambda k: F.size(F.coalesce(k["x"]["labels"], F.expr(f"cast(array() as array<{LABEL}>)"))) >= 2)
    rows = rows.withColumns({"_each": F.flatten(F.transform("_cases", case_errors)), "_judged": judged})
    agreed = F.size(F.filter("_judged", lambda k: _same(F.transform(k["x"]["labels"], lambda y: y["acceptable"]))))
    dims = F.aggregate("_judged", F.lit(0), lambda acc, k: acc + sum((_same(F.transform(k["x"]["labels"], _verdict(d))).cast("int") for d in DIMS), F.lit(0)))
    percent = lambda part, whole: F.when(whole == 0, 0.0).otherwise(F.floor(F.try_divide(part.cast("double"), whole) * 1000 + 0.5) / 10.0)
    rows = rows.withColumns({"reviewer_count": F.size("_known"), "case_count": F.size("_ids"), "clinical_agreement": percent(agreed, F.size("_judged")), "dimension_agreement": percent(dims, F.size("_judged") * len(DIMS))})
    blank = lambda x: F.coalesce(x == "", F.lit(True))
    head = F.array_compact(F.array(
        _error(c("schema_version") != "1.0", "schemaVersion must be 1.0"), _error(blank(c("suite_id")), "suiteId is required"), _error(blank(c("suite_hash")), "suiteHash is required"), _error(~is_iso(c("locked_at")), "lockedAt must be an ISO timestamp"),
        *([_error(c("suite_id") != suite_id, _text(f"suiteId mismatch: expected {suite_id}, got ", c("suite_id")))] if suite_id else []),
        *([_error(c("suite_hash") != suite_hash, _text(f"suiteHash mismatch: expected {suite_hash}, got ", c("suite_hash")))] if suite_hash else []),
        _error(F.size("_known") < 2, "at least two adjudicators are required"), _error(F.size("_ids") == 0, "caseIds must not be empty"),
        _error(F.coalesce(F.size("cases"), F.lit(0)) != F.size("_ids"), "cases length must match caseIds length"),
    ))
    tail = F.array_compact(F.array(
        _error(c("clinical_agreement") < LEAST_CLINICAL, _text("clinical acceptability agreement ", c("clinical_agreement").cast("string"), "% is below 80%")),
        _error(c("dimension_agreement") < LEAST_DIMENSION, _text("per-dimension exact agreement ", c("dimension_agreement").cast("string"), "% is below 70%")),
    ))
    out = rows.withColumn("errors", F.concat(head, c("_each"), tail)).withColumn("valid", F.size("errors") == 0)
    return out.drop("_ids", "_known", "_cases", "_each", "_judged")


def _verdict(d: str):
    return lambda y: y["verdicts"][d]


def uncovered(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that no record speaks of."""
    return cases.join(records.select(F.explode("case_ids").alias("case_id")).distinct(), "case_id", "left_anti")
