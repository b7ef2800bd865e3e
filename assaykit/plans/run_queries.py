"""Queries on perturbations, judges, adjudication records, the board, and whole submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import to_fixed_sql as fx
from ..operators import adjudication, board, calibration, noticing, robustness, submission
from ..operators.scoring import DIMS
from ..sources import adapters, reports
from ..sources.scratch import stored

from .registry import Registry
from .report_queries import sql

registry = Registry()
add = registry.add

# ---- Perturbations

SIMPLE = {
    "laterality_flip": "replace(regexp_replace(regexp_replace(html, '(?i)\\bright\\b', chr(1), 'g'), '(?i)\\bleft\\b', 'right', 'g'), chr(1), 'left')",
    "negation_drop": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)\\bno\\s+evidence\\s+of\\s+', '', 'g'), '(?i)\\bno\\s+', '', 'g'), '(?i)\\babsence\\s+of\\s+', '', 'g'), '(?i)\\babsent\\s+', '', 'g'), '(?i)\\bnegative\\s+for\\s+', '', 'g'), '(?i)\\bwithout\\s+', '', 'g')",
    "structure_break": "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?(?:center|b)>', '', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '(?i)\\b(?:technique|findings|impression|conclusion):', '', 'g'), '\\s{2,}', ' ', 'g'))",
    "terminology_corrupt": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)\\bhemorrhage\\b', 'bleeding', 'g'), '(?i)\\bnodule\\b', 'spot', 'g'), '(?i)\\bmass\\b', 'lump', 'g'), '(?i)\\bcyst\\b', 'blister', 'g'), '(?i)\\bpneumothorax\\b', 'air around lung', 'g'), '(?i)\\bcontrast\\b', 'dye', 'g')",
}


@add(sql(" UNION ALL ".join(f"SELECT case_id, '{k}' AS kind, {x} AS text FROM reports" for k, x in SIMPLE.items())))
def perturb_reports(spark, sf_dir):
    """Reports changed in the ways that look at the text alone."""
    made = F.array(*(F.struct(F.lit(k).alias("kind"), robustness.perturb(k, F.col("html")).alias("text")) for k in SIMPLE))
    return reports.reports(spark, sf_dir).select("case_id", F.inline(made))


@add()
def perturb_text(spark, sf_dir):
    """Each text-only perturbation of each document: its digest, and whether it changed the text."""
    kinds = ("laterality_flip", "negation_drop", "negation_insert", "measurement_scramble", "terminology_corrupt", "structure_break")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), robustness.perturb(k, F.col("text")).alias("t")) for k in kinds))
    rows = adapters.table(spark, sf_dir, "documents").select("doc_id", "text", F.inline(made))
    return rows.select("doc_id", "kind", F.sha2("t", 256).alias("perturbed_sha256"), (F.col("t") != F.col("text")).alias("changed"))


@add()
def perturbation_matrix(spark, sf_dir):
    """All kinds applied to all cases: how many are applicable."""
    rows = stored(robustness.matrix(reports.cases(spark, sf_dir), applicable_only=True))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@add()
def perturbation_run(spark, sf_dir):
    """Changed reports evaluated like any others, and how often the checks notice, by kind and over all."""
    per_kind = noticing.rates(reports.cases(spark, sf_dir))
    return per_kind.withColumn("verdict", robustness.verdict(F.col("rate")))


@add(f"SELECT p_partkey AS case_id, 'l5' AS level, '{robustness.NULL_REPORT}' AS text FROM part")
def null_controls(spark, sf_dir):
    """The level of the graduated controls that says nothing."""
    return robustness.controls(reports.cases(spark, sf_dir)).where("level = 'l5'").select("case_id", "level", "text")


@add()
def graduated_controls(spark, sf_dir):
    """All levels for all cases: distinct texts of each."""
    return robustness.controls(reports.cases(spark, sf_dir)).groupBy("level", "model").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


# ---- Judges

JUDGED = """j AS (SELECT l_suppkey % 4 AS run, 'judge' || (l_suppkey % 2) AS judge, l_partkey AS case_id, count(*) AS n, floor(avg(l_quantity) * 10 + 0.5) / 10.0 AS overall, floor(avg(l_tax) * 10000 + 0.5) / 10.0 AS det_overall,
  CASE WHEN l_partkey % 3 <> 0 THEN CAST(count(*) % 6 AS DOUBLE) END AS judge_overall, CASE WHEN avg(l_quantity) >= 28 THEN 'PASS' WHEN avg(l_quantity) >= 20 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM lineitem GROUP BY 1, 2, 3)"""


def _judged(spark, sf_dir):
    key = [(F.col("l_suppkey") % 4).alias("run"), F.concat(F.lit("judge"), (F.col("l_suppkey") % 2).cast("string")).alias("judge"), F.col("l_partkey").alias("case_id")]
    # Means of exact decimals, so that both engines round the same numbers.
    q = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")
    t = F.sum(F.col("l_tax").cast("decimal(18,4)")).cast("double") / F.count("*")
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy(*key).agg(F.count("*").alias("n"), q.alias("q"), t.alias("t"))
    return rows.select(
        "run", "judge", "case_id", (F.floor(F.col("q") * 10 + 0.5) / 10.0).alias("overall"), (F.floor(F.col("t") * 10000 + 0.5) / 10.0).alias("det_overall"),
        F.when(F.col("case_id") % 3 != 0, (F.col("n") % 6).cast("double")).alias("judge_overall"), F.when(F.col("q") >= 28, "PASS").when(F.col("q") >= 20, "PARTIAL").otherwise("FAIL").alias("verdict"),
    )


JUDGED = JUDGED.replace("avg(l_quantity)", "(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*))").replace("avg(l_tax)", "(CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*))")


@add(f"WITH {JUDGED} SELECT unit, rater, CAST(sum(round(overall * 10)) AS DOUBLE) / count(*) / 10.0::DOUBLE AS value FROM (SELECT case_id AS unit, judge AS rater, overall FROM j) GROUP BY 1, 2")
def calibration_matrix(spark, sf_dir):
    """Mean overall of each case under each judge."""
    return calibration.score_matrix(_judged(spark, sf_dir), "judge")


@add(f"WITH {JUDGED}, f AS (SELECT case_id, judge, arg_min(verdict, run) AS v FROM j GROUP BY 1, 2) SELECT a.case_id, a.v AS a, b.v AS b FROM f a JOIN f b USING (case_id) WHERE a.judge = 'judge0' AND b.judge = 'judge1'")
def verdict_pairs(spark, sf_dir):
    return calibration.verdict_pairs(_judged(spark, sf_dir), "judge0", "judge1")


@add(f"WITH {JUDGED} SELECT round(coalesce(corr(det_overall, judge_overall * 20), 0), 4) AS r, count(*) AS n FROM j WHERE judge_overall IS NOT NULL")
def pearson_det_judge(spark, sf_dir):
    """Correlation of scores by checks and by the judge, whose values up to 5 are read as a fifth of a hundred."""
    return calibration.pearson(calibration.det_judge_pairs(_judged(spark, sf_dir))).select(F.round("r", 4).alias("r"), "n")


def _alpha_sql(name: str, rows: str) -> str:
    """Steps that end in `name`: the interval alpha (column a) of (unit, value) rows."""
    x = "CAST(round(value * 10) AS BIGINT)"
    return f"""{name}_u AS (SELECT unit, count(*) AS m, sum({x}) AS s, sum({x} * {x}) AS q FROM ({rows}) GROUP BY 1),
{name}_g AS (SELECT m, count(*) AS units, sum(m * q - s * s) AS d, sum(s) AS s, sum(q) AS q FROM {name}_u GROUP BY 1),
{name}_t AS (SELECT CAST(sum(m * units) AS DOUBLE) AS v, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(q) AS DOUBLE) AS q, sum(2.0::DOUBLE * d::DOUBLE / (m - 1)) FILTER (WHERE m > 1) AS num, CAST(sum(m * units) FILTER (WHERE m > 1) AS DOUBLE) AS den FROM {name}_g),
{name}_r AS (SELECT 1 - (num / den) / (2.0::DOUBLE * (v * q - s * s) / (v * (v - 1))) AS raw FROM {name}_t), {name} AS (SELECT {fx("raw", 6)} AS a FROM {name}_r)"""


MEAN = "CAST(sum(round(overall * 10)) AS DOUBLE) / count(*) / 10.0::DOUBLE"
RANKED = "CAST(2 * rank() OVER (ORDER BY {0}) + count(*) OVER (PARTITION BY {0}) - 1 AS BIGINT)"
CALIBRATED = f"""WITH {JUDGED}, {_alpha_sql("retest", f"SELECT case_id AS unit, {MEAN} AS value FROM j WHERE judge = 'judge0' GROUP BY case_id, run")}, {_alpha_sql("crossed", f"SELECT case_id AS unit, {MEAN} AS value FROM j GROUP BY case_id, judge")},
f AS (SELECT case_id, judge, arg_min(verdict, run) AS v FROM j GROUP BY 1, 2), p AS (SELECT a.v AS a, b.v AS b FROM f a JOIN f b USING (case_id) WHERE a.judge = 'judge0' AND b.judge = 'judge1'),
po AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b)::DOUBLE / count(*) AS po FROM p), pe AS (SELECT CAST(sum(na * nb) AS DOUBLE) AS c FROM (SELECT (SELECT count(*) FROM p WHERE a = v) AS na, (SELECT count(*) FROM p WHERE b = v) AS nb FROM (VALUES ('PASS'), ('PARTIAL'), ('FAIL')) c(v))),
kr AS (SELECT (po - c / (n::DOUBLE * n)) / (1 - c / (n::DOUBLE * n)) AS raw FROM po, pe), k AS (SELECT {fx("raw", 6)} AS kappa FROM kr),
ranks AS (SELECT {RANKED.format("det_overall")} AS x, {RANKED.format("judge_overall")} AS y FROM j WHERE judge_overall IS NOT NULL),
sums AS (SELECT count(*) AS n, sum(x) AS a, sum(y) AS b, sum(x * x) AS aa, sum(y * y) AS bb, sum(x * y) AS ab FROM ranks),
rr AS (SELECT n, (n::DOUBLE * ab::DOUBLE - a::DOUBLE * b::DOUBLE) / sqrt((n::DOUBLE * aa::DOUBLE - a::DOUBLE * a::DOUBLE) * (n::DOUBLE * bb::DOUBLE - b::DOUBLE * b::DOUBLE)) AS raw FROM sums), r AS (SELECT {fx("raw", 6)} AS spearman, n FROM rr)
SELECT (SELECT count(DISTINCT case_id) FROM j) AS case_count, retest.a AS test_retest_alpha, crossed.a AS cross_judge_alpha, kappa AS cross_judge_kappa, spearman, n,
  CASE WHEN least(retest.a, crossed.a) >= 0.8 AND spearman >= 0.4 THEN 'calibrated' WHEN least(retest.a, crossed.a) >= 0.667 AND spearman >= 0.2 THEN 'weak' ELSE 'uncalibrated' END AS verdict FROM retest, crossed, k, r"""


@add(CALIBRATED)
def calibration_report(spark, sf_dir):
    """Agreement of two judges with themselves, with each other and with the checks, and the verdict on it."""
    return calibration.calibrate(stored(_judged(spark, sf_dir))).drop("judges")


# ---- Adjudication records: one for each supplier

ADJUDICATED = f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 + 1 AS n FROM supplier), c AS (SELECT k, unnest(range(1, n + 1)) AS i FROM s), d AS (SELECT k, i, unnest(range(0, {len(DIMS)})) AS d FROM c),
a AS (SELECT k, floor(count(*) FILTER (WHERE (k + i) % 4 <> 0)::DOUBLE / count(*) * 1000 + 0.5) / 10.0 AS clinical_agreement FROM c GROUP BY 1),
b AS (SELECT k, floor(count(*) FILTER (WHERE (k + i + d) % 5 <> 0)::DOUBLE / count(*) * 1000 + 0.5) / 10.0 AS dimension_agreement FROM d GROUP BY 1),
e AS (SELECT k, n, clinical_agreement, dimension_agreement, CAST((k % 11 = 0)::INT + n * (k % 13 = 0)::INT + 2 * n * (k % 7 = 0)::INT + (clinical_agreement < 80)::INT + (dimension_agreement < 70)::INT AS INTEGER) AS n_errors FROM s JOIN a USING (k) JOIN b USING (k))
SELECT 's' || k AS suite_id, n_errors = 0 AS valid, n_errors, CAST(n AS INTEGER) AS case_count, clinical_agreement, dimension_agreement FROM e"""


@add(ADJUDICATED)
def adjudication_records(spark, sf_dir):
    """Records made from the suppliers: some late, some unread, some with personal data in their notes."""
    verdicts = ", ".join(f"'{d}', {{v}}" for d in DIMS)
    second = ", ".join(f"'{d}', case when (k + i + {j}) % 5 <> 0 then 'PASS' else 'FAIL' end" for j, d in enumerate(DIMS))
    notes = "case when k % 7 = 0 then 'write to a.b@c.de' else 'seen' end"
    label = "named_struct('reviewer', '{who}', 'acceptable', {ok}, 'verdicts', map({verdicts}), 'notes', " + notes + ", 'signed_at', '2025-01-02T03:04:05Z')"
    labels = f"array({label.format(who='x', ok='true', verdicts=verdicts.format(v=repr('PASS')))}, {label.format(who='y', ok='(k + i) % 4 <> 0', verdicts=second)})"
    seen = ", ".join(f"'{f}', {'k % 13 <> 0' if f == 'polarityReviewed' else 'true'}" for f in adjudication.REVIEWED)
    cases = f"transform(sequence(1, cast(k % 3 + 1 as int)), i -> named_struct('case_id', cast(i as string), 'reviewed', map({seen}), 'labels', {labels}))"
    rows = adapters.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k").selectExpr(
        "'1.0' as schema_version", "concat('s', k) as suite_id", "'h' as suite_hash", "case when k % 11 = 0 then 'soon' else '2025-01-02T03:04:05Z' end as locked_at",
        "transform(sequence(1, cast(k % 3 + 1 as int)), i -> cast(i as string)) as case_ids", "array('x', 'y') as adjudicators", f"{cases} as cases",
    )
    return adjudication.validated(rows).select("suite_id", "valid", F.size("errors").alias("n_errors"), "case_count", "clinical_agreement", "dimension_agreement")


# ---- The board

LABELS = "CASE s_suppkey % 5 WHEN 0 THEN concat('Model ', s_suppkey, ' (@org/m', s_suppkey, ')') WHEN 1 THEN concat('via openrouter ', s_suppkey) WHEN 2 THEN concat('see https://x.y/', s_suppkey, ' now') WHEN 3 THEN concat('@team/agent', s_suppkey) ELSE concat('flow /api/run/', s_suppkey) END"
TRACKS = "CASE s_suppkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'mini-agent' ELSE 'agent' END"
CLEAN = LABELS
for _pattern, _by in ((r"(?i)\s*\(@[a-z0-9_.-]+/[^)]+\)", ""), (r"(?i)@[a-z0-9_.-]+/[a-z0-9_.-]+", "private configuration"), (r"(?i)\b(openrouter|openai-compatible|supabase|vercel)\b", "private"), (r"(?i)/api/[a-z0-9_./-]+", "product reporting flow"), (r"(?i)https?://\S+", "private target")):
    CLEAN = f"regexp_replace({CLEAN}, '{_pattern}', '{_by}', 'g')"


@add(f"""SELECT run, concat_ws('::', '2', 's', 'en-US', track, system_type, 'none', CASE WHEN run % 2 = 0 THEN 'judged-frozen-conservative-min' ELSE 'deterministic' END) AS public_key, label AS public_system_label, system_type,
CASE system_type WHEN 'raw-model' THEN 'model' ELSE 'agent' END AS entity_type FROM (SELECT s_suppkey AS run, {TRACKS} AS track, trim({CLEAN}) AS label, CASE s_suppkey % 3 WHEN 0 THEN 'raw-model' WHEN 1 THEN 'mini-agent' ELSE 'custom-agent' END AS system_type FROM supplier)""")
def public_board(spark, sf_dir):
    """Runs as the public board shows them."""
    rows = adapters.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as run", f"{LABELS} as model_label", f"{TRACKS} as track", "case when s_suppkey % 2 = 0 then 'secret-judge' end as judge_model")
    none = {c: F.lit(None).cast("string") for c in ("comparison_class", "scaffold_id", "score_mode", "entity_name", "entity_type")}
    system = board.system_type(F.col("track"), F.lit("none"), F.col("model_label"))
    full = rows.withColumns(none | {"benchmark_version": F.lit("2"), "suite_id": F.lit("s"), "locale": F.lit("en-US"), "system_type": system})
    return board.public_entries(full).select("run", "public_key", "public_system_label", "system_type", "entity_type")


@add("""WITH r AS (SELECT o_orderkey AS run, 's' || (o_custkey % 20) AS suite_id, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE 'h' || (o_custkey % 20) END AS suite_hash, CASE WHEN o_orderkey % 19 = 0 THEN 'pt-BR' ELSE 'en-US' END AS locale FROM orders)
SELECT run, 'unknown suite ' || suite_id AS error FROM r WHERE CAST(substr(suite_id, 2) AS INTEGER) >= 18 UNION ALL SELECT run, 'suiteHash mismatch: expected h' || substr(suite_id, 2) || ', got ' || suite_hash FROM r WHERE CAST(substr(suite_id, 2) AS INTEGER) < 18 AND suite_hash = 'x'
UNION ALL SELECT run, 'locale mismatch: expected en-US, got pt-BR' FROM r WHERE CAST(substr(suite_id, 2) AS INTEGER) < 18 AND locale = 'pt-BR'""")
def run_suite_check(spark, sf_dir):
    """Runs against the suites of their ids: hash, visibility, mode, locale, version and count."""
    rows = adapters.table(spark, sf_dir, "orders").selectExpr("o_orderkey as run", "concat('s', o_custkey % 20) as suite_id", "case when o_orderkey % 17 = 0 then 'x' else concat('h', o_custkey % 20) end as suite_hash", "case when o_orderkey % 19 = 0 then 'pt-BR' else 'en-US' end as locale")
    same = {"visibility": F.lit("public"), "evaluation_mode": F.lit("local"), "benchmark_version": F.lit("2"), "case_count": F.lit(5)}
    suites = spark.range(18).selectExpr("concat('s', id) as suite_id", "concat('h', id) as suite_hash", "'en-US' as locale").withColumns(same)
    return board.run_mismatches(rows.withColumns(same), board.runnable(suites))


@add("SELECT p_partkey AS case_id, p_name AS label FROM part ORDER BY p_partkey LIMIT 25")
def limit_cases(spark, sf_dir):
    """The first cases in order of the file; the limit is the feature."""
    rows = adapters.table(spark, sf_dir, "part").selectExpr("p_partkey as case_id", "p_name as label")
    return board.limited(rows, 25.9, "case_id")


# ---- A whole submission


@add()
def eval_submission(spark, sf_dir):
    """Reports as predictions, evaluated from text to verdict."""
    cases = reports.cases(spark, sf_dir)
    given = cases.select(F.col("case_id").cast("string").alias("instance_id"), F.lit(1).alias("pos"), F.col("html").alias("model_output"))
    rows = submission.evaluate_submission(cases, given)
    return rows.select("case_id", "criteria_passed", "criteria_total", *(f"score_{d}" for d in DIMS), "overall", "verdict")

