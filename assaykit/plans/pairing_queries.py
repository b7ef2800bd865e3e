"""Queries on submissions, paired runs, failed checks, reliability, agreement and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..operators import agreement, pairing, retrieval, scoring
from ..sources import adapters
from ..sources.scratch import with_position
from . import oracle
from .oracle import BASE, WITH_RESULTS, fx, q
from .registry import Registry

registry = Registry()
add = registry.add

# ---- Submissions
PREDICTIONS = """WITH predictions AS (SELECT CAST(conv_id AS VARCHAR) AS instance_id, turn AS pos, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS model_output FROM conversations),
expected AS (SELECT CAST(doc_id AS VARCHAR) AS case_id FROM documents)
"""


@add(PREDICTIONS + "SELECT case_id FROM expected WHERE case_id NOT IN (SELECT instance_id FROM predictions)")
def submission_missing(spark, sf_dir):
    return pairing.missing_ids(adapters.expected(spark, sf_dir), adapters.predictions(spark, sf_dir))


@add(PREDICTIONS + "SELECT instance_id, pos, model_output FROM predictions WHERE instance_id NOT IN (SELECT case_id FROM expected)")
def submission_extra(spark, sf_dir):
    return pairing.extra_rows(adapters.expected(spark, sf_dir), adapters.predictions(spark, sf_dir))


@add(PREDICTIONS + "SELECT instance_id, count(*) AS n FROM predictions GROUP BY 1 HAVING count(*) > 1")
def submission_duplicates(spark, sf_dir):
    return pairing.duplicate_ids(adapters.predictions(spark, sf_dir))


@add(PREDICTIONS + "SELECT instance_id, pos FROM predictions WHERE trim(coalesce(model_output, '')) = ''")
def submission_empty(spark, sf_dir):
    return pairing.empty_outputs(adapters.predictions(spark, sf_dir)).select("instance_id", "pos")


@add(PREDICTIONS + """, c AS (SELECT (SELECT count(*) FROM expected) AS expected, (SELECT count(*) FROM predictions) AS received,
  (SELECT count(*) FROM expected WHERE case_id NOT IN (SELECT instance_id FROM predictions)) AS missing, (SELECT count(*) FROM predictions WHERE instance_id NOT IN (SELECT case_id FROM expected)) AS extra,
  (SELECT count(*) FROM (SELECT 1 FROM predictions GROUP BY instance_id HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM predictions WHERE trim(coalesce(model_output, '')) = '') AS empty_outputs)
SELECT *, missing + extra + duplicates + empty_outputs = 0 AS valid FROM c""")  # fmt: skip
def submission_validation(spark, sf_dir):
    return pairing.validation(adapters.expected(spark, sf_dir), adapters.predictions(spark, sf_dir))


@add(PREDICTIONS + "SELECT case_id, pos, model_output FROM (SELECT e.case_id, p.pos, p.model_output, row_number() OVER (PARTITION BY e.case_id ORDER BY p.pos DESC, p.model_output DESC) AS k FROM expected e JOIN predictions p ON p.instance_id = e.case_id) WHERE k = 1")
def latest_prediction(spark, sf_dir):
    return pairing.latest_predictions(adapters.expected(spark, sf_dir), adapters.predictions(spark, sf_dir))


# ---- Two runs
PAIRS = "pairs AS (SELECT a.case_id, a.overall AS a_overall, b.overall AS b_overall, a.verdict AS a_verdict, b.verdict AS b_verdict, a.modality, a.difficulty, a.overall - b.overall AS raw FROM results a JOIN results b ON a.case_id = b.case_id WHERE a.run = 0 AND b.run = 1)"


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = adapters.stored_results(spark, sf_dir)
    return rows.where("run = 0"), rows.where("run = 1")


@add(q(f"SELECT case_id, a_overall, b_overall, a_verdict, b_verdict, {fx('raw', 1)} AS delta FROM pairs", WITH_RESULTS, PAIRS))
def compare_runs(spark, sf_dir):
    return pairing.compare(*_runs(spark, sf_dir))


@add(q(f"SELECT case_id, {fx('raw', 1)} AS delta FROM pairs ORDER BY abs({fx('raw', 1)}) DESC, case_id LIMIT 5", WITH_RESULTS, PAIRS))
def top_deltas(spark, sf_dir):
    return pairing.compare(*_runs(spark, sf_dir)).orderBy(F.abs("delta").desc(), "case_id").limit(5).select("case_id", "delta")


@add(q(f"SELECT modality, n, {fx('m', 6)} AS mean_diff, n < 5 AS thin FROM (SELECT modality, count(*) AS n, CAST(sum(CAST(round(raw * 10) AS BIGINT)) AS DOUBLE) / 10.0::DOUBLE / count(*) AS m FROM pairs GROUP BY 1)", WITH_RESULTS, PAIRS))
def modality_separation(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    rows = pairing.align(a, b, ["overall", "modality"])
    tenth = F.round((F.col("a_overall") - F.col("b_overall")) * 10).cast("long")
    return rows.groupBy(F.col("a_modality").alias("modality")).agg(F.count("*").alias("n"), to_fixed(F.sum(tenth).cast("double") / 10.0 / F.count("*"), 6).alias("mean_diff"), (F.count("*") < 5).alias("thin"))


# ---- Failed checks


def _stratum_sql() -> str:
    out = []
    for name, dim, pattern, both in pairing.STRATA:
        text = "dim || ':' || signature" if name == "report_quality" else "signature"
        test = f"regexp_matches({text}, '{pattern}')"
        out.append(f"WHEN {test if dim is None else f'dim = {dim!r} AND {test}' if both else f'dim = {dim!r} OR {test}'} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


def _adjudication_sql(audit: bool) -> str:
    whole = "" if audit else "WHEN id = 'QG01' AND regexp_matches(evidence, 'missed=\\d+') AND regexp_matches(evidence, 'exact=0 partial=0') AND regexp_extract(evidence, 'missed=(\\d+)', 1) = regexp_extract(evidence, 'total=(\\d+)', 1) THEN 'system_error'"
    return f"""CASE WHEN lower(trim(evidence)) = 'ok' THEN 'evaluator_limitation'
      WHEN regexp_matches(evidence, '(?i)bi-?rads not mentioned') AND regexp_matches(report, 'bi[\\s.\\-]?rads') THEN 'evaluator_limitation'
      WHEN id IN ('QG04', 'R04') AND regexp_matches(evidence, '5\\s*mm') AND regexp_matches(replace(report, ',', '.'), '\\b5\\s*mm\\b|\\b0\\.5\\s*cm\\b') THEN 'evaluator_limitation'
      WHEN id = 'QG05' AND regexp_matches(report, 'joelho esquerdo|knee left|left knee') THEN 'evaluator_limitation'
      {whole} WHEN id = 'QG01' AND regexp_matches(evidence, 'missed=\\d+') THEN 'review_needed' ELSE 'system_error' END"""


def issues_cte(audit: bool = False) -> str:
    return f"""signed AS (SELECT *, id || ':' || name || ':' || evidence AS signature, CASE severity WHEN 'critical' THEN 4.0::DOUBLE WHEN 'major' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM checks WHERE NOT passed),
issues AS (SELECT *, {_stratum_sql()} AS stratum, {_adjudication_sql(audit)} AS adjudication FROM signed)"""


def _issues(spark, sf_dir, audit: bool = False) -> DataFrame:
    return pairing.failed_issues(adapters.checks(spark, sf_dir)).withColumns({"stratum": pairing.stratum(), "adjudication": pairing.adjudication(audit)})


def _sides(spark, sf_dir) -> DataFrame:
    """Failed checks of runs 0 and 1 in the cases that both have."""
    both = adapters.checks(spark, sf_dir).where("run < 2").groupBy("case_id").agg(F.count_distinct("run").alias("n")).where("n = 2").select("case_id")
    rows = _issues(spark, sf_dir).where("run < 2").join(both, "case_id", "left_semi")
    return rows.withColumn("side", F.when(F.col("run") == 0, "a").otherwise("b"))


BY_CASE = "by_case AS (SELECT case_id, stratum, " + ", ".join(
    f"count(*) FILTER (WHERE run = {r}) AS {s}_n, count(*) FILTER (WHERE run = {r} AND adjudication = 'system_error') AS {s}_system, count(*) FILTER (WHERE run = {r} AND adjudication = 'evaluator_limitation') AS {s}_limits, "
    f"count(*) FILTER (WHERE run = {r} AND adjudication = 'review_needed') AS {s}_review, coalesce(sum(weight) FILTER (WHERE run = {r}), 0.0::DOUBLE) AS {s}_w, coalesce(sum(weight) FILTER (WHERE run = {r} AND adjudication = 'system_error'), 0.0::DOUBLE) AS {s}_sw"
    for r, s in ((0, "a"), (1, "b"))
) + " FROM issues WHERE run < 2 AND case_id IN (SELECT case_id FROM checks WHERE run < 2 GROUP BY 1 HAVING count(DISTINCT run) = 2) GROUP BY 1, 2)"


@add(q("SELECT run, stratum, adjudication, count(*) AS n FROM issues GROUP BY 1, 2, 3", BASE, issues_cte()))
def strata_failures(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy("run", "stratum", "adjudication").agg(F.count("*").alias("n"))


def _strata_sql() -> str:
    cols = []
    for s, o in (("a", "b"), ("b", "a")):
        total = lambda c, to: f"CAST(sum({c}) AS BIGINT) AS {to}"
        cols += [total(f"{s}_n", f"{s}_failures"), total(f"{s}_system", f"{s}_system_failures"), total(f"{s}_limits", f"{s}_limitations"), total(f"{s}_review", f"{s}_review_needed"), f"sum({s}_w) AS {s}_weighted", f"sum({s}_sw) AS {s}_system_weighted",
                 f"count(*) FILTER (WHERE {s}_n > 0) AS {s}_cases", f"CAST(sum(greatest({s}_n - {o}_n, 0)) AS BIGINT) AS {s}_excess", f"sum(greatest({s}_w - {o}_w, 0.0::DOUBLE)) AS {s}_excess_weighted",
                 f"count(*) FILTER (WHERE {s}_n > 0 AND {o}_n = 0) AS {s}_only", f"count(*) FILTER (WHERE {s}_sw > {o}_sw) AS {s}_excess_cases"]
    return "SELECT stratum, " + ", ".join(cols) + ", count(*) FILTER (WHERE a_n > 0 AND b_n > 0) AS shared FROM by_case GROUP BY 1"


@add(q(_strata_sql(), BASE, issues_cte(), BY_CASE))
def strata_excess(spark, sf_dir):
    return pairing.strata_comparison(pairing.strata_by_case(_sides(spark, sf_dir)))


@add(q("SELECT stratum, case_id, CASE WHEN a_n = 0 THEN 'b_only' WHEN b_n = 0 THEN 'a_only' ELSE 'shared' END AS kind FROM by_case", BASE, issues_cte(), BY_CASE))
def strata_case_sets(spark, sf_dir):
    kind = F.when(F.col("a_n") == 0, "b_only").when(F.col("b_n") == 0, "a_only").otherwise("shared")
    return pairing.strata_by_case(_sides(spark, sf_dir)).select("stratum", "case_id", kind.alias("kind"))


@add(q("SELECT stratum, sum(b_sw) - sum(a_sw) AS gap FROM by_case GROUP BY 1 ORDER BY gap DESC, stratum LIMIT 5", BASE, issues_cte(), BY_CASE))
def top_strata(spark, sf_dir):
    rows = pairing.strata_comparison(pairing.strata_by_case(_sides(spark, sf_dir)))
    return rows.select("stratum", (F.col("b_system_weighted") - F.col("a_system_weighted")).alias("gap")).orderBy(F.desc("gap"), "stratum").limit(5)


@add(q("""SELECT run, stratum, count(*) AS failed_checks, count(*) FILTER (WHERE adjudication = 'system_error') AS system_errors, count(*) FILTER (WHERE adjudication = 'evaluator_limitation') AS evaluator_limitations,
  count(*) FILTER (WHERE adjudication = 'review_needed') AS review_needed, coalesce(sum(weight) FILTER (WHERE adjudication = 'system_error'), 0.0::DOUBLE) AS system_weight, sum(weight) AS raw_weight FROM issues GROUP BY 1, 2""", BASE, issues_cte(True)))  # fmt: skip
def audit_totals(spark, sf_dir):
    return pairing.audit_totals(_issues(spark, sf_dir, True))


def _taxonomy_sql() -> str:
    cases = [f"WHEN left(id, 3) IN ({', '.join(map(repr, ids))}) THEN '{c}/{s}'" for c, subs in pairing.TAXONOMY.items() for s, ids in subs.items()]
    return "CASE " + " ".join(cases) + """ WHEN starts_with(id, 'T') AND dim = 'TERM' THEN CASE WHEN contains(lower(name || ' ' || evidence), 'opener') THEN 'TERMINOLOGY/forbidden_opener'
      WHEN regexp_matches(lower(name), 'modality|vocabulary') THEN 'TERMINOLOGY/crossmodality_vocab' ELSE 'TERMINOLOGY/forbidden_term' END WHEN starts_with(id, 'G') AND dim = 'GUIDE' THEN 'COVERAGE/missing_anatomy' END"""


@add(q("SELECT run, string_split(c, '/')[1] AS category, string_split(c, '/')[2] AS subcategory, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY 1, 2, 3", BASE, f"t AS (SELECT run, {_taxonomy_sql()} AS c FROM checks WHERE NOT passed)"))
def failure_taxonomy(spark, sf_dir):
    rows = adapters.checks(spark, sf_dir).where(~F.col("passed")).withColumn("t", pairing.taxonomy()).where("t is not null")
    return rows.groupBy("run", F.col("t.category").alias("category"), F.col("t.subcategory").alias("subcategory")).agg(F.count("*").alias("n"))


@add(q(" UNION ALL ".join(f"SELECT run, '{d}' AS dim, count(score_{d}) AS scored, count(*) FILTER (WHERE verdict_{d} = 'FAIL') AS failed, round(count(*) FILTER (WHERE verdict_{d} = 'FAIL') / count(score_{d})::DOUBLE * 100, 6) AS fail_rate FROM scored GROUP BY 1" for d in scoring.DIMS), oracle.WITH_SCORED))
def dim_fail_rate(spark, sf_dir):
    rows = scoring.dim_rows(adapters.scored(spark, sf_dir)).where("score is not null")
    failed = F.count_if(F.col("verdict") == "FAIL")
    return rows.groupBy("run", "dim").agg(F.count("*").alias("scored"), failed.alias("failed"), F.round(failed / F.count("*") * 100, 6).alias("fail_rate"))


@add(q("SELECT run, " + ", ".join(f"{fx(m, 1)} AS {m}" for m in ("CT", "MRI", "US", "XR")) + " FROM m", WITH_RESULTS, "m AS (SELECT run, " + ", ".join(f"CAST(sum(CAST(round(overall * 10) AS BIGINT)) FILTER (WHERE modality = '{m}') AS DOUBLE) / 10.0::DOUBLE / count(*) FILTER (WHERE modality = '{m}') AS {m}" for m in ("CT", "MRI", "US", "XR")) + " FROM results GROUP BY 1)"))
def modality_pivot(spark, sf_dir):
    tenth = F.round(F.col("overall") * 10).cast("long")
    return adapters.results(spark, sf_dir).groupBy("run").pivot("modality", ["CT", "MRI", "US", "XR"]).agg(to_fixed(F.sum(tenth).cast("double") / 10.0 / F.count("overall"), 1))


@add(q("SELECT run, arg_min(dim, m * 10 + k) AS hardest, arg_max(dim, m * 10 - k) AS easiest FROM (" + " UNION ALL ".join(f"SELECT run, '{d}' AS dim, {k} AS k, round({oracle.mean_tenths(f'combined_{d}')}, 6) AS m FROM results GROUP BY 1" for k, d in enumerate(scoring.DIMS)) + ") GROUP BY 1", WITH_RESULTS))
def hardest_dim(spark, sf_dir):
    mean = lambda d: F.round(F.sum(F.round(F.col(f"combined_{d}") * 10).cast("long")).cast("double") / 10.0 / F.count(f"combined_{d}"), 6)
    rows = adapters.results(spark, sf_dir).groupBy("run").agg(*(mean(d).alias(d) for d in scoring.DIMS))
    long = rows.select("run", F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.lit(k).alias("k"), F.col(d).alias("m")) for k, d in enumerate(scoring.DIMS)))))
    return long.groupBy("run").agg(F.min_by("dim", F.col("m") * 10 + F.col("k")).alias("hardest"), F.max_by("dim", F.col("m") * 10 - F.col("k")).alias("easiest"))


# ---- Reliability
PER_CASE = "per_case AS (SELECT case_id, count(*) AS runs, count(*) FILTER (WHERE crit_CRIT = 0 AND critical_failed = 0) AS safe_runs, count(*) FILTER (WHERE verdict <> 'FAIL') AS passed_runs FROM results GROUP BY 1)"


def _per_case(spark, sf_dir) -> DataFrame:
    return pairing.case_reliability(adapters.results(spark, sf_dir).withColumn("safe", scoring.critical_safe()))


@add(q(f"SELECT 4 AS k, case_count, incomplete_cases, {fx('s', 4)} AS pass_power_k_safe, {fx('s1', 4)} AS pass_at_1_safe, {fx('v', 4)} AS pass_power_k_verdict, {fx('v1', 4)} AS pass_at_1_verdict FROM r", WITH_RESULTS, PER_CASE,
       """r AS (SELECT count(*) FILTER (WHERE runs = 4) AS case_count, count(*) FILTER (WHERE runs <> 4) AS incomplete_cases, count(*) FILTER (WHERE runs = 4 AND safe_runs = 4)::DOUBLE / count(*) FILTER (WHERE runs = 4) AS s,
  CAST(sum(safe_runs) FILTER (WHERE runs = 4) AS DOUBLE) / 4.0::DOUBLE / count(*) FILTER (WHERE runs = 4) AS s1, count(*) FILTER (WHERE runs = 4 AND passed_runs = 4)::DOUBLE / count(*) FILTER (WHERE runs = 4) AS v,
  CAST(sum(passed_runs) FILTER (WHERE runs = 4) AS DOUBLE) / 4.0::DOUBLE / count(*) FILTER (WHERE runs = 4) AS v1 FROM per_case)"""))  # fmt: skip
def pass_power_k(spark, sf_dir):
    return pairing.pass_power_k(_per_case(spark, sf_dir), 4)


@add(q("SELECT case_id, safe_runs FROM per_case WHERE runs = 4 AND safe_runs BETWEEN 1 AND 3", WITH_RESULTS, PER_CASE))
def flaky_cases(spark, sf_dir):
    return pairing.flaky_cases(_per_case(spark, sf_dir), 4).select("case_id", "safe_runs")


# ---- Agreement


@add(q(f"SELECT {fx('k', 6)} AS kappa, {fx('po', 6)} AS po, {fx('pe', 6)} AS pe, n FROM z", WITH_RESULTS, PAIRS, """t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a_verdict = b_verdict) AS agree FROM pairs),
x AS (SELECT CAST(sum(na * nb) AS BIGINT) AS cross_n FROM (SELECT (SELECT count(*) FROM pairs WHERE a_verdict = v) AS na, (SELECT count(*) FROM pairs WHERE b_verdict = v) AS nb FROM (VALUES ('PASS'), ('PARTIAL'), ('FAIL')) c(v))),
y AS (SELECT n, agree::DOUBLE / n AS po, cross_n::DOUBLE / (n::DOUBLE * n) AS pe FROM t, x), z AS (SELECT *, (po - pe) / (1 - pe) AS k FROM y)"""))  # fmt: skip
def cohen_kappa(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return agreement.cohens_kappa(pairing.align(a, b, ["verdict"]), "a_verdict", "b_verdict")


@add(q(f"SELECT {fx('k', 6)} AS kappa, {fx('p', 6)} AS p_bar, {fx('e', 6)} AS pe_bar, n, 4 AS raters FROM z", WITH_RESULTS, """c AS (SELECT case_id, verdict, count(*) AS c FROM results WHERE case_id IN (SELECT case_id FROM results GROUP BY 1 HAVING count(*) = 4) GROUP BY 1, 2),
y AS (SELECT count(DISTINCT case_id) AS n, CAST(sum(c * (c - 1)) AS BIGINT) AS agree FROM c), m AS (SELECT CAST(sum(s * s) AS BIGINT) AS squares FROM (SELECT sum(c) AS s FROM c GROUP BY verdict)),
w AS (SELECT n, agree / (n::DOUBLE * 4 * 3) AS p, squares / (n::DOUBLE * 4 * n * 4) AS e FROM y, m), z AS (SELECT *, (p - e) / (1 - e) AS k FROM w)"""))  # fmt: skip
def fleiss_kappa(spark, sf_dir):
    return agreement.fleiss_kappa(adapters.stored_results(spark, sf_dir).select(F.col("case_id").alias("item"), F.col("verdict").alias("category")), 4)


@add(q(f"SELECT {fx('a', 6)} AS alpha, n, pairs FROM z", WITH_RESULTS, """u AS (SELECT case_id, count(*) AS m, sum(CAST(round(overall * 10) AS BIGINT)) AS s, sum(CAST(round(overall * 10) AS BIGINT) * CAST(round(overall * 10) AS BIGINT)) AS q FROM results GROUP BY 1),
g AS (SELECT m, count(*) AS units, sum(m * q - s * s) AS d, sum(s) AS s, sum(q) AS q FROM u GROUP BY 1),
t AS (SELECT CAST(sum(units) AS BIGINT) AS n, CAST(sum(m * units) AS DOUBLE) AS v, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(q) AS DOUBLE) AS q, sum(2.0::DOUBLE * d::DOUBLE / (m - 1)) FILTER (WHERE m > 1) AS num,
  CAST(sum(m * units) FILTER (WHERE m > 1) AS DOUBLE) AS den, CAST(sum(units * m * (m - 1) // 2) FILTER (WHERE m > 1) AS BIGINT) AS pairs FROM g),
z AS (SELECT n, pairs, 1 - (num / den) / (2.0::DOUBLE * (v * q - s * s) / (v * (v - 1))) AS a FROM t)"""))  # fmt: skip
def kripp_alpha(spark, sf_dir):
    return agreement.krippendorff_alpha(adapters.stored_results(spark, sf_dir).select(F.col("case_id").alias("unit"), F.col("overall").alias("value")))


@add(q(f"SELECT {fx('r', 6)} AS rho, n FROM z", WITH_RESULTS, PAIRS, """k AS (SELECT CAST(2 * rank() OVER (ORDER BY a_overall) + count(*) OVER (PARTITION BY a_overall) - 1 AS BIGINT) AS x, CAST(2 * rank() OVER (ORDER BY b_overall) + count(*) OVER (PARTITION BY b_overall) - 1 AS BIGINT) AS y FROM pairs),
s AS (SELECT count(*) AS n, sum(x) AS a, sum(y) AS b, sum(x * x) AS aa, sum(y * y) AS bb, sum(x * y) AS ab FROM k),
z AS (SELECT n, (n::DOUBLE * ab::DOUBLE - a::DOUBLE * b::DOUBLE) / sqrt((n::DOUBLE * aa::DOUBLE - a::DOUBLE * a::DOUBLE) * (n::DOUBLE * bb::DOUBLE - b::DOUBLE * b::DOUBLE)) AS r FROM s)"""))  # fmt: skip
def spearman_rho(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    return agreement.spearman(pairing.align(a, b, ["overall"]), "a_overall", "b_overall")


DRAW = """draws AS (SELECT i // n AS r, i AS i, n, xor(t3, t3 >> 15)::DOUBLE / 4294967296.0::DOUBLE AS u FROM (SELECT *, ((xor(t2, t2 >> 15)) * 1935289751) & 4294967295 AS t3 FROM (
  SELECT *, (xor(t1, t1 >> 16) * 569420461) & 4294967295 AS t2 FROM (SELECT i, n, ({seed} + ((i + 1) & 4294967295) * (-1640531527)) & 4294967295 AS t1 FROM (SELECT n, unnest(range(0, n * {r})) AS i FROM size)))))"""
SUMS = "sums AS (SELECT r, CAST(sum(tenths) AS BIGINT) AS total FROM draws JOIN numbered ON numbered.pos = CAST(floor(u * n) AS BIGINT) GROUP BY 1), ordered AS (SELECT *, row_number() OVER (ORDER BY total) - 1 AS k FROM sums)"
RESAMPLES = 10_000


def _mean(x: str) -> str:
    return fx(f"({x})::DOUBLE / 10.0::DOUBLE / n::DOUBLE", 6)


@add(q(f"SELECT {_mean('all_t')} AS mean, {_mean('lo')} AS lower, {_mean('hi')} AS upper, n FROM (SELECT (SELECT n FROM size) AS n, (SELECT CAST(sum(tenths) AS BIGINT) FROM numbered) AS all_t, max(total) FILTER (WHERE k = {int(0.025 * RESAMPLES)}) AS lo, max(total) FILTER (WHERE k = {int(0.975 * RESAMPLES) - 1}) AS hi FROM ordered)",
       WITH_RESULTS, "numbered AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS pos, CAST(round(overall * 10) AS BIGINT) AS tenths FROM results WHERE run = 0), size AS (SELECT count(*) AS n FROM numbered)", DRAW.format(seed=42, r=RESAMPLES), SUMS))
def bootstrap_ci(spark, sf_dir):
    # Not by way of stored results: only the run's own checks are read, counted and shuffled, and only its scores are stored (by with_position).
    rows = adapters.results(spark, sf_dir).where("run = 0").select("case_id", F.round(F.col("overall") * 10).cast("long").alias("tenths"))
    return agreement.bootstrap_interval(with_position(rows, "case_id"), RESAMPLES)


@add(q(f"SELECT {_mean('obs')} AS mean_diff, {_mean('lo')} AS lower, {_mean('hi')} AS upper, {fx(f'(extreme + 1)::DOUBLE / {RESAMPLES + 1}.0::DOUBLE', 6)} AS p_value, n FROM (SELECT (SELECT n FROM size) AS n, max(obs) AS obs, max(total) FILTER (WHERE k = {int(0.025 * RESAMPLES)}) AS lo, max(total) FILTER (WHERE k = {int(0.975 * RESAMPLES) - 1}) AS hi, count(*) FILTER (WHERE abs(total - obs) >= abs(obs)) AS extreme FROM ordered, (SELECT CAST(sum(tenths) AS BIGINT) AS obs FROM numbered))",
       WITH_RESULTS, PAIRS, "numbered AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS pos, CAST(round(raw * 10) AS BIGINT) AS tenths FROM pairs), size AS (SELECT count(*) AS n FROM numbered)", DRAW.format(seed=7, r=RESAMPLES), SUMS))
def paired_bootstrap(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    rows = pairing.align(a, b, ["overall"]).select("case_id", F.round((F.col("a_overall") - F.col("b_overall")) * 10).cast("long").alias("tenths"))
    return agreement.paired_bootstrap(with_position(rows, "case_id"), RESAMPLES)


ERF = "(1.0::DOUBLE - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-(x * x)))"


@add(q(f"SELECT only_a, only_b, {fx('chi2', 6)} AS chi2, {fx(f'(1.0::DOUBLE - {ERF})', 6)} AS p_value FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * x) AS t FROM (SELECT *, sqrt(chi2 / 2) AS x FROM d))", WITH_RESULTS, PAIRS,
       """d0 AS (SELECT count(*) FILTER (WHERE a_verdict = 'PASS' AND b_verdict <> 'PASS') AS only_a, count(*) FILTER (WHERE a_verdict <> 'PASS' AND b_verdict = 'PASS') AS only_b FROM pairs),
d AS (SELECT *, (abs(only_a - only_b)::DOUBLE - 1) * (abs(only_a - only_b)::DOUBLE - 1) / (only_a + only_b) AS chi2 FROM d0)"""))  # fmt: skip
def mcnemar(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    rows = pairing.align(a, b, ["verdict"]).select((F.col("a_verdict") == "PASS").alias("a"), (F.col("b_verdict") == "PASS").alias("b"))
    return agreement.mcnemar(rows)


@add(q(f"SELECT {fx('h', 6)} AS h FROM (SELECT asin(sqrt(p1)) * 2 - asin(sqrt(p2)) * 2 AS h FROM (SELECT count(*) FILTER (WHERE a_verdict = 'PASS')::DOUBLE / count(*) AS p1, count(*) FILTER (WHERE b_verdict = 'PASS')::DOUBLE / count(*) AS p2 FROM pairs))", WITH_RESULTS, PAIRS))
def cohens_h(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    share = lambda s: F.count_if(F.col(f"{s}_verdict") == "PASS").cast("double") / F.count("*")
    return pairing.align(a, b, ["verdict"]).agg(share("a").alias("p1"), share("b").alias("p2")).select(agreement.cohens_h(F.col("p1"), F.col("p2")).alias("h"))


@add(q("SELECT count(*) AS total, floor(CAST(sum(CAST(round(overall * 10) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 10.0::DOUBLE AS mean, floor(median(overall) * 10 + 0.5) / 10.0::DOUBLE AS median, count(*) FILTER (WHERE overall < 84) AS failures, floor(count(*) FILTER (WHERE overall >= 84)::DOUBLE / count(*) * 100.0::DOUBLE * 10 + 0.5) / 10.0::DOUBLE AS pass_rate FROM results WHERE run = 2", WITH_RESULTS))
def reference_probe(spark, sf_dir):
    return agreement.reference_probe(adapters.stored_results(spark, sf_dir).where("run = 2"))


@add(q("SELECT count(*) AS items, count(*) FILTER (WHERE same) AS unanimous, floor(count(*) FILTER (WHERE same)::DOUBLE / count(*) * 1000.0::DOUBLE + 0.5) / 10.0::DOUBLE AS agreement FROM (SELECT case_id, min(verdict) = max(verdict) AS same FROM results GROUP BY 1 HAVING count(*) >= 2)", WITH_RESULTS))
def adjudication_agreement(spark, sf_dir):
    return agreement.unanimity(adapters.results(spark, sf_dir), ["case_id"], "verdict")


# ---- Retrieval: each vector whose id is divisible by 50 is a query against all others; the same label is relevant.
NEAR = """WITH v AS (SELECT vec_id, label, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS sq FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS doc, a.label = b.label AS rel, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)) / (sqrt(a.sq) * sqrt(b.sq)), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
k AS (SELECT query, doc, rel, row_number() OVER (PARTITION BY query ORDER BY sim DESC, doc) AS rank FROM p QUALIFY rank <= 10), rel AS (SELECT query, count(*) FILTER (WHERE rel) AS relevant FROM p GROUP BY 1),
m AS (SELECT query, count(*) AS n, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0.0::DOUBLE) AS mrr, """ + ", ".join(f"count(*) FILTER (WHERE rel AND rank <= {c}) AS f{c}, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE rel AND rank <= {c}), 0.0::DOUBLE) AS d{c}" for c in retrieval.CUTS) + """ FROM k GROUP BY 1),
i AS (SELECT query, relevant, """ + ", ".join(f"coalesce(list_sum(list_transform(range(1, least(relevant, {c}) + 1), lambda x: 1.0::DOUBLE / log2(x + 1))), 0.0::DOUBLE) AS i{c}" for c in retrieval.CUTS) + """ FROM rel),
z AS (SELECT *, CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE f5::DOUBLE / relevant END AS r5, f5::DOUBLE / least(5, n) AS p5, CASE WHEN i5 = 0 THEN 0.0::DOUBLE ELSE d5 / i5 END AS g5 FROM m JOIN i USING (query))
SELECT query, CAST(n AS INTEGER) AS n, relevant, round(mrr, 6) AS mrr, """ + ", ".join(f"round(f{c}::DOUBLE / {c}, 6) AS precision_{c}, round(CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE f{c}::DOUBLE / relevant END, 6) AS recall_{c}, round(CASE WHEN i{c} = 0 THEN 0.0::DOUBLE ELSE d{c} / i{c} END, 6) AS ndcg_{c}" for c in retrieval.CUTS) + """,
  least(100.0::DOUBLE, floor(round(r5 * 40 + p5 * 20 + g5 * 25 + mrr * 15, 6) + 0.5)) AS score FROM z"""  # fmt: skip


@add(NEAR)
def retrieval_metrics(spark, sf_dir):
    vectors = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    queries = vectors.where("id % 50 = 0")
    found = retrieval.distinct_ranks(retrieval.nearest(queries, vectors.select("id", "v"), 10))
    # The same label is relevant: counts by label stand for the pairs, and only what was found is looked up.
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    counts = queries.select(F.col("id").alias("query"), "label").join(sizes, "label").select("query", "relevant")
    of = lambda key, name: vectors.select(F.col("id").alias(key), F.col("label").alias(name))
    judged = found.join(of("query", "a"), "query").join(of("doc", "b"), "doc").select("query", "doc", "rank", (F.col("a") == F.col("b")).cast("int").alias("rel"))
    return retrieval.rated(judged, retrieval.ideal_of_counts(counts))
