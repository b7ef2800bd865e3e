"""Queries on scores, summaries, verification and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import to_fixed
from ..operators import scoring, summary
from ..operators.scoring import DIMS, KEYS, POLICIES
from ..sources import adapters
from . import oracle
from .oracle import BASE, WITH_SCORED, combined_cte, judged_cte, q, summary_cte
from .registry import Registry

registry = Registry()
add = registry.add


def _ranked(entries: DataFrame) -> DataFrame:
    """Runs as leaderboard entries: odd runs share a group; run 3 isn't eligible."""
    return summary.rank_entries(
        entries.withColumn("eligible", F.col("run") != 3).withColumn("comparable_key", summary.comparable_key(F.lit("v1"), F.lit("suite"), (F.col("run") % 2).cast("string"), F.lit(None)))
    )


RANK_SQL = """entries AS (SELECT *, run <> 3 AS eligible, 'v1::suite::' || CAST(run % 2 AS VARCHAR) || '::none' AS comparable_key FROM summary),
ranked AS (SELECT *, row_number() OVER (PARTITION BY comparable_key ORDER BY eligible DESC, all_pass_rate DESC, criterion_pass_rate DESC, average_overall DESC, strict_pass_rate DESC, pass_rate DESC, total_cost_usd, average_latency_ms, run) AS position FROM entries)"""
RANKED = ["run", "comparable_key", "eligible", "all_pass_rate", "criterion_pass_rate", "average_overall", "strict_pass_rate", "pass_rate", "total_cost_usd", "average_latency_ms", "position", "rank"]


@add(q(f"SELECT {', '.join(RANKED[:-2])}, CAST(position AS INTEGER) AS position, CAST(CASE WHEN eligible THEN position END AS INTEGER) AS rank FROM ranked", oracle.WITH_RESULTS, summary_cte(), RANK_SQL))
def rank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(summary.summarize(adapters.results(spark, sf_dir))).select(*RANKED)


@add(BASE + "\nSELECT run, case_id, criteria_passed, criteria_total, all_pass FROM counts")
def criterion_stats(spark, sf_dir):
    return scoring.criterion_stats(adapters.checks(spark, sf_dir))


@add(BASE + ",\nr AS (SELECT run, " + oracle.share("all_pass") + " AS x FROM counts GROUP BY run)\nSELECT run, " + oracle.fx("x", 1) + " AS all_pass_rate FROM r")
def all_pass_rate(spark, sf_dir):
    return scoring.criterion_stats(adapters.checks(spark, sf_dir)).groupBy("run").agg(summary.rate(F.col("all_pass")).alias("all_pass_rate"))


DIM_WEIGHT = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN score_{d} IS NOT NULL THEN {scoring.WEIGHTS[d]!r}::DOUBLE ELSE 0.0::DOUBLE END" for d in DIMS)])
DIM_ROWS = f"w AS (SELECT *, {DIM_WEIGHT} AS tw FROM scored)\n" + " UNION ALL ".join(
    f"SELECT run, case_id, '{d}' AS dim, score_{d} AS score, pass_{d} AS pass, total_{d} AS total, crit_{d} AS crit_fails, verdict_{d} AS verdict, CASE WHEN score_{d} IS NOT NULL THEN {scoring.WEIGHTS[d]!r}::DOUBLE / tw ELSE 0.0::DOUBLE END AS applied_weight FROM w"
    for d in DIMS
)


@add(f"{WITH_SCORED},\n{DIM_ROWS}")
def dim_scores(spark, sf_dir):
    return scoring.dim_rows(adapters.scored(spark, sf_dir))


def _evaluator(checks: DataFrame) -> DataFrame:
    """Evaluator scores for two dimensions, from the same checks; negative ones are unscored."""
    own = checks.where(F.col("dim").isin("QUAL", "RAG")).groupBy(*KEYS, "dim").agg(
        F.count_if("passed").alias("pass"), F.count("*").alias("total"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("crit"), F.count_if(~F.col("passed") & (F.col("severity") == "major")).alias("major"),
    )
    raw = (F.col("case_id") * 7 + F.col("total") * 13) % 130 - 10
    return own.withColumn("score", F.when(raw >= 0, raw.cast("double")))


def _overlay_sql() -> str:
    parts = [WITH_SCORED, """ev AS (SELECT run, case_id, dim, count(*) FILTER (WHERE passed) AS p, count(*) AS t, count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS c,
      count(*) FILTER (WHERE NOT passed AND severity = 'major') AS m FROM checks WHERE dim IN ('QUAL', 'RAG') GROUP BY 1, 2, 3),
    eg AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, ((case_id * 7 + t * 13) % 130)::DOUBLE - 10.0::DOUBLE)) AS g FROM ev WHERE (case_id * 7 + t * 13) % 130 - 10 >= 0),
    es AS (SELECT *, """ + oracle.cap_sql(oracle.fx("g", 1), "c", "m") + """ AS s FROM eg),
    ew AS (SELECT *, CASE WHEN c > 0 THEN 'FAIL' WHEN s >= 80 THEN CASE WHEN p = t THEN 'PASS' ELSE 'PARTIAL' END WHEN s >= 50 THEN 'PARTIAL' ELSE 'FAIL' END AS v FROM es)"""]  # fmt: skip
    cols = ", ".join((f"coalesce(e_{d}.s, x.score_{d}) AS score_{d}, coalesce(e_{d}.v, x.verdict_{d}) AS verdict_{d}" if d in ("QUAL", "RAG") else f"x.score_{d}, x.verdict_{d}") for d in DIMS)
    joins = " ".join(f"LEFT JOIN ew e_{d} ON e_{d}.run = x.run AND e_{d}.case_id = x.case_id AND e_{d}.dim = '{d}'" for d in ("QUAL", "RAG"))
    parts.append(f"ov AS (SELECT x.run, x.case_id, {cols} FROM scored x {joins}),\nod AS (SELECT *, {oracle.weighted('score_', scoring.WEIGHTS)} AS raw FROM ov)")
    return ",\n".join(parts) + "\nSELECT run, case_id, " + ", ".join(f"score_{d}, verdict_{d}" for d in DIMS) + f", {oracle.fx('raw', 1)} AS det_overall FROM od"


@add(_overlay_sql())
def dim_scores_overlay(spark, sf_dir):
    out = scoring.overlay_scores(adapters.scored(spark, sf_dir), _evaluator(adapters.checks(spark, sf_dir)))
    return out.select(*KEYS, *(c for d in DIMS for c in (f"score_{d}", f"verdict_{d}")), "det_overall")


@add(WITH_SCORED + ",\n" + combined_cte() + "\nSELECT run, case_id, critical_failed, major_failed, cap FROM combined")
def severity_cap(spark, sf_dir):
    cap = scoring.severity_cap(F.col("critical_failed"), F.col("major_failed"))
    return adapters.counted(spark, sf_dir).select(*KEYS, "critical_failed", "major_failed", cap.alias("cap"))


COMBINED = [*KEYS, "det_overall", *(f"combined_{d}" for d in DIMS), "overall", "verdict", "confidence", "phase", "reasons"]
COMBINED_SQL = "\nSELECT " + ", ".join(COMBINED[:-1]) + ", array_to_string(gate_reasons, '; ') AS reasons FROM combined"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("gate_reasons", "; ")).select(*COMBINED)


@add(WITH_SCORED + ",\n" + combined_cte() + COMBINED_SQL)
def combined_verdicts(spark, sf_dir):
    return _shown(scoring.combine(adapters.scored(spark, sf_dir)))


@add(WITH_SCORED + ",\n" + judged_cte() + ",\n" + combined_cte("judged", True) + COMBINED_SQL)
def combined_with_judge(spark, sf_dir):
    return _shown(scoring.combine(adapters.judged(spark, sf_dir), True))


@add(WITH_SCORED + ",\n" + judged_cte() + ",\n" + combined_cte("judged", True, POLICIES["strict"], True) + COMBINED_SQL)
def combined_strict_judge_primary(spark, sf_dir):
    return _shown(scoring.combine(adapters.judged(spark, sf_dir), True, POLICIES["strict"], True))


@add("SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', {p.pass_at}::DOUBLE, {p.partial_at}::DOUBLE, {p.critical_forces_fail}, " + ", ".join(f"{p.share(d)!r}::DOUBLE" for d in DIMS) + ")" for p in POLICIES.values()) + ") t(policy, pass_at, partial_at, critical_forces_fail, " + ", ".join(f"w_{d}" for d in DIMS) + ")")
def policy_profiles(spark, sf_dir):
    return scoring.policy_profiles(spark)


@add(q("SELECT * FROM summary", oracle.WITH_RESULTS, summary_cte()))
def run_summary(spark, sf_dir):
    return summary.summarize(adapters.results(spark, sf_dir))


@add(q(" UNION ALL ".join(f"SELECT run, '{d}' AS dim, average_{d} AS mean_score FROM summary" for d in DIMS), oracle.WITH_RESULTS, summary_cte()))
def per_dim_means(spark, sf_dir):
    rows = summary.summarize(adapters.results(spark, sf_dir))
    return rows.select("run", F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"average_{d}").alias("mean_score")) for d in DIMS))))


@add(q("SELECT run, difficulty, case_count, " + ", ".join(f"{oracle.fx(k, 1)} AS {k}" for k in oracle.RATES) + " FROM d", oracle.WITH_RESULTS, "d AS (SELECT run, difficulty, count(*) AS case_count, " + ", ".join(f"{v} AS {k}" for k, v in oracle.RATES.items()) + " FROM results WHERE difficulty IS NOT NULL GROUP BY 1, 2)"))
def difficulty_breakdown(spark, sf_dir):
    return summary.by_difficulty(adapters.results(spark, sf_dir))


def _tampered(results: DataFrame) -> DataFrame:
    """Stored values of which some were changed: a shifted score, a flipped verdict, a wrong all-pass, a negative cost."""
    k = F.col("case_id")
    return results.withColumns({
        "stored_overall": F.col("overall") + F.when(k % 97 == 0, 5.0).when(k % 101 == 0, 0.1).otherwise(0.0),
        "stored_verdict": F.when((k % 89 == 0) & (F.col("verdict") == "FAIL"), "PASS").otherwise(F.col("verdict")),
        "stored_all_pass": F.when(k % 83 == 0, ~F.col("all_pass")).otherwise(F.col("all_pass")), "cost_usd": F.when(k % 79 == 0, -F.col("cost_usd") - 1.0).otherwise(F.col("cost_usd")),
    })


TAMPERED = """tampered AS (SELECT * REPLACE (CASE WHEN case_id % 79 = 0 THEN -cost_usd - 1.0::DOUBLE ELSE cost_usd END AS cost_usd),
  overall + CASE WHEN case_id % 97 = 0 THEN 5.0::DOUBLE WHEN case_id % 101 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS stored_overall,
  CASE WHEN case_id % 89 = 0 AND verdict = 'FAIL' THEN 'PASS' ELSE verdict END AS stored_verdict,
  CASE WHEN case_id % 83 = 0 THEN NOT all_pass ELSE all_pass END AS stored_all_pass FROM results)"""


@add(q("""SELECT run, case_id, 'overall mismatch' AS error FROM tampered WHERE abs(stored_overall - overall) > 0.11
UNION ALL SELECT run, case_id, 'verdict mismatch' FROM tampered WHERE stored_verdict <> verdict
UNION ALL SELECT run, case_id, 'critical failure must fail' FROM tampered WHERE critical_failed > 0 AND stored_verdict <> 'FAIL'
UNION ALL SELECT run, case_id, 'all_pass mismatch' FROM tampered WHERE stored_all_pass <> all_pass
UNION ALL SELECT run, case_id, 'negative cost' FROM tampered WHERE cost_usd < 0""", oracle.WITH_RESULTS, TAMPERED))  # fmt: skip
def integrity_mismatches(spark, sf_dir):
    return summary.case_mismatches(_tampered(adapters.results(spark, sf_dir)))


FIELDS = ("average_overall", "pass_rate", "strict_pass_rate", "n_pass", "n_fail", "cases")


@add(q(" UNION ALL ".join(f"SELECT a.run, '{f}' AS field, CAST(b.{f} AS DOUBLE) AS stored, CAST(a.{f} AS DOUBLE) AS derived FROM summary a JOIN forged b USING (run) WHERE abs(CAST(b.{f} AS DOUBLE) - CAST(a.{f} AS DOUBLE)) > 0.11" for f in FIELDS),
       oracle.WITH_RESULTS, TAMPERED, summary_cte(), summary_cte("forged", "tampered", "stored_overall", "stored_verdict")))
def summary_mismatches(spark, sf_dir):
    rows = _tampered(adapters.results(spark, sf_dir))
    stored = summary.summarize(rows.withColumn("overall", F.col("stored_overall")).withColumn("verdict", F.col("stored_verdict")))
    return summary.summary_mismatches(stored.select("run", *FIELDS), summary.summarize(rows).select("run", *FIELDS))


@add(q("""SELECT run, case_id, 'missing' AS problem FROM want ANTI JOIN have USING (run, case_id)
UNION ALL SELECT run, case_id, 'extra' FROM have ANTI JOIN want USING (run, case_id) UNION ALL SELECT run, case_id, 'duplicate' FROM have WHERE n > 1""", BASE,
       """have AS (SELECT run, case_id, CASE WHEN case_id % 31 = 0 THEN 2 ELSE 1 END AS n FROM counts WHERE case_id % 17 <> 0),
want AS (SELECT run, p_partkey AS case_id FROM part CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS run) WHERE p_partkey % 19 <> 0)"""))  # fmt: skip
def forged_idset(spark, sf_dir):
    rows = adapters.counted(spark, sf_dir).select(*KEYS).where(F.col("case_id") % 17 != 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("case_id") % 31 == 0).cast("int"))))
    want = adapters.cases(spark, sf_dir).where(F.col("case_id") % 19 != 0).select(F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))).alias("run"), "case_id")
    return summary.forged_ids(rows, want)


@add(q("SELECT comparable_key, count(*) AS entries, count(*) FILTER (WHERE eligible) AS eligible_entries, max(average_overall) AS best_overall, min(CASE WHEN position = 1 THEN run END) AS leader FROM ranked GROUP BY 1", oracle.WITH_RESULTS, summary_cte(), RANK_SQL))
def leaderboard_groups(spark, sf_dir):
    ranked = _ranked(summary.summarize(adapters.results(spark, sf_dir)))
    return ranked.groupBy("comparable_key").agg(F.count("*").alias("entries"), F.count_if("eligible").alias("eligible_entries"), F.max("average_overall").alias("best_overall"), F.min(F.when(F.col("position") == 1, F.col("run"))).alias("leader"))


# A model for each supplier gives the frontier and the board more than four entries.
BY_SUPPLIER = """m AS (SELECT l_suppkey AS run, CAST(round(sum(l_tax * 100)) AS BIGINT) AS cents, count(*) FILTER (WHERE l_discount >= 0.005) AS good, count(*) AS n FROM lineitem GROUP BY 1),
e0 AS (SELECT run, cents::DOUBLE / 100.0::DOUBLE AS cost, good::DOUBLE / n * 100.0::DOUBLE AS raw, run % 3 AS kind FROM m), e AS (SELECT *, """ + oracle.fx("raw", 4) + " AS score FROM e0)"


def _suppliers(spark, sf_dir) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("cents"), F.count_if(F.col("l_discount") >= 0.005).alias("good"), F.count("*").alias("n")
    )
    return rows.select("run", (F.col("cents").cast("double") / 100.0).alias("cost"), to_fixed(F.col("good").cast("double") / F.col("n") * 100.0, 4).alias("score"), (F.col("run") % 3).alias("kind"))


@add("WITH " + BY_SUPPLIER.replace("round(sum(l_tax * 100))", "sum(round(l_tax * 100))") + " SELECT run, cost, score FROM (SELECT *, max(score) OVER (ORDER BY cost, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) WHERE best IS NULL OR score > best")
def pareto_frontier(spark, sf_dir):
    return summary.pareto_frontier(_suppliers(spark, sf_dir), "cost", "score", "run").select("run", "cost", "score")


@add("WITH " + BY_SUPPLIER.replace("round(sum(l_tax * 100))", "sum(round(l_tax * 100))") + """, g AS (SELECT *, CASE WHEN kind = 0 THEN 'calibration' WHEN kind = 1 THEN 'model' ELSE 'production' END AS board_group FROM e)
SELECT run, board_group, score, CAST(row_number() OVER (ORDER BY CASE board_group WHEN 'production' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, score DESC, run) AS INTEGER) AS position FROM g""")
def site_order(spark, sf_dir):
    kind = F.col("kind")
    rows = _suppliers(spark, sf_dir).withColumn("board_group", summary.board_group(F.when(kind == 0, "mini-agent").otherwise("agent"), F.when(kind == 1, "model").otherwise("company"), F.lit("agent"), F.lit(None).cast("string")))
    rows = rows.withColumns({"average_overall": F.col("score"), "criterion_pass_rate": F.lit(0.0), "all_pass_rate": F.lit(0.0)})
    return summary.board_order(rows).select("run", "board_group", "score", "position")
