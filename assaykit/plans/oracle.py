"""SQL of the scoring queries for an independent engine, built from named steps. Doubles are added in the engine's fixed order."""

from __future__ import annotations

from ..functions.rounding import to_fixed_sql as fx
from ..operators.scoring import CLINICAL, DIMS, POLICIES, WEIGHTS, Policy

DIM_CASE = "CASE (l_linenumber - 1) % 5 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIMS)) + " END"
IDS = ("C01", "QG01", "T00", "G01", "R02", "Q10", "X99")
ID_CASE = "CASE (l_linenumber - 1) % 7 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(IDS)) + " END"
CHECKS = f"""checks AS (
  SELECT l_suppkey % 4 AS run, l_partkey AS case_id, {DIM_CASE} AS dim,
    CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'major' ELSE 'minor' END AS severity, l_discount >= 0.005 AS passed,
    l_quantity AS ms, CAST(round(l_tax * 100) AS BIGINT) AS cents, {ID_CASE} AS id, 
    CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'exact=0 partial=0 missed=2 total=2' WHEN 2 THEN 'exact=1 partial=0 missed=1 total=2' WHEN 3 THEN 'BI-RADS not mentioned' WHEN 4 THEN 'lesion of 5 mm' ELSE 'forbidden opener' END AS evidence,
    'check' AS name, CASE l_partkey % 3 WHEN 0 THEN 'bi rads 2, left knee' WHEN 1 THEN 'lesion 0,5 cm' ELSE 'none' END AS report
  FROM lineitem)"""
COUNTS = "counts AS (SELECT run, case_id, " + ", ".join(
    f"count(*) FILTER (WHERE dim = '{d}' AND passed) AS pass_{d}, count(*) FILTER (WHERE dim = '{d}') AS total_{d}, "
    f"count(*) FILTER (WHERE dim = '{d}' AND NOT passed AND severity = 'critical') AS crit_{d}, "
    f"count(*) FILTER (WHERE dim = '{d}' AND NOT passed AND severity = 'major') AS major_{d}"
    for d in DIMS
) + """, count(*) FILTER (WHERE passed) AS criteria_passed, count(*) AS criteria_total, bool_and(passed) AS all_pass,
  count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS critical_failed, count(*) FILTER (WHERE NOT passed AND severity = 'major') AS major_failed,
  sum(ms) AS latency_ms, CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE AS cost_usd FROM checks GROUP BY 1, 2)"""
CASES = """cases AS (SELECT p_partkey AS case_id, p_name AS label,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_size <= 17 THEN 'easy' WHEN p_size <= 34 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE p_size % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'MRI' WHEN 2 THEN 'US' ELSE 'XR' END AS modality FROM part)"""


def weighted(prefix: str, weights: dict[str, float]) -> str:
    total = "0.0::DOUBLE"
    for d in DIMS:
        total = f"({total} + CASE WHEN {prefix}{d} IS NOT NULL THEN {weights[d]!r}::DOUBLE ELSE 0.0::DOUBLE END)"
    total = f"(CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE {total} END)"
    out = "0.0::DOUBLE"
    for d in DIMS:
        out = f"({out} + coalesce({prefix}{d} * ({weights[d]!r}::DOUBLE / {total}), 0.0::DOUBLE))"
    return out


def cap_sql(score: str, crit: str, major: str) -> str:
    return f"CASE WHEN {crit} > 0 THEN least({score}, greatest(20.0::DOUBLE, 60.0::DOUBLE - least({crit} - 1, 2) * 20.0::DOUBLE)) WHEN {major} >= 3 THEN least({score}, 70.0::DOUBLE) ELSE {score} END"


SCORED = (
    "pct AS (SELECT *, " + ", ".join(f"CASE WHEN total_{d} > 0 THEN pass_{d}::DOUBLE / total_{d} * 100.0::DOUBLE END AS pct_{d}" for d in DIMS) + " FROM counts),\n"
    "rounded AS (SELECT *, " + ", ".join(f"{fx(f'pct_{d}', 1)} AS r_{d}" for d in DIMS) + " FROM pct),\n"
    "dimmed AS (SELECT *, " + ", ".join(f"CASE WHEN total_{d} > 0 THEN {cap_sql(f'r_{d}', f'crit_{d}', f'major_{d}')} END AS score_{d}" for d in DIMS) + " FROM rounded),\n"
    "named AS (SELECT *, " + ", ".join(f"CASE WHEN score_{d} IS NULL THEN 'UNSCORED' WHEN crit_{d} > 0 THEN 'FAIL' WHEN pass_{d} = total_{d} THEN 'PASS' WHEN score_{d} >= 80 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict_{d}" for d in DIMS)
    + f", {weighted('score_', WEIGHTS)} AS det_raw FROM dimmed),\n"
    f"scored AS (SELECT *, {fx('det_raw', 1)} AS det_overall FROM named)"
)


def judged_cte() -> str:
    value = lambda k: f"CASE WHEN case_id % 7 = 0 THEN ((base + {k}) % 6)::DOUBLE ELSE ((base * 3 + {k * 11}) % 101)::DOUBLE END"
    return (
        "based AS (SELECT *, CAST(latency_ms AS BIGINT) AS base, case_id % 3 <> 0 AS has_judge FROM scored),\n"
        "judged AS (SELECT *, " + ", ".join(f"CASE WHEN has_judge AND (case_id + {k}) % 5 <> 0 THEN {value(k)} END AS judge_{d}" for k, d in enumerate(DIMS))
        + f", CASE WHEN has_judge THEN {value(9)} END AS judge_overall, CASE WHEN has_judge THEN CAST(case_id % 11 = 0 AS INTEGER) END AS judge_critical,"
        " CASE WHEN has_judge THEN CAST(case_id % 4 = 1 AS INTEGER) END AS judge_missing, 0 AS judge_hallucinated FROM based)"
    )


def combined_cte(source: str = "scored", judged: bool = False, policy: Policy = POLICIES["research"], judge_primary: bool = False) -> str:
    """Steps that end in `combined`."""
    below, w = round(policy.pass_at - 0.1, 1), {d: policy.share(d) for d in DIMS}
    if judged:
        every = "[" + ", ".join([*(f"judge_{d}" for d in DIMS), "judge_overall"]) + "]"
        given = f"list_filter({every}, lambda x: x IS NOT NULL)"
        steps = [f"c0 AS (SELECT *, len({given}) > 0 AND len(list_filter({given}, lambda x: x > 5)) = 0 AS likert FROM {source})"]
        steps.append("c1 AS (SELECT *, " + ", ".join(f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, judge_{d} * CASE WHEN likert THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END)) AS jr_{d}" for d in DIMS) + " FROM c0)")
        steps.append("c2 AS (SELECT *, " + ", ".join(f"CASE WHEN judge_{d} IS NOT NULL THEN {fx(f'jr_{d}', 1)} END AS jh_{d}" for d in DIMS) + " FROM c1)")
        both = lambda d: f"jh_{d}" if judge_primary and d not in CLINICAL else f"least(score_{d}, jh_{d})"
        steps.append("c3 AS (SELECT *, " + ", ".join(f"CASE WHEN score_{d} IS NULL THEN NULL WHEN jh_{d} IS NULL THEN score_{d} ELSE {both(d)} END AS combined_{d}" for d in DIMS) + ", coalesce(judge_critical, 0) AS jc FROM c2)")
    else:
        steps = ["c3 AS (SELECT *, " + ", ".join(f"score_{d} AS combined_{d}" for d in DIMS) + f", 0 AS jc, FALSE AS has_judge, 0 AS judge_missing, 0 AS judge_hallucinated FROM {source})"]
    steps.append(f"c4 AS (SELECT *, {weighted('combined_', w)} AS o0, critical_failed + jc AS ncrit, greatest(0.0::DOUBLE, 99.9::DOUBLE - ((critical_failed + jc) * 4 + major_failed * 2)::DOUBLE * 4.0::DOUBLE) AS room FROM c3)")
    steps.append(f"c5 AS (SELECT *, CASE WHEN ncrit > 0 THEN 59.9::DOUBLE WHEN ncrit * 4 + major_failed * 2 > 0 THEN {fx('room', 1)} END AS cap FROM c4)")
    steps.append("c6 AS (SELECT *, cap IS NOT NULL AND o0 > cap AS g1, CASE WHEN cap IS NOT NULL AND o0 > cap THEN cap ELSE o0 END AS o1 FROM c5)")
    failed = " OR ".join(f"verdict_{d} = 'FAIL'" for d in DIMS)
    gate = lambda i, test: f"c{6 + i} AS (SELECT *, ({test}) AND o{i} >= {policy.pass_at} AS g{i + 1}, CASE WHEN ({test}) AND o{i} >= {policy.pass_at} THEN {below}::DOUBLE ELSE o{i} END AS o{i + 1} FROM c{5 + i})"
    weak = " OR ".join(f"coalesce(combined_{d} < {policy.pass_at}, FALSE)" for d in CLINICAL)
    steps += [gate(1, failed), gate(2, "combined_CRIT IS NULL AND combined_QUAL IS NULL"), gate(3, weak)]
    names = "concat_ws('/', " + ", ".join(f"CASE WHEN combined_{d} < {policy.pass_at} THEN '{d}' END" for d in CLINICAL) + ")"
    reasons = f"""list_filter([CASE WHEN g1 THEN CASE WHEN ncrit > 0 THEN 'cap: critical failure' ELSE 'cap: severe weight ' || CAST(ncrit * 4 + major_failed * 2 AS VARCHAR) END END,
      CASE WHEN g2 THEN 'cap: failed dimension' END, CASE WHEN g3 THEN 'no clinical dimension scored' END, CASE WHEN g4 THEN 'weak clinical: ' || {names} END,
      CASE WHEN critical_failed > 0 THEN 'critical check failed' END, CASE WHEN jc > 0 THEN 'judge found critical failure' END], lambda x: x IS NOT NULL)"""
    forced = "critical_failed > 0 OR jc > 0" if policy.critical_forces_fail else "FALSE"
    steps.append(f"c10 AS (SELECT *, {reasons} AS gate_reasons, {fx('o4', 1)} AS overall, CASE WHEN has_judge THEN 'complete' ELSE 'degraded' END AS phase, CASE WHEN {forced} THEN 'FAIL' WHEN o4 >= {policy.pass_at} THEN 'PASS' WHEN o4 >= {policy.partial_at} THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM c9)")
    steps.append(f"""combined AS (SELECT *, CASE WHEN NOT has_judge AND o4 >= 80 AND critical_failed = 0 THEN 'medium' WHEN NOT has_judge THEN 'low'
      WHEN coalesce(judge_missing, 0) + coalesce(judge_hallucinated, 0) > 0 OR o4 < {policy.pass_at} OR len(gate_reasons) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM c10)""")
    return ",\n".join(steps)


BASE = f"WITH {CHECKS},\n{COUNTS}"
WITH_SCORED = f"{BASE},\n{SCORED}"
WITH_RESULTS = f"{WITH_SCORED},\n{combined_cte()},\n{CASES},\nresults AS (SELECT combined.*, label, difficulty, modality FROM combined LEFT JOIN cases USING (case_id))"


def mean_tenths(x: str) -> str:
    return f"(CAST(sum(CAST(round({x} * 10) AS BIGINT)) AS DOUBLE) / 10.0::DOUBLE / count({x}))"


def share(condition: str) -> str:
    return f"(CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE) / count(*) * 100.0::DOUBLE)"


RATES = {
    "average_overall": mean_tenths("overall"), "pass_rate": share("verdict <> 'FAIL'"), "strict_pass_rate": share("verdict = 'PASS'"), "all_pass_rate": share("all_pass"),
    "criterion_pass_rate": "(CAST(sum(criteria_passed) AS DOUBLE) / CAST(sum(criteria_total) AS DOUBLE) * 100.0::DOUBLE)",
}


def summary_cte(name: str = "summary", source: str = "results", overall: str = "overall", verdict: str = "verdict") -> str:
    raw = {**RATES, "average_latency_ms": "(sum(latency_ms) / count(*))", **{f"average_{d}": mean_tenths(f"combined_{d}") for d in DIMS}}
    raw = {k: v.replace("overall", overall) if k == "average_overall" else v.replace("verdict", verdict) for k, v in raw.items()}
    counts = ", ".join(f"count(*) FILTER (WHERE {verdict} = '{v}') AS n_{v.lower()}" for v in ("PASS", "PARTIAL", "FAIL"))
    return (
        f"{name}_raw AS (SELECT run, count(*) AS cases, {counts}, count(*) FILTER (WHERE all_pass) AS all_pass_count, CAST(sum(criteria_passed) AS BIGINT) AS criteria_passed, CAST(sum(criteria_total) AS BIGINT) AS criteria_total, "
        + ", ".join(f"{v} AS {k}" for k, v in raw.items()) + f", CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6::DOUBLE AS total_cost_usd FROM {source} GROUP BY run),\n"
        f"{name} AS (SELECT run, cases, n_pass, n_partial, n_fail, all_pass_count, criteria_passed, criteria_total, " + ", ".join(f"{fx(k, 1)} AS {k}" for k in raw) + f", {fx('total_cost_usd', 6)} AS total_cost_usd FROM {name}_raw)"
    )


def q(body: str, start: str = WITH_RESULTS, *more: str) -> str:
    return ",\n".join([start, *more]) + "\n" + body
