"""Queries on whole run artifacts: their verification and their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity, pairing, provenance, reporting, summary
from ..sources import adapters
from . import oracle
from .oracle import q, summary_cte
from .pairing_queries import issues_cte
from .registry import Registry

registry = Registry()
add = registry.add

# ---- Artifacts: each run's cases in suites of 100


def _artifacts(spark, sf_dir) -> DataFrame:
    rows = adapters.stored_results(spark, sf_dir)
    listed = adapters.checks(spark, sf_dir).groupBy("run", "case_id").agg(F.collect_list(F.struct("dim", "id", "name", "severity", "passed", "evidence")).alias("checks"))
    suite = F.floor(F.col("case_id") / 100).cast("string")
    rows = rows.join(listed, ["run", "case_id"]).withColumn("suite", suite).withColumn("run", F.concat_ws("-", F.col("run").cast("string"), "suite"))
    named = {"benchmarkVersion": F.lit("1"), "runName": F.col("run"), "suiteId": F.concat(F.lit("s"), "suite"), "locale": F.lit("en-US"), "track": F.lit("model"), "provider": F.lit("p"), "modelLabel": F.col("run"), "submissionMode": F.lit("predictions")}
    none = {c: F.lit(None).cast("string") for c in ("comparisonClass", "scaffoldId", "judgeProvider", "judgeModel", "scoreMode", "policyId", "judgeTemperature", "judgeMaxTokens", "suiteHash")}
    return integrity.artifacts(rows, F.struct(*(x.alias(c) for c, x in (named | none).items())), ("run", "suite"))


def _forged(runs: DataFrame) -> DataFrame:
    """The artifacts with stored numbers changed after the fact."""
    every = lambda n: lambda c: c["case"]["id"].cast("long") % n == 0
    changes = {
        "combinedOverall": lambda c: c["combinedOverall"] + F.when(every(89)(c), 5.0).otherwise(0.0), "verdict": lambda c: F.when(every(97)(c), F.lit("PASS")).otherwise(c["verdict"]),
        "allPass": lambda c: c["allPass"] != every(83)(c), "criteriaPassed": lambda c: c["criteriaPassed"] + every(79)(c).cast("long"), "costUsd": lambda c: F.when(every(73)(c), -1.0).otherwise(c["costUsd"]),
    }

    def forged(c):
        for name, change in changes.items():
            c = c.withField(name, change(c))
        return c

    suite, m, s = F.col("suite").cast("int"), F.col("manifest"), F.col("summary")
    ids = m["validation"]["expectedIds"]
    return runs.withColumns({
        "results": F.transform("results", forged),
        "manifest": m.withField("comparableKey", F.when(suite % 7 == 0, F.lit("x")).otherwise(m["comparableKey"])).withField("validation", m["validation"].withField("expectedIds", F.when(suite % 5 == 0, F.slice(ids, 2, 1_000_000)).otherwise(ids))),
        "summary": s.withField("passRate", s["passRate"] + F.when(suite % 3 == 1, 1.0).otherwise(0.0)),
    })


KEY = "'1::s' || suite || '::en-US::model::model::none::none::none::conservative-min'"
FORGED = """t AS (SELECT * REPLACE (run || '-' || (case_id // 100) AS run), case_id // 100 AS suite FROM results),
f AS (SELECT *, overall + CASE WHEN case_id % 89 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS so, CASE WHEN case_id % 97 = 0 THEN 'PASS' ELSE verdict END AS sv, all_pass <> (case_id % 83 = 0) AS sa, criteria_passed + (case_id % 79 = 0)::INT AS sp,
  CASE WHEN case_id % 73 = 0 THEN -1.0::DOUBLE ELSE cost_usd END AS sc FROM t),
n AS (SELECT run, any_value(suite) AS suite, count(*) AS n FROM t GROUP BY 1)"""
said = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _wrong(what: str, want: str, got: str) -> str:
    return f"{what} || ' mismatch: expected ' || {want} || ', got ' || {got}"


CASE_RULES = (
    ("abs(so - overall) > 0.11", _wrong("c || ' combinedOverall'", said("overall"), said("so"))), ("sv <> verdict", _wrong("c || ' verdict'", "verdict", "sv")),
    ("critical_failed > 0 AND sv <> 'FAIL'", "c || ' verdict must be FAIL: a critical finding failure cannot be rescued (got ' || sv || ')'"), ("sa <> all_pass", _wrong("c || ' allPass'", "all_pass", "sa")),
    ("sp <> criteria_passed", _wrong("c || ' criteriaPassed'", "criteria_passed", "sp")), ("sc < 0", "c || ' has negative cost'"),
)


@add(q(" UNION ALL ".join([
    *(f"SELECT run, {text} AS error FROM (SELECT *, 'case ' || case_id AS c FROM f) WHERE {test}" for test, text in CASE_RULES),
    f"SELECT run, {_wrong(repr('comparableKey'), KEY, repr('x'))} FROM n WHERE suite % 7 = 0",
    "SELECT run, 'valid run result id-set does not match the locked suite (expected ' || (n - 1) || ' unique ids, got ' || n || ')' FROM n WHERE suite % 5 = 0",
    f"SELECT run, {_wrong(repr('summary.passRate'), said('pass_rate'), said('(pass_rate + 1)'))} FROM summary JOIN n USING (run) WHERE suite % 3 = 1",
    f"SELECT run, {_wrong(repr('summary.averageOverall'), said('b.average_overall'), said('a.average_overall'))} FROM summary a JOIN changed b USING (run) WHERE abs(a.average_overall - b.average_overall) > 0.11",
    f"SELECT run, {_wrong(repr('summary.totalCostUsd'), said('b.total_cost_usd'), said('a.total_cost_usd'))} FROM summary a JOIN changed b USING (run) WHERE abs(a.total_cost_usd - b.total_cost_usd) > 0.11",
]), oracle.WITH_RESULTS, FORGED, summary_cte("summary", "t"), summary_cte("changed", "(SELECT * REPLACE (so AS overall, sc AS cost_usd) FROM f)")))
def run_integrity(spark, sf_dir):
    """Mismatches of run artifacts, some of whose stored numbers were changed."""
    found = integrity.audited(_forged(_artifacts(spark, sf_dir)).withColumn("source", F.col("run")))
    return found.select(F.col("source").alias("run"), F.explode("errors").alias("error"))


@add(q("SELECT run, CAST(count(*) AS INTEGER) AS cases FROM t GROUP BY 1", oracle.WITH_RESULTS, "t AS (SELECT run || '-' || (case_id // 100) AS run FROM results)"))
def verified_runs(spark, sf_dir):
    """Honest artifacts pass, and their cases are all there."""
    return integrity.verified(_artifacts(spark, sf_dir)).select("manifest.runName", F.size("results").alias("cases")).toDF("run", "cases")



# ---- A Merkle tree over all documents

TREE = """l AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS place, sha256(CAST(doc_id AS VARCHAR) || chr(10) || CASE WHEN text IS NULL THEN '-' ELSE '=' || sha256(text) END) AS hash FROM documents),
d AS (SELECT CAST(count(*) > 256 AS INT) + CAST(count(*) > 65536 AS INT) AS d FROM l),
low AS (SELECT substr(place, 1, 2 * d) AS prefix, sha256(string_agg(hash, '' ORDER BY place)) AS hash, count(*) AS n, any_value(d) AS d FROM l CROSS JOIN d GROUP BY 1),
mid AS (SELECT substr(prefix, 1, 2) AS prefix, CASE WHEN any_value(d) = 2 THEN sha256(string_agg(hash, '' ORDER BY prefix)) ELSE any_value(hash) END AS hash, sum(n) AS n, any_value(d) AS d FROM low GROUP BY 1),
top AS (SELECT '' AS prefix, CASE WHEN any_value(d) = 0 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY prefix)) END AS hash, sum(n) AS n FROM mid)"""


@add(f"WITH {TREE} SELECT 0 AS level, prefix, hash, CAST(n AS BIGINT) AS n FROM top UNION ALL SELECT 1, prefix, hash, CAST(n AS BIGINT) FROM mid WHERE d >= 1 UNION ALL SELECT 2, prefix, hash, n FROM low WHERE d = 2")
def provenance_tree(spark, sf_dir):
    """Every node of the tree over the documents' ids and texts (the SQL knows up to two levels below the root)."""
    return provenance.tree(provenance.leaves(adapters.table(spark, sf_dir, "documents"), "doc_id", "text"))


@add("SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 50 = 7 THEN 'removed' WHEN doc_id % 50 = 8 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 50 IN (7, 8) OR doc_id % 50 = 9 AND text IS NOT NULL")
def provenance_changes(spark, sf_dir):
    """What differs between two states of the documents, found below differing nodes only."""
    docs = adapters.table(spark, sf_dir, "documents")
    before = docs.where("doc_id % 50 <> 8")
    after = docs.where("doc_id % 50 <> 7").withColumn("text", F.when(F.col("doc_id") % 50 == 9, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return provenance.changed(provenance.leaves(before, "doc_id", "text"), provenance.leaves(after, "doc_id", "text"))


# ---- Reports


def _cube_sql() -> str:
    keys = ("run", "stratum", "dim")
    part = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in keys) + ")"
    sets = ", ".join(f"({', '.join(s)})" for s in reporting.SETS)
    return f"""SELECT {part} AS part, run, stratum, dim, count(*) AS failed_checks, count(*) FILTER (WHERE adjudication = 'system_error') AS system_errors, count(*) FILTER (WHERE adjudication = 'evaluator_limitation') AS evaluator_limitations,
  count(*) FILTER (WHERE adjudication = 'review_needed') AS review_needed, coalesce(sum(weight) FILTER (WHERE adjudication = 'system_error'), 0.0::DOUBLE) AS system_weight, sum(weight) AS raw_weight FROM issues GROUP BY GROUPING SETS ({sets})"""


@add(q(_cube_sql(), oracle.BASE, issues_cte(True)))
def audit_cube(spark, sf_dir):
    """All tables and totals of the audit of failed checks, by run, stratum and dimension, in one aggregation."""
    issues = pairing.failed_issues(adapters.checks(spark, sf_dir)).withColumns({"stratum": pairing.stratum(), "adjudication": pairing.adjudication(True)})
    return reporting.audit_cube(issues).drop("about_cases")


def _score_cube_sql() -> str:
    keys = ("run", "modality", "difficulty")
    part = "concat_ws(',', " + ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in keys) + ")"
    rates = {"mean": oracle.mean_tenths("overall"), "pass_rate": oracle.share("verdict <> 'FAIL'"), "strict_rate": oracle.share("verdict = 'PASS'"), "all_pass_rate": oracle.share("all_pass")}
    raw = f"SELECT {part} AS part, run, modality, difficulty, count(*) AS cases, " + ", ".join(f"{x} AS {k}" for k, x in rates.items()) + " FROM u GROUP BY CUBE (run, modality, difficulty)"
    return f"SELECT part, run, modality, difficulty, cases, {', '.join(f'{oracle.fx(k, 1)} AS {k}' for k in rates)} FROM ({raw})"


@add(q(_score_cube_sql(), oracle.WITH_RESULTS, "u AS (SELECT CAST(run AS VARCHAR) AS run, coalesce(modality, 'unspecified') AS modality, coalesce(difficulty, 'unspecified') AS difficulty, overall, verdict, all_pass FROM results)"))
def score_cube(spark, sf_dir):
    """Scores and rates by every subset of run, modality and difficulty."""
    return reporting.score_cube(adapters.results(spark, sf_dir))


GROUPS = "CASE p_partkey % 6 WHEN 0 THEN 'Zulu' WHEN 1 THEN 'alpha' WHEN 2 THEN 'Alpha' WHEN 3 THEN 'ähnlich' WHEN 4 THEN 'beta' ELSE 'Beta' END"


@add(f"""WITH e AS (SELECT {GROUPS} AS comparable_key, CAST(p_partkey AS VARCHAR) AS run, p_partkey % 3 <> 0 AS eligible, p_size * 1.0::DOUBLE AS average_overall FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY comparable_key ORDER BY eligible DESC, average_overall DESC, run) AS position FROM e)
SELECT CAST(row_number() OVER (ORDER BY CASE comparable_key WHEN 'ähnlich' THEN 1 WHEN 'alpha' THEN 2 WHEN 'Alpha' THEN 3 WHEN 'beta' THEN 4 WHEN 'Beta' THEN 5 ELSE 6 END, position) - 1 AS BIGINT) AS place, comparable_key, run, CAST(CASE WHEN eligible THEN position END AS INTEGER) AS rank FROM g""")
def groups_in_order(spark, sf_dir):
    """Ranked entries of groups whose names differ by case and accents, in the order of the root locale."""
    from ..sources.scratch import with_position

    parts = adapters.table(spark, sf_dir, "part").where("p_partkey % 2 = 0 or p_partkey % 3 = 0")
    rows = parts.select(F.expr(GROUPS).alias("comparable_key"), F.col("p_partkey").cast("string").alias("run"), (F.col("p_partkey") % 3 != 0).alias("eligible"), F.col("p_size").cast("double").alias("average_overall"))
    rest = {c: F.lit(0.0) for c, _ in summary.ORDER if c not in rows.columns}
    placed = with_position(summary.rank_entries(rows.withColumns(rest)), F.collate("comparable_key", "UNICODE"), F.col("comparable_key"), F.col("position"), name="place")
    return placed.select("place", "comparable_key", "run", "rank")
