"""Rules over files and texts before publication, provenance hashes, and cleaned telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json

# Which paths and contents break which rule, and what makes a public artifact one that claims something.
RAW = r"(?i)\.(?:csv|tsv|xlsx?|parquet|arrow|feather|sqlite3?|db|duckdb|dcm|dicom|nii(?:\.gz)?|mha)$"
PRIVATE = r"(?i)(?:^|/)(?:data/(?:raw|private|gated|hidden|official|source|corpus)|private-data|corpus|cases/(?:private|hidden|gated|official))(?:/|$)"
NAME = r"(?i)(?:clean[_-]?\d+k|train-00000-of-|test-00000-of-|merged.*\.csv)"
SECRET = r"\b(?:sk_live|sk-lf|ghp|gho|supabase_service_role)_[A-Za-z0-9_-]{12,}\b"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
DERIVED = r"(?i)(?:Merged CSV fixture|MERGED-PTBR-|public-merged-csv|merged-csv|CSV mesclado)"
ANSWERS = r'"(?:goldFindings|criticalFindings|referenceReport|guidelineExpectations|retrievalGold)"\s*:'
CLAIM_FILE = r"(?i)^(?:site/data\.js|leaderboard/(?:.*/)?[^/]+\.md|DATA_ACCESS_POLICY\.md)$"
CASE_FILE = (r"^(?:cases/|leaderboard/(?:artifacts|frozen)/|runs/)", r"(?i)\.(?:json|jsonl|csv|tsv)$")
DATED_FILE = r"^(cases|leaderboard|site)/"
CLAIM = r"(?:clinically reviewed|clinically validated|clinical validation|radiologist[- ]adjudicated|independent (?:third[- ]party )?(?:validation|adjudication|review)|third[- ]party (?:validation|adjudication|review)|externally validated|independently validated|clinicamente (?:validad|revisad)\w*|valida[çc][ãa]o cl[íi]nica|adjudicad\w* por radiologista|validad\w* (?:de forma )?independente|valida[çc][ãa]o (?:independente|de terceiros)|revis[ãa]o (?:independente|de terceiros)|validad\w* externamente)"
DENIAL = r"\b(?:not|never|no|without|tracked as future work|future work|must not|cannot|is not|are not|were not|was not|internal data[- ]quality|not an? independent|not a? third[- ]party|n[ãa]o|nem|sem|processo interno de qualidade|qualidade interna|trabalho futuro)\b"
CLAUSE = r",|\b(?:and|but|yet|while|whereas|however|though|although|mas|porem|porém|contudo|entretanto|todavia)\b"


def asserts_validation(content: Column) -> Column:
    """A sentence claims validation, and nothing before the claim in its clause takes it back."""

    def claims(sentence: Column) -> Column:
        before = F.regexp_extract(sentence, f"(?isu)^(.*?)\\b{CLAIM}\\b", 1)
        clause = F.element_at(F.split(before, f"(?iu){CLAUSE}"), -1)
        return sentence.rlike(f"(?iu)\\b{CLAIM}\\b") & ~clause.rlike(f"(?iu){DENIAL}")

    return F.exists(F.split(F.coalesce(content, F.lit("")), r"(?<=[.;])\s+|\n+"), claims)


def issues(files: DataFrame, mode: str = "public", substantiated: bool = False) -> DataFrame:
    """(path, rule, severity) for each rule that a file breaks. Paths are compared with forward slashes.

    mode: private repositories may track private paths (a warning) and aren't asked for what only publication forbids.
    substantiated: a signed adjudication record backs the published suites, see `backed`.
    """
    if mode not in ("private", "public"):
        raise ValueError(f"mode must be private or public, not {mode}")
    public = F.lit(mode == "public")
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    named = files.select(path.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    p, c = F.col("path"), F.col("content")
    claim_file = p.rlike(CLAIM_FILE)
    rules = [
        ("raw-data-extension", "error", p.rlike(RAW)),
        ("private-path-public-release" if mode == "public" else "private-path-tracked", "error" if mode == "public" else "warn", p.rlike(PRIVATE)),
        ("private-corpus-name", "error", p.rlike(NAME)),
        ("secret-pattern", "error", c.rlike(SECRET)),
        ("public-derived-marker", "error", public & p.rlike(CASE_FILE[0]) & p.rlike(CASE_FILE[1]) & c.rlike(DERIVED)),
        ("public-answer-key", "error", public & (p.rlike("^cases/public/") | claim_file) & c.rlike(ANSWERS)),
        ("calendar-date-public-artifact", "error", public & p.rlike(DATED_FILE) & c.rlike(DATE)),
        ("unsubstantiated-clinical-validation-claim", "error", public & F.lit(not substantiated) & claim_file & asserts_validation(c)),
    ]
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, broken in rules)))
    return named.select("path", F.explode(found).alias("x")).select("path", "x.*")


def published_suites(files: DataFrame) -> DataFrame:
    """Distinct suite hashes that files which claim something publish."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    hashes = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r'(?i)"suiteHash"\s*:\s*"([0-9a-f]{16,})"'), 1)
    return files.where(path.rlike(CLAIM_FILE)).select(F.explode(hashes).alias("suite_hash")).distinct()


def backed(files: DataFrame, records: DataFrame) -> bool:
    """A valid adjudication record (see adjudication.validated) speaks of a published suite, or of any if none is published."""
    good = records.where("valid")
    suites = published_suites(files)
    if not suites.limit(1).count():
        return good.limit(1).count() > 0
    return good.join(suites, "suite_hash", "left_semi").limit(1).count() > 0


def chain_hash(hashes: DataFrame, column: str, keys=()) -> DataFrame:
    """sha256 over the sorted list of hashes as JSON text: a hash of each group (of a suite's cases, not of a corpus)."""
    listed = F.to_json(F.array_sort(F.collect_list(column)))
    return hashes.groupBy(*keys).agg(F.sha2(listed, 256).alias("hash"), F.count("*").alias("n"))


# What of a run's configuration its hash binds, by the names in the hashed text, with what stands for a missing value.
RUN_FIELDS = {
    "benchmarkVersion": "benchmark_version", "suiteId": "suite_id", "locale": "locale", "track": "track", "provider": "provider", "modelLabel": "model_label", "scaffoldId": "scaffold_id", "judgeProvider": "judge_provider",
    "judgeModel": "judge_model", "judgeTemperature": "judge_temperature", "judgeMaxTokens": "judge_max_tokens", "policyId": "policy_id", "submissionMode": "submission_mode", "scoreMode": "score_mode",
}


def run_hash(suite_hash: Column, scoring_hash: Column) -> Column:
    """sha256 over the suite's hash, the canonical configuration and the hash of the scoring code; columns are named as in RUN_FIELDS."""
    fields = {k: F.coalesce(F.col(c), F.lit("conservative-min")) if k == "scoreMode" else F.col(c) for k, c in RUN_FIELDS.items()}
    # Whole numbers have no fraction in the hashed text.
    texts = [F.concat(F.lit(f'"{k}":'), F.regexp_replace(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1), r"^(-?\d+)\.0$", "$1")) for k, x in sorted(fields.items())]
    return F.sha2(F.concat_ws("|", suite_hash, F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}")), scoring_hash), 256)


def board_hash(runs: DataFrame) -> DataFrame:
    """One hash over a board's runs: the sorted hashes of name, suite, label and average (one row for each run of a board)."""
    line = canonical_json(("runName", F.col("run")), ("suiteHash", F.col("suite_hash")), ("modelLabel", F.col("model_label")), ("average", F.col("average_overall")))
    return chain_hash(runs.select(F.sha2(line, 256).alias("run_hash")), "run_hash")


def telemetry(events: DataFrame, allowed: tuple[str, ...], salt: str) -> DataFrame:
    """Allowed events with cleaned labels and salted hashes of who sent them."""
    clean = lambda c, n: F.nullif(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_ .:/?#=&%+@-]", ""), 1, n), F.lit(""))
    return events.where(F.col("event").isin(*allowed)).select(
        "id", "event", clean("target", 180).alias("target"), F.when(F.col("sender").isNotNull(), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "sender"), 256), 1, 24)).alias("sender_hash")
    )


# How much of each field is kept.
KEPT = {"path": 180, "target": 180, "label": 80, "country": 8}


def telemetry_record(requests: DataFrame, allowed: tuple[str, ...], artifact: str, salt: str) -> DataFrame:
    """(id, ts, event, artifact_id, path, target, label, country, referrer_host, ip_hash, ua_hash) of requests with an allowed event, ready for a webhook.

    requests: id, ts, event, path, target, label, country, referrer (an address), ip (the first of forwarded ones counts), user_agent. Who
    sent them is kept as salted hashes only; what isn't there stays null.
    """
    clean = lambda c, n: F.nullif(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_ .:/?#=&%+@-]", ""), 1, n), F.lit(""))
    hashed = lambda x: F.when(F.nullif(x, F.lit("")).isNotNull(), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), x), 256), 1, 24))
    event = clean(F.col("event"), 48)
    rows = requests.where(event.isin(*allowed))
    return rows.select(
        "id", "ts", event.alias("event"), F.lit(artifact).alias("artifact_id"), *(clean(F.col(c), n).alias(c) for c, n in KEPT.items()),
        F.substring(F.try_parse_url("referrer", F.lit("HOST")), 1, 120).alias("referrer_host"), hashed(F.trim(F.split_part("ip", F.lit(","), F.lit(1)))).alias("ip_hash"), hashed(F.col("user_agent")).alias("ua_hash"),
    )
