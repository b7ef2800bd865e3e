"""The public board: what a run is called, what may be shown of it, and when it may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What labels must not show, in order; which scaffolds are called product agents.
HIDDEN = (
    (r"(?i)\s*\(@[a-z0-9_.-]+/[^)]+\)", ""), (r"(?i)@[a-z0-9_.-]+/[a-z0-9_.-]+", "private configuration"), (r"(?i)\b(openrouter|openai-compatible|supabase|vercel)\b", "private"),
    (r"(?i)/api/[a-z0-9_./-]+", "product reporting flow"), (r"(?i)https?://\S+", "private target"),
)
PRODUCT_SCAFFOLD = "(?i)pipeline|endpoint|route|api"
DEFAULT_TRACK = {"openrouter": "mini-agent", "openai-compatible": "mini-agent", "command": "agent"}
#: Defaults of a deployment: what product agents are called, and the scaffold of the mini-agent track.
PRODUCTS = "(?i)product agent|reporting agent"
MINI_SCAFFOLD = "mini-agent-v1"


def public_label(x: Column) -> Column:
    for pattern, by in HIDDEN:
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def default_track(provider: Column) -> Column:
    return F.coalesce(*(F.when(provider == p, t) for p, t in DEFAULT_TRACK.items()), F.lit("model"))


def scaffold(track: Column, own: Column, default: str = MINI_SCAFFOLD) -> Column:
    """A run's scaffold: its own, or the default one on the mini-agent track."""
    return F.coalesce(own, F.when(track == "mini-agent", default))


def public_scaffold(x: Column, products: str = PRODUCTS) -> Column:
    return F.when(x.rlike(PRODUCT_SCAFFOLD) | x.rlike(products), "product-agent").otherwise(public_label(F.nullif(x, F.lit(""))))


def system_type(track: Column, provider: Column, label: Column, products: str = PRODUCTS) -> Column:
    product = label.rlike(products) & (provider == "command")
    return F.when(track == "model", "raw-model").when(track == "mini-agent", "mini-agent").when(product, "product-agent").otherwise("custom-agent")


def entity_type(system: Column) -> Column:
    return F.when(system == "raw-model", "model").when(system == "product-agent", "company").otherwise("agent")


def public_entries(runs: DataFrame, products: str = PRODUCTS) -> DataFrame:
    """runs (manifest columns; products: a pattern of the labels of product agents) with public_key, public_system_label, entity_name, entity_type, system_type and comparison_class as the board shows them."""
    c = F.col
    raw = F.coalesce("model_label", F.lit("unknown"))
    product = raw.rlike(products) | F.coalesce(c("entity_name").rlike(products), F.lit(False))
    system = F.coalesce("system_type", F.when(c("track") == "model", "raw-model").when(c("track") == "mini-agent", "mini-agent").when(product, "product-agent").otherwise("custom-agent"))
    own = F.when(product, "Reporting agent").otherwise(public_label(raw))
    rows = runs.withColumns({"system_type": system, "entity_name": public_label(F.coalesce("entity_name", own)), "public_system_label": own, "_class": public_label(F.coalesce("comparison_class", system)), "_key_class": public_label(F.coalesce("comparison_class", "system_type", "track"))})
    mode = F.when(c("judge_model").isNotNull(), F.concat(F.lit("judged-frozen-"), F.coalesce("score_mode", F.lit("conservative-min")))).otherwise("deterministic")
    key = F.concat_ws("::", "benchmark_version", "suite_id", "locale", "track", c("_key_class"), F.coalesce(public_scaffold(c("scaffold_id"), products), F.lit("none")), mode)
    rows = rows.withColumn("entity_type", F.coalesce("entity_type", entity_type(c("system_type"))))
    rows = rows.withColumns({"public_key": key, "judge_model": F.when(c("judge_model").isNotNull(), "hidden"), "comparison_class": c("_class")})
    return rows.drop("_class", "_key_class")


def public_validation(v: DataFrame) -> DataFrame:
    """Validation of a submission without ids: counts, and errors by kind. v: valid, errors and the arrays of ids."""
    n = {"expected_count": "expected_ids", "received_count": "received_ids", "missing_count": "missing_ids", "duplicate_count": "duplicate_ids", "extra_count": "extra_ids", "empty_output_count": "empty_outputs"}
    counted = v.withColumns({k: F.size(c) for k, c in n.items()})
    kinds = (("missing cases:", "missing_count"), ("duplicate cases:", "duplicate_count"), ("extra cases:", "extra_count"), ("empty outputs:", "empty_output_count"))

    def shown(e: Column) -> Column:
        out = F
        for text, count in kinds:
            out = out.when(e.rlike(f"(?i)^{text}"), F.concat(F.lit(f"{text} "), F.col(count).cast("string")))
        out = out.when(e.rlike("(?i)metadata must be an object"), public_label(e)).when(e.rlike("(?i)malformed jsonl"), F.lit("malformed prediction file"))
        return out.otherwise("invalid submission details withheld")

    return counted.select(*(c for c in v.columns if c not in (*n.values(), "errors")), *n, F.transform("errors", shown).alias("errors"))


def board_entries(runs: DataFrame) -> DataFrame:
    """Rates in percent as fractions, for the page of the board."""
    rates = [c for c in ("pass_rate", "strict_pass_rate", "all_pass_rate", "criterion_pass_rate", "accuracy_rate") if c in runs.columns]
    return runs.withColumns({c: F.col(c) / 100.0 for c in rates})


def run_mismatches(runs: DataFrame, suites: DataFrame) -> DataFrame:
    """(run, error): what of a run doesn't agree with the local suite of its id."""
    pairs = (("suite_hash", "suiteHash"), ("visibility", "visibility"), ("evaluation_mode", "evaluationMode"), ("locale", "locale"), ("benchmark_version", "benchmarkVersion"), ("case_count", "case count"))
    there = suites.select("suite_id", *(F.col(a).alias(f"_{a}") for a, _ in pairs))
    both = runs.join(there, "suite_id", "left")
    unknown = F.col("_suite_hash").isNull()
    wrong = [F.when(~unknown & ~F.col(a).eqNullSafe(F.col(f"_{a}")), F.concat(F.lit(f"{name} mismatch: expected "), F.coalesce(F.col(f"_{a}").cast("string"), F.lit("none")), F.lit(", got "), F.coalesce(F.col(a).cast("string"), F.lit("none")))) for a, name in pairs]
    found = F.array_compact(F.array(F.when(unknown, F.concat(F.lit("unknown suite "), F.col("suite_id"))), *wrong))
    return both.select("run", F.explode(found).alias("error"))


def runnable(suites: DataFrame) -> DataFrame:
    """suites that can run here, that is whose evaluation mode is local."""
    return suites.where(F.col("evaluation_mode") == "local")


def limited(cases: DataFrame, n: float, position: str = "pos") -> DataFrame:
    """The first max(1, floor(n)) cases in order of the file."""
    import math

    return cases.orderBy(position).limit(max(1, math.floor(n)))
