"""Views of the test tables in the shapes of the engine: checks, results, predictions, ratings, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.scoring import DIMS
from .scratch import ship, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks from line items: the case is the part, the run the supplier modulo 4."""
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), key)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("run"), F.col("l_partkey").alias("case_id"), pick(((F.col("l_linenumber") - 1) % 5 + 1).cast("int"), *DIMS).alias("dim"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "major").otherwise("minor").alias("severity"),
        (F.col("l_discount") >= 0.005).alias("passed"), F.col("l_quantity").alias("ms"), F.round(F.col("l_tax") * 100).cast("long").alias("cents"),
        pick(((F.col("l_linenumber") - 1) % 7 + 1).cast("int"), "C01", "QG01", "T00", "G01", "R02", "Q10", "X99").alias("id"),
        pick((F.col("l_quantity").cast("long") % 6 + 1).cast("int"), "ok", "exact=0 partial=0 missed=2 total=2", "exact=1 partial=0 missed=1 total=2", "BI-RADS not mentioned", "lesion of 5 mm", "forbidden opener").alias("evidence"),
        F.lit("check").alias("name"), pick((F.col("l_partkey") % 3 + 1).cast("int"), "bi rads 2, left knee", "lesion 0,5 cm", "none").alias("report"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty and modality of each part; every 29th has no difficulty."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("case_id"), F.col("p_name").alias("label"),
        F.when(F.col("p_partkey") % 29 == 0, None).when(size <= 17, "easy").when(size <= 34, "medium").otherwise("hard").alias("difficulty"),
        F.element_at(F.array(*map(F.lit, ("CT", "MRI", "US", "XR"))), (size % 4 + 1).cast("int")).alias("modality"),
    )


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.case_counts(checks(spark, sf_dir), scoring.KEYS, F.sum("ms").alias("latency_ms"), (F.sum("cents").cast("double") / 100.0).alias("cost_usd"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_dimensions(counted(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run and case, combined without a judge."""
    return scoring.combine(scored(spark, sf_dir)).join(cases(spark, sf_dir), "case_id", "left")


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as a run artifact: scored once, stored, and read as often as needed."""
    return stored(results(spark, sf_dir).drop("gate_reasons"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a judge made from the counts: a third of the cases without one, a seventh on the 0-5 scale."""
    rows = scored(spark, sf_dir)
    base = F.col("latency_ms").cast("long")
    likert = F.col("case_id") % 7 == 0
    has = F.col("case_id") % 3 != 0
    value = lambda k: F.when(likert, ((base + k) % 6).cast("double")).otherwise(((base * 3 + k * 11) % 101).cast("double"))
    new = {f"judge_{d}": F.when(has & ((F.col("case_id") + k) % 5 != 0), value(k)) for k, d in enumerate(DIMS)}
    return rows.withColumns(new | {
        "has_judge": has, "judge_overall": F.when(has, value(9)), "judge_critical": F.when(has, (F.col("case_id") % 11 == 0).cast("int")),
        "judge_missing": F.when(has, (F.col("case_id") % 4 == 1).cast("int")), "judge_hallucinated": F.lit(0),
    })


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as predictions: the id is the conversation, the position the turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("instance_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(F.col("text")).alias("model_output")
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that predictions should answer: all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"))
