"""Hashes that bind cases, scoring code, runs and any number of files.

A suite's, a run's and the scoring code's hash have fixed forms over short lists (see release). Whole folders and corpora
have a Merkle tree: a leaf's place is the hash of its name, a node stands for all leaves whose places begin with its
prefix, and its hash covers its children's in order of prefix. Each level is one aggregation over groups of about FAN
children, so no list grows with the files; a file that changes, comes or goes changes the nodes above it only, which is
how two trees are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .release import RUN_FIELDS, chain_hash, run_hash

FAN = 256
#: Hexadecimal digits of a place that one level takes.
DIGITS = 2


def leaves(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, place, hash) of each file: the hash covers name and content, so a moved file is another leaf. Null content is told from empty."""
    text = F.coalesce(F.concat(F.lit("="), F.sha2(content, 256)), F.lit("-"))
    return files.select(F.col(name).cast("string").alias("name"), F.sha2(F.col(name).cast("string"), 256).alias("place"), F.sha2(F.concat_ws("\n", F.col(name).cast("string"), text), 256).alias("hash"))


def depth_for(n: int) -> int:
    """Levels below the root, so that the lowest nodes have about FAN leaves or fewer."""
    return max(0, math.ceil(math.log(max(n, 1) / FAN, FAN) - 1e-9) if n > FAN else 0)


def tree(own: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, prefix, hash, n): every node, the root at level 0 with an empty prefix. No leaves: a root over nothing."""
    depth = depth_for(own.count()) if depth is None else depth
    children = own.select(F.col("place").alias("at"), "hash", F.lit(1).cast("long").alias("n"))
    out = None
    for level in range(depth, -1, -1):
        grouped = children.groupBy(F.substring("at", 1, DIGITS * level).alias("prefix")) if level else children.groupBy(F.lit("").alias("prefix"))
        listed = F.array_sort(F.collect_list(F.struct("at", "hash")))
        nodes = stored(grouped.agg(F.sha2(F.array_join(F.transform(listed, lambda c: c["hash"]), ""), 256).alias("hash"), F.sum("n").alias("n")))
        if not level and not nodes.limit(1).count():
            nodes = own.sparkSession.range(1).select(F.lit("").alias("prefix"), F.sha2(F.lit(""), 256).alias("hash"), F.lit(0).cast("long").alias("n"))
        rows = nodes.select(F.lit(level).alias("level"), "prefix", "hash", "n")
        out = rows if out is None else out.union(rows)
        children = nodes.select(F.col("prefix").alias("at"), "hash", "n")
    return out


def root(own: DataFrame) -> DataFrame:
    """(hash, n): one row."""
    return tree(own).where("level = 0").select("hash", "n")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): leaves added, removed or changed between two sets. Only leaves below differing nodes of the lowest level are compared."""
    depth = max(depth_for(before.count()), depth_for(after.count()))
    side = lambda own: tree(own, depth).where(F.col("level") == depth).select("prefix", F.col("hash").alias("h"))
    differ = side(before).alias("a").join(side(after).alias("b"), F.col("a.prefix") == F.col("b.prefix"), "full").where(~F.col("a.h").eqNullSafe(F.col("b.h")))
    differ = stored(differ.select(F.coalesce("a.prefix", "b.prefix").alias("prefix")))
    prefix = F.substring("place", 1, DIGITS * depth) if depth else F.lit("")
    own = lambda df, c: df.withColumn("prefix", prefix).join(differ, "prefix", "left_semi").select("name", F.col("hash").alias(c))
    both = own(before, "a").join(own(after, "b"), "name", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


# ---- Hashes of fixed form


# What a case's hash covers, by name in the hashed text.
CASE_FIELDS = ("id", "exam", "findings", "locale", "goldFindings", "referenceReport", "criticalFindings", "guidelineExpectations", "retrievalGold", "patientContext", "difficulty")


def case_hash(case: Column) -> Column:
    """sha256 of a case (a variant, as artifacts.read_case_objects gives it): keys are sorted at every level, as variants keep them; what is missing is null."""
    texts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.variant_get(case, f"$.{k}", "variant")), F.lit("null"))) for k in sorted(CASE_FIELDS)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}")), 256)


def suite_hashes(cases: DataFrame, keys=("suiteId", "locale")) -> DataFrame:
    """(keys, caseCount, suiteHash): sha256 over the sorted hashes of a suite's cases. cases: keys and case (a variant)."""
    return chain_hash(cases.select(*keys, case_hash(F.col("case")).alias("hash")), "hash", keys).select(*keys, F.col("n").alias("caseCount"), F.col("hash").alias("suiteHash"))


def scoring_hash(files: DataFrame, paths: list[str]) -> DataFrame:
    """(scoringHash, scoringFiles): sha256 over the listed files' paths and hashes in order of path. A listed file that isn't there is an error.

    files: path (relative) and content. The list is the harness's own code, a few dozen files.
    """
    own = files.where(F.col("path").isin(paths)).select("path", F.sha2("content", 256).alias("sha256"))
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    rows = own.agg(listed.alias("scoringFiles"))
    missing = F.array_except(F.array(*map(F.lit, sorted(paths))), F.transform("scoringFiles", lambda f: f["path"]))
    checked = F.when(F.size(missing) == 0, F.col("scoringFiles")).otherwise(F.raise_error(F.concat(F.lit("missing scoring files: "), F.array_join(missing, ", "))))
    return rows.select(F.sha2(F.to_json(checked), 256).alias("scoringHash"), checked.alias("scoringFiles"))


def run_hashes(runs: DataFrame, scoring: str, suites: DataFrame | None = None) -> DataFrame:
    """(runName, suiteId, suiteHash, runHash): each run bound to its suite, configuration and scoring code.

    runs: manifest as in artifacts.RUN. suites: suiteId and suiteHash; a suite that isn't listed keeps the hash that the run names.
    """
    own = runs.select(F.col("manifest.runName").alias("runName"), F.col("manifest.suiteHash").alias("_own"), *(F.col(f"manifest.{c}").alias(n) for c, n in RUN_FIELDS.items()))
    if suites is not None:
        own = own.join(suites.groupBy(F.col("suiteId").alias("suite_id")).agg(F.min("suiteHash").alias("_listed")), "suite_id", "left")
    else:
        own = own.withColumn("_listed", F.lit(None).cast("string"))
    own = own.withColumn("suiteHash", F.coalesce("_listed", "_own", F.lit("")))
    return own.select("runName", F.col("suite_id").alias("suiteId"), "suiteHash", run_hash(F.col("suiteHash"), F.lit(scoring)).alias("runHash"))


def manifest(cases: DataFrame, files: DataFrame, paths: list[str], version: str) -> DataFrame:
    """One row: benchmarkVersion, scoringHash, scoringFiles, suites (suiteId, locale, caseCount, suiteHash), a record to publish beside a board."""
    suites = suite_hashes(cases).agg(F.array_sort(F.collect_list(F.struct("suiteId", "locale", "caseCount", "suiteHash"))).alias("suites"))  # a row for each suite
    return scoring_hash(files, paths).crossJoin(suites).select(F.lit(version).alias("benchmarkVersion"), "scoringHash", "scoringFiles", "suites")  # one row each
