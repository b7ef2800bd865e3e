"""Files of the harness as tables: suites, cases, predictions, runs, release files; and the sinks."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

CASE = "id string, label string, synthetic boolean, exam string, findings string, locale string, tags array<string>, goldFindings array<struct<finding:string,location:string,laterality:string,severity:string,measurements:array<string>,negated:boolean>>, referenceReport string, criticalFindings array<string>, guidelineExpectations array<struct<guidelineId:string,expectedClassification:string,recommendationRequired:boolean,expectedRecommendation:string>>, retrievalGold array<struct<documentId:string,relevance:int>>, patientContext struct<sex:string,age:int,indication:string>, difficulty string"
CHECK = "struct<dim:string,id:string,name:string,severity:string,passed:boolean,evidence:string>"
DIMS = ("CRIT", "QUAL", "TERM", "GUIDE", "RAG")
_by_dim = lambda kind: "struct<" + ",".join(f"{d}:{kind}" for d in DIMS) + ">"
MANIFEST = ("struct<benchmarkVersion:string,createdAt:string,runName:string,suiteId:string,suiteLabel:string,suiteVisibility:string,suiteHash:string,locale:string,track:string,provider:string,modelLabel:string,entityName:string,"
            "entityType:string,systemType:string,comparisonClass:string,scaffoldId:string,judgeProvider:string,judgeModel:string,judgeTemperature:double,judgeMaxTokens:int,scoreMode:string,policyId:string,evaluationMode:string,"
            "submissionMode:string,comparableKey:string,canaryToken:string,notes:string,validation:struct<valid:boolean,expectedIds:array<string>>>")  # fmt: skip
SUMMARY = f"struct<accuracyRate:double,allPassRate:double,allPassCount:double,criterionPassRate:double,criteriaPassed:double,criteriaTotal:double,averageOverall:double,passRate:double,strictPassRate:double,averageLatencyMs:double,totalCostUsd:double,verdictCounts:struct<PASS:long,PARTIAL:long,FAIL:long>,averagePerDim:{_by_dim('double')}>"
DIM = "struct<score:double,pass:int,total:int,critFails:int,verdict:string,appliedWeight:double>"
JUDGED = f"struct<verdict:string,scores:{_by_dim('double')},overall:double,critical_failures:array<map<string,string>>,missing:array<string>,hallucinated:array<string>>"
RESULT = (f"struct<case:struct<id:string,label:string,difficulty:string>,rawHtml:string,checks:array<{CHECK}>,detDims:{_by_dim(DIM)},detOverall:double,judge:{JUDGED},combined:{_by_dim('double')},combinedOverall:double,allPass:boolean,"
          "criteriaPassed:long,criteriaTotal:long,verdict:string,costUsd:double,latencyMs:double>")  # fmt: skip
RUN = f"manifest {MANIFEST}, summary {SUMMARY}, results array<{RESULT}>"
PREDICTION_KEYS = ("instance_id", "model_output", "metadata", "model_name_or_path")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file, or an array of them; a malformed file stops the read."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """A suite's settings; it needs a name."""
    rows = read_json(spark, path, "benchmarkName string, benchmarkVersion string, id string, label string, locale string, visibility string, evaluationMode string, casesPath string, caseCount int")
    return rows.withColumn("id", F.when(F.col("benchmarkName").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("suite without a benchmarkName"))))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CASE)


def read_suite_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases that a suite's file names, relative to that file, with suite_id. A suite that ships none, or a file that is no list, is an error."""
    suite = read_suite(spark, path).first()
    if suite is None or not suite.casesPath:
        raise ValueError(f"suite {suite.id if suite else path} does not ship cases")
    base, _, _ = path.rpartition("/")
    at = suite.casesPath if "://" in suite.casesPath or suite.casesPath.startswith("/") else f"{base}/{suite.casesPath}"
    if not read_text(spark, at).select(F.ltrim("value").startswith("[")).first()[0]:
        raise ValueError(f"cases must be a JSON array: {at}")
    return read_cases(spark, at).withColumn("suite_id", F.lit(suite.id))


def read_case_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, case): each case of a file's array (or the file's only one) as a variant, with whatever keys it has."""
    rows = read_text(spark, path).select("path", F.parse_json("value").alias("v"))
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return rows.select("path", F.explode(listed).alias("case"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, model_output, metadata (JSON text), unknown keys, and the raw line. Malformed lines stop the read: their number, and the first 20 of them, are in one error."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("parsed", F.try_parse_json(F.trim("value")))
    bad = lines.where("parsed is null").select("value")
    first = [r.value[:80] for r in bad.limit(20).collect()]
    if first:
        raise ValueError(f"{bad.count()} malformed lines in {path}: {first}")
    fields = F.from_json("value", "map<string,string>")
    return lines.select(
        F.get_json_object("value", "$.instance_id").alias("instance_id"), F.get_json_object("value", "$.model_output").alias("model_output"), F.get_json_object("value", "$.metadata").alias("metadata"),
        F.array_except(F.map_keys(fields), F.array(*map(F.lit, PREDICTION_KEYS))).alias("unknown_keys"), "value",
    )


def retrieved_ids(metadata: str, names=("retrievedDocIds", "retrieved_doc_ids", "documentIds", "docIds", "evidenceIds")):
    """The first list of ids that isn't empty among the usual places of the metadata."""
    lists = [F.from_json(F.get_json_object(metadata, f"$.{p}{n}"), "array<string>") for p in ("", "retrieval.", "rag.") for n in names]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run artifacts of a folder; files without a manifest or summary are skipped."""
    return spark.read.json(path, schema=RUN, multiLine=True).where("manifest is not null and summary is not null")


def read_suite_runs(spark: SparkSession, path: str, require_results: bool = True, observation=None) -> DataFrame:
    """Run artifacts whose every number follows from their checks: a run that doesn't stops the read with all its mismatches named.

    The artifacts are scanned once: verification is part of the plan that the reader's own steps go on with. `observation` (an
    Observation) gets the numbers of runs, cases and mismatches of that same pass.
    """
    from ..operators import integrity

    rows = spark.read.json(path, schema=RUN, multiLine=True, mode="FAILFAST").withColumn("source", F.col("_metadata.file_path"))
    return integrity.verified(rows, require_results, observation)


def run_checks(runs: DataFrame) -> DataFrame:
    """The fact table of runs: one row for each check."""
    cases = runs.select(F.col("manifest.runName").alias("run"), F.explode("results").alias("r"))
    return cases.select("run", F.col("r.case.id").alias("case_id"), F.inline("r.checks"))


def read_release_files(spark: SparkSession, path: str, most: int = 2_000_000) -> DataFrame:
    """(path, content) of files up to `most` bytes that are text; sizes are pruned before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    return files.where(~F.contains("content", F.lit(b"\x00"))).select("path", F.try_validate_utf8(F.decode("content", "utf-8")).alias("content"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_lines(df: DataFrame, path: str) -> None:
    """A column of lines as text; small documents go to one file."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def predictions_of(runs: DataFrame, text: str = "rawHtml") -> DataFrame:
    return runs.select(F.explode("results").alias("r")).select(F.col("r.case.id").alias("instance_id"), F.col(f"r.{text}").alias("model_output"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the stored JSON lines don't have yet, each key once; returns how many.

    The new rows are stored first and then written by one commit, so a job that fails or is tried again leaves no half of
    them; of rows that share a key the smallest by their JSON text stays.
    """
    spark = df.sparkSession
    try:
        have = spark.read.schema(df.schema).json(path).select(key)
        df = df.join(have, key, "left_anti")
    except Exception as e:  # noqa: BLE001  no output yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    names = df.columns
    rows = F.struct(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("j"), *names)
    new = stored(df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*names), rows["j"]).alias("r")).select("r.*"))
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a pipe table; bars and line ends in cells are replaced."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("/")), r"\s+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value"))


def generate(cases: DataFrame, make: Callable[[str], str], key: str = "id", prompt: str = "prompt") -> DataFrame:
    """Outputs of a generator for each case, in the executors; a case that fails becomes a row with the error."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k, p in zip(b[key], b[prompt], strict=True):
                try:
                    rows.append((k, make(p), None))
                except Exception as e:  # noqa: BLE001  failures are rows
                    rows.append((k, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["instance_id", "model_output", "error"])

    return cases.select(F.col(key).cast("string").alias(key), prompt).mapInPandas(run, "instance_id string, model_output string, error string")


def command(line: list[str], timeout: float = 180, keep_env: tuple[str, ...] = ("PATH", "HOME", "LANG")) -> Callable[[str], str]:
    """A generator that runs a program for each prompt, without the rest of the environment."""

    def make(prompt: str) -> str:
        env = {k: os.environ[k] for k in keep_env if k in os.environ}
        return subprocess.run(line, input=prompt, capture_output=True, text=True, timeout=timeout, env=env, check=True).stdout

    return make


def http_chat(url: str, model: str, token: str | None = None, waits=(1, 3, 8), timeout: float = 120) -> Callable[[str], str]:
    """A generator that asks a chat-completion service; waits and asks again on 429 and server errors."""

    def make(prompt: str) -> str:
        import json
        import time
        import urllib.error
        import urllib.request

        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}]}).encode()
        head = {"content-type": "application/json"} | ({"authorization": f"Bearer {token}"} if token else {})
        for wait in (*waits, None):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as r:
                    said = json.load(r)["choices"][0]["message"]["content"]
                    return said if isinstance(said, str) else "".join(p.get("text", "") for p in said)
            except urllib.error.HTTPError as e:
                if wait is None or e.code != 429 and e.code < 500:
                    raise
                time.sleep(float(e.headers.get("retry-after") or wait))
            except urllib.error.URLError:
                if wait is None:
                    raise
                time.sleep(wait)
        raise RuntimeError("unreachable")

    return make


JUDGE = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())), T.StructField("overall", T.DoubleType()), T.StructField("critical_failures", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("hallucinated", T.ArrayType(T.StringType()))])


def first_object(text: str | None) -> str | None:
    """The first balanced object of a reply, without fences and trailing commas; null without one."""
    import re

    if not text:
        return None
    text = re.sub(r"```(?:json)?", "", text)
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0 and start >= 0:
                return re.sub(r",\s*([}\]])", r"\1", text[start : i + 1])
    return None


def parse_judge(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replies with `judge`; scores out of 0 to 100 are dropped, lists default to empty."""
    found = F.udf(first_object, T.StringType(), useArrow=True)
    parsed = F.from_json(found(column), JUDGE)
    good = F.map_filter(parsed["scores"], lambda k, v: v.between(0, 100))
    empty = lambda c: F.coalesce(parsed[c], F.array().cast(JUDGE[c].dataType))
    return replies.withColumn("judge", F.struct(parsed["verdict"].alias("verdict"), good.alias("scores"), F.when(parsed["overall"].between(0, 100), parsed["overall"]).alias("overall"), empty("critical_failures").alias("critical_failures"), empty("missing").alias("missing"), empty("hallucinated").alias("hallucinated")))
