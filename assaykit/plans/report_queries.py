"""Queries on reports: extraction, the evaluators and their parts, the catalogue of structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clinical
from ..functions.lexicon import ENGLISH
from ..operators import catalogue, evaluators, extraction
from ..sources import adapters, reports
from ..sources.scratch import stored

from .registry import Registry

registry = Registry()
add = registry.add
FOLD = "lower(trim(regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')))"
PLAIN = "regexp_replace({0}, '<[^>]+>', '', 'g')"
LINES = "regexp_replace(regexp_replace({0}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
R = reports.SQL


def sql(last: str, *steps: str) -> str:
    return "WITH " + ",\n".join((R, *steps)) + "\n" + last


# ---- Extraction

#: One pattern with one group for each system, and the normal form of what it catches.
SYSTEMS = [
    ("birads", r"(?i)bi-?rads\s*[:\s]?\s*([0-9][a-c]?)", "upper(v)"), ("tirads", r"(?i)ti-?rads\s*[:\s]?\s*(?:TR[-\s]?)?([0-9])", "v"), ("lirads", r"(?i)\bLR[-\s]?((?:TNC|[1-5M])(?:\s*[a-c])?)\b", "upper(v)"),
    ("pirads", r"(?i)pi-?rads\s*[:\s]?\s*([0-9])", "v"), ("bosniak", r"(?i)bosniak\s*[:\s]?\s*((?:I{1,3}|IV|[1-4])F?)", "CASE upper(v) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '2F' THEN 'IIF' WHEN '3' THEN 'III' WHEN '4' THEN 'IV' ELSE upper(v) END"),
    ("fleischner", r"(?i)fleischner\s*(.*?)(?:\.|<|$)", "CASE WHEN trim(v) = '' THEN 'mentioned' ELSE lower(trim(v)) END"), ("lungrads", r"(?i)lung-?rads\s*[:\s]?\s*([0-9][abx]?|s)", "upper(v)"),
]


@add(sql(" UNION ALL ".join(f"SELECT DISTINCT case_id, '{s}' AS system, {normal} AS normal FROM (SELECT case_id, unnest(regexp_extract_all({PLAIN.format('html')}, '{p}', 1)) AS v FROM reports)" for s, p, normal in SYSTEMS)))
def report_classifications(spark, sf_dir):
    return extraction.extract(reports.reports(spark, sf_dir), "classifications").select("case_id", "system", "normal")


@add(sql("""SELECT case_id, trim(s) AS text, CASE WHEN regexp_matches(s, '(?i)biops[yie]') THEN 'biopsy'
 WHEN regexp_matches(s, '(?i)follow[\\s-]?up|surveillance|re-?evaluat|interval\\s+(?:imaging|study)|repeat\\s+(?:imaging|study)|recommend(?:ed)?\\s+(?:follow|re)') THEN 'follow-up'
 WHEN regexp_matches(s, '(?i)further\\s+(?:imaging|evaluation|work[\\s-]?up)|additional\\s+(?:imaging|evaluation)|(?:mri|ct|us)\\s+(?:for|to)\\s+(?:further|better)') THEN 'further-imaging'
 WHEN regexp_matches(s, '(?i)clinical\\s+correlation') THEN 'clinical-correlation' END AS type, nullif(regexp_extract(s, '(?i)(?:in|after|within)\\s+([0-9]+\\s+(?:days?|weeks?|months?|years?))', 1), '') AS timeframe
FROM s WHERE length(trim(s)) > 10 AND type IS NOT NULL""", f"s AS (SELECT case_id, unnest(regexp_split_to_array({PLAIN.format('html')}, '[.\\n]')) AS s FROM reports)"))
def report_recommendations(spark, sf_dir):
    return extraction.extract(reports.reports(spark, sf_dir), "recommendations").select("case_id", "text", "type", "timeframe")


CUE_BEFORE = r"\b(?:no|without|absent|negative for|ruled out|excluded|no\s+evidence|cannot\s+(?:be\s+)?(?:exclud\w*|ruled?\s+out)|not\s+(?:identified|seen|detected|demonstrated|observed|present|visualized))\b"
CUE_AFTER = r"\b(?:absent|not (?:identified|seen|detected|demonstrated|observed|present)|excluded|ruled out)\b"
TURN = r"[,;:]|\b(?:but|with|mas|com|porem|contudo|entretanto)\b"


def denied_sql(s: str, m: str) -> str:
    """Whether the clause of m in s denies it; both folded, m stands in s."""
    before = f"regexp_replace(substr({s}, 1, instr({s}, {m}) - 1), '(?s)^.*(?:{TURN})', '')"
    after = f"regexp_extract(substr({s}, instr({s}, {m}) + length({m})), '(?s)^(.*?)(?:{TURN}|$)', 1)"
    return f"(regexp_matches({before}, '{CUE_BEFORE}') OR regexp_matches({after}, '{CUE_AFTER}'))"


#: The categories that the made reports can hold, in order, on folded sentences.
URGENT = [("acute-bleed", "hemorrhag[ei]|hematoma"), ("pulmonary-embolism", r"pulmonary\s+emboli"), ("stroke", r"\bstroke\b"), ("pneumothorax", "pneumothorax"), ("midline-shift", r"midline\s+shift"), ("bowel-obstruction", r"bowel\s+obstruction"), ("fracture", r"\bfracture")]


@add(sql("SELECT DISTINCT case_id, category FROM (SELECT case_id, i, arg_min(category, k) AS category FROM m WHERE NOT " + denied_sql("s", "found") + " GROUP BY 1, 2)",
         f"s0 AS (SELECT case_id, unnest(regexp_split_to_array({LINES.format('html')}, '[.\\n]')) AS t, generate_subscripts(regexp_split_to_array({LINES.format('html')}, '[.\\n]'), 1) AS i FROM reports)",
         f"s AS (SELECT case_id, i, {FOLD.format('t')} AS s FROM s0 WHERE length(trim(t)) > 5)",
         "m AS (" + " UNION ALL ".join(f"SELECT case_id, i, s, {k} AS k, '{n}' AS category, regexp_extract(s, '{p}') AS found FROM s WHERE regexp_matches(s, '{p}')" for k, (n, p) in enumerate(URGENT)) + ")"))
def report_critical_mentions(spark, sf_dir):
    return extraction.extract(reports.reports(spark, sf_dir), "critical_mentions").select("case_id", "category")


@add(sql("""SELECT case_id, text, CASE WHEN regexp_matches(text, '(?i)hemorrhage|hematoma|embolism|pneumothorax|fracture|stroke|herniation|midline shift|bowel\\s+obstruction') THEN 'critical'
  WHEN regexp_matches(text, '(?i)nodule|mass|lesion|obstruction|pleural effusion') THEN 'major' WHEN regexp_matches(text, '(?i)cyst\\b|stone|steatosis|thickening|hernia|granuloma') THEN 'minor' ELSE 'incidental' END AS severity,
  CASE WHEN l AND r THEN 'bilateral' WHEN r THEN 'right' WHEN l THEN 'left' END AS laterality, CAST(len(list_distinct(regexp_extract_all(text, '(?i)\\b[0-9]+(?:[.,][0-9]+)?(?:\\s*x\\s*[0-9]+(?:[.,][0-9]+)?)*\\s*(?:mm|cm)\\b'))) AS INTEGER) AS n_measurements,
  regexp_matches(lower(text), '\\bno evidence of\\b|\\bwithout\\b|\\babsent\\b|\\bnegative for\\b|\\bruled out\\b|\\bexcluded\\b|\\bno (?:signs?|findings?) of\\b|\\bnot (?:identified|seen|detected|demonstrated|observed)\\b') AS negated
FROM (SELECT case_id, trim(t) AS text, regexp_matches(t, '(?i)\\bleft\\b') AS l, regexp_matches(t, '(?i)\\bright\\b') AS r FROM s) WHERE length(text) >= 8 AND NOT regexp_matches(text, '(?i)^(?:findings|impression|technique)\\s*$') AND NOT regexp_matches(text, '(?i)^(?:normal|unremarkable|within normal limits)')""",
         f"s AS (SELECT case_id, unnest(string_split(regexp_replace({LINES.format('html')}, '\\.\\s+([A-Z])', '.' || chr(10) || '\\1', 'g'), chr(10))) AS t FROM reports)"))
def report_findings(spark, sf_dir):
    rows = extraction.extract(reports.reports(spark, sf_dir), "findings")
    return rows.select("case_id", "text", "severity", "laterality", F.size("measurements").alias("n_measurements"), "negated")


@add(sql("SELECT DISTINCT case_id, m AS mention, " + denied_sql("f", "m") + " AS denied FROM (SELECT *, unnest(['effusion', 'hemorrhage', 'midline shift', 'pneumothorax', 'pulmonary embolism', 'hematoma', 'stroke']) AS m FROM s) WHERE contains(f, m)", f"s AS (SELECT case_id, {FOLD.format('findings')} AS f FROM reports)"))
def mention_denial(spark, sf_dir):
    """Whether the clause of a mention in the findings denies it."""
    mentions = F.array(*map(F.lit, ("effusion", "hemorrhage", "midline shift", "pneumothorax", "pulmonary embolism", "hematoma", "stroke")))
    rows = reports.reports(spark, sf_dir).select("case_id", "findings", F.explode(mentions).alias("mention")).where(F.contains(F.lower("findings"), F.col("mention")))
    return rows.select("case_id", "mention", clinical.mention_denied(F.col("findings"), F.col("mention"), ENGLISH).alias("denied")).distinct()


# ---- Parts of the evaluators


def _copy_words(x: str) -> str:
    stop = "texto sintetico teste harness exemplo demonstracao para com sem dos das uma este esta esse essa no na nos nas por pela pelo de do da ao aos as os que em entre maior menor eixo achados analise conclusao tecnica"
    return f"list_filter(regexp_split_to_array({FOLD.format(PLAIN.format(x))}, '[^a-z0-9_]+'), lambda t: length(t) > 3 AND NOT list_contains(string_split('{stop}', ' '), t))"


@add(sql("SELECT case_id, round(len(list_filter(said, lambda t: list_contains(given, t)))::DOUBLE / len(said), 9) AS ratio, CAST(len(list_filter(list_distinct(said), lambda t: NOT list_contains(given, t))) AS INTEGER) AS added FROM w", f"w AS (SELECT case_id, {_copy_words('findings')} AS given, {_copy_words('html')} AS said FROM reports)"))
def copy_ratio(spark, sf_dir):
    """How much of a report is copied from its findings."""
    rows = reports.reports(spark, sf_dir)
    ratio, added = evaluators.copy_ratio(F.col("findings"), F.col("html"))
    return rows.select("case_id", F.round(ratio, 9).alias("ratio"), F.size(added).alias("added"))


def _section_sql(x: str, own: str, every: str) -> str:
    """Words of a section, line by line: from the line after its head to the next head."""
    lines = f"list_transform(string_split({LINES.format(x)}, chr(10)), lambda l: {FOLD.format('l')})"
    body = f"list_transform({lines}, lambda l: CASE WHEN regexp_matches(l, '\\b(?:{own})\\b') THEN chr(1) WHEN regexp_matches(l, '\\b(?:{every})\\b') THEN chr(2) ELSE l END)"
    text = f"array_to_string({body}, ' ')"
    held = f"regexp_extract({text}, '\\x01([^\\x02]*)', 1)"
    return f"list_distinct(list_filter(string_split(replace({held}, chr(1), ' '), ' '), lambda t: length(t) > 2))"


PARTS = [("findings", "findings"), ("impression", "impression|conclusion"), ("technique", "technique")]


@add(sql(" UNION ALL ".join(f"SELECT case_id, '{n}' AS section, round(len(list_intersect(ref, cand))::DOUBLE / len(ref) * 100, 9) AS score FROM (SELECT case_id, {_section_sql('reference', own, 'findings|impression|conclusion|technique')} AS ref, {_section_sql('html', own, 'findings|impression|conclusion|technique')} AS cand FROM reports) WHERE len(ref) > 0" for n, own in PARTS)))
def section_tokens(spark, sf_dir):
    """Share of the words of each section of the reference report that the report's own section has."""
    rows = reports.reports(spark, sf_dir)
    made = clinical.section_scores(F.col("html"), F.col("reference"), ENGLISH)
    return rows.select("case_id", F.inline(made)).select("case_id", "section", F.round("score", 9).alias("score"))


@add("""SELECT case_id, round(r, 9) AS recall, round(p, 9) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 9) AS f1 FROM (
  SELECT case_id, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1 END AS r, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END AS p FROM (
    SELECT l_partkey AS case_id, count(*) FILTER (WHERE l_returnflag = 'A') AS tp, count(*) FILTER (WHERE l_returnflag = 'R') AS fn, count(*) FILTER (WHERE l_linenumber > 5) AS fp FROM lineitem GROUP BY 1))""")
def recall_precision_f1(spark, sf_dir):
    counts = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("tp"), F.count_if(F.col("l_returnflag") == "R").alias("fn"), F.count_if(F.col("l_linenumber") > 5).alias("fp"))
    made = evaluators.rates(F.col("tp"), F.col("fn"), F.col("fp"))
    return counts.select("case_id", *(F.round(x, 9).alias(n) for x, n in zip(made, ("recall", "precision", "f1"), strict=True)))


@add("""WITH g AS (SELECT l_partkey AS case_id, count(*) AS n, sum(w) AS total, sum(w * CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END) AS got, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS missed,
  count(*) FILTER (WHERE l_linenumber % 4 = 0 AND l_returnflag = 'R') AS critical_missed, count(*) FILTER (WHERE l_linenumber % 4 = 0 AND l_returnflag IN ('R', 'A')) AS severe_missed,
  count(*) FILTER (WHERE l_quantity < 3) AS high, count(*) FILTER (WHERE l_quantity > 48) AS low FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 4.0 WHEN 'A' THEN 2.5 ELSE 1.0 END AS w FROM lineitem) GROUP BY 1)
SELECT case_id, floor_score, round(CASE WHEN n = 0 THEN 100.0 ELSE greatest(floor_score, greatest(0.0, least(100.0, got / total * 100 - 5 * high - low))) END, 6) AS score FROM (SELECT *,
  CASE WHEN critical_missed > 0 THEN 0 WHEN missed > 0 AND severe_missed = 0 THEN 84 WHEN high > 0 THEN CASE WHEN (n - missed)::DOUBLE / n >= 0.8 THEN 72 ELSE 0 END WHEN missed = 0 THEN 88 WHEN (n - missed)::DOUBLE / n >= 0.9 THEN 84 WHEN (n - missed)::DOUBLE / n >= 0.8 THEN 80 ELSE 0 END AS floor_score FROM g)""")
def finding_score(spark, sf_dir):
    """The floor and the score of a case's matches, with a penalty for what is invented."""
    match = F.struct(F.lit("f").alias("finding"), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "major").otherwise("minor").alias("severity"),
                     F.when(F.col("l_linenumber") % 4 == 0, "missed").when(F.col("l_linenumber") % 4 == 1, "partial").otherwise("exact").alias("match"), F.when(F.col("l_linenumber") % 4 == 0, 0.0).when(F.col("l_linenumber") % 4 == 1, 0.5).otherwise(1.0).alias("score"))
    confidence = F.when(F.col("l_quantity") < 3, "high").when(F.col("l_quantity") > 48, "medium")
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id")).agg(F.collect_list(match).alias("m"), F.collect_list(F.when(confidence.isNotNull(), F.struct(confidence.alias("confidence")))).alias("h"))
    return rows.select("case_id", evaluators.utility_floor(F.col("m"), F.col("h")).alias("floor_score"), F.round(evaluators.finding_score(F.col("m"), F.col("h")), 6).alias("score"))


@add("""SELECT case_id, CAST(floor(passed::DOUBLE / total * 100 + 0.5) AS INTEGER) AS score FROM (SELECT l_partkey AS case_id, sum(w) AS total, sum(CASE WHEN l_discount >= 0.005 THEN w ELSE 0 END) AS passed
FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 2 ELSE 1 END AS w FROM lineitem) GROUP BY 1)""")
def weighted_check_score(spark, sf_dir):
    severity = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "major").otherwise("minor")
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("case_id")).agg(F.collect_list(F.struct(severity.alias("severity"), (F.col("l_discount") >= 0.005).alias("passed"))).alias("c"))
    return rows.select("case_id", evaluators.weighted_share(F.col("c"), evaluators.CHECK_WEIGHTS).alias("score"))


# ---- Whole evaluators (their greedy steps are held against hand-made cases in the tests)


@add()
def greedy_match(spark, sf_dir):
    """Gold findings matched with a report's own, in order of gold."""
    # A case without gold has no match, so it isn't evaluated.
    rows = evaluators.quality(reports.cases(spark, sf_dir).where(F.size("gold") > 0))
    return stored(rows.select("case_id", "matches")).select("case_id", F.posexplode("matches").alias("n", "m")).select("case_id", "n", "m.finding", "m.severity", "m.match", F.round("m.score", 6).alias("score"))


@add()
def evaluate_reports(spark, sf_dir):
    """All four evaluators over the reports, with their structural checks as the fallback."""
    rows = evaluators.evaluate(stored(catalogue.with_checks(reports.cases(spark, sf_dir))), (ENGLISH,))
    return rows.select("case_id", "quality_mode", "quality_score", "critical_mode", "critical_score", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "guide_mode", "guide_score", "retrieval_mode", "retrieval_score")


@add()
def guideline_checks(spark, sf_dir):
    # Of the structural checks guidelines look at their own dimension only.
    rows = evaluators.guidelines(stored(catalogue.with_checks(reports.cases(spark, sf_dir), dims=("GUIDE",))))
    return stored(rows.select("case_id", "guide_checks")).select("case_id", F.inline("guide_checks")).groupBy("id", "severity").agg(F.count("*").alias("emitted"), F.count_if("passed").alias("passed"))


# ---- The catalogue

MODALITY = "CASE WHEN regexp_matches(lower(exam), '\\b(?:mri|magnetic resonance)\\b') THEN 'MRI' WHEN regexp_matches(lower(exam), '\\bultrasound\\b') THEN 'US' WHEN regexp_matches(lower(exam), 'digital mammography') THEN 'MX' ELSE 'CT' END"
REGION = "CASE WHEN regexp_matches(lower(exam), 'thyroid') THEN 'thyroid' WHEN regexp_matches(lower(exam), 'breast') THEN 'breast' WHEN regexp_matches(lower(exam), 'head') THEN 'head' WHEN regexp_matches(lower(exam), 'chest') THEN 'chest' WHEN regexp_matches(lower(exam), 'abd') THEN 'abdomen' WHEN regexp_matches(lower(exam), 'spine') THEN 'spine' ELSE 'unknown' END"
CONCLUSION = "regexp_extract(html, '(?is)<b>(?:Impression|Conclusion)[^<]*</b>(.*?)(?:<br><br><b>|$)', 1)"
ANALYSIS = "regexp_extract(html, '(?is)<b>(?:Findings|Analysis)[^<]*</b>(.*?)(?:<br><br><b>|$)', 1)"
#: id, when it applies, whether it passes: written for these reports, apart from the engine's own patterns.
CORE = [
    ("C01", "NOT regexp_matches(lower(exam), 'with contrast')", "NOT regexp_matches(html, '(?i)\\benhancement\\b|\\bwash[\\s-]?out\\b|\\b(?:arterial|portal|delayed)\\s+phase\\b')"),
    ("C02", "true", "NOT regexp_matches(z, '(?i)otherwise\\s+(?:un)?remarkable')"), ("C05", "true", "NOT regexp_matches(z, '(?i)\\b[0-9]+(?:[.,][0-9]+)?\\s*(?:cm|mm)\\b')"),
    ("Q01", "true", "starts_with(html, '<center><b>')"), ("Q02", "true", "NOT contains(html, '<b>CT HEAD')"), ("Q05", "true", "contains(html, '<br><br><b>')"), ("Q07", "true", "NOT contains(html, '[TODO')"),
    ("Q08", "true", "regexp_matches(html, '(?i)findings|analysis')"), ("Q11", "true", "length(trim(regexp_replace(z, '<[^>]+>', '', 'g'))) > 10"), ("T01", "true", "NOT regexp_matches(html, '(?i)\\bfluid\\b')"), ("TO0", "true", "NOT regexp_matches(html, '(?i)(?:<br>|</b>|\\.)\\s*There is')"),
    ("TM1", "modality = 'US'", "NOT regexp_matches(html, '(?i)\\battenuation\\b|\\bdensity\\b|\\bsignal\\s+intensity\\b|\\benhancement\\b')"),
    ("R04", "regexp_matches(findings, '(?i)\\b[0-9]+\\s*(?:mm|cm)\\b')", "CASE WHEN contains(findings, '6 mm') THEN contains(html, '6 mm') WHEN contains(findings, '1,2 cm') THEN contains(html, '1,2 cm') ELSE contains(html, '2 cm') AND NOT contains(replace(html, '1,2 cm', ''), '12 cm') AND (contains(html, 'x 2 cm')) END"),
    ("R06", "true", "true"),
]


@add(sql("SELECT id, count(*) AS emitted, count(*) FILTER (WHERE ok) AS passed FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS id, {ok} AS ok FROM r WHERE {when}" for i, when, ok in CORE) + ") GROUP BY 1", f"r AS (SELECT *, {CONCLUSION} AS z, {ANALYSIS} AS a, {MODALITY} AS modality, {REGION} AS region FROM reports)"))
def catalogue_core(spark, sf_dir):
    """The catalogue over whole reports, counted for the checks whose SQL is stated here."""
    rows = catalogue.structural_checks(reports.reports(spark, sf_dir)).where(F.col("id").isin(*(i for i, _, _ in CORE)))
    return rows.groupBy("id").agg(F.count("*").alias("emitted"), F.count_if("passed").alias("passed"))


@add()
def check_catalogue_counts(spark, sf_dir):
    """All structural checks over whole reports, by id."""
    return catalogue.structural_checks(reports.reports(spark, sf_dir)).groupBy("dim", "id", "severity").agg(F.count("*").alias("emitted"), F.count_if("passed").alias("passed"))
