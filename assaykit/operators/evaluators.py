"""Evaluators of a report against its case: quality, urgent findings, guidelines, retrieval.

Each adds its results as columns to the rows of cases, so a case is evaluated where it stands: no join, no shuffle, and
nothing larger than one case in memory. Columns of cases (missing ones count as empty): case_id, html, exam, findings,
modality, locale, reference (a report), gold (array of finding, severity, location, laterality, measurements, negated),
urgent (array of strings), expectations (array of guideline, classification, recommendation, required), relevance (map of
document to grade), retrieved (array of documents), structural (array of checks, see catalogue).

The greedy steps (each gold finding takes the best extracted finding that is left) are folds over the case's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical, lexicon
from ..functions.lexicon import ENGLISH, LOCALES, Lexicon
from ..functions.clinical import coverage, let, similarity
from ..functions.text import fold, measurement_present, strip_tags
from . import extraction

CHECK = "array<struct<dim:string,id:string,name:string,severity:string,passed:boolean,evidence:string>>"
# Weights of gold findings, and of checks where a score falls back on them.
GOLD_WEIGHTS = {"critical": 4.0, "major": 2.5, "minor": 1.0, "incidental": 0.5}
CHECK_WEIGHTS = {"critical": 4.0, "major": 2.0, "minor": 1.0}
RETRIEVAL_WEIGHTS = {"critical": 5.0, "major": 2.0, "minor": 0.5}

QUALITY = ("matches", "invented", "synthesis", "quality_mode", "quality_score", "quality_checks")
CRITICAL = ("critical_mode", "true_positives", "false_negatives", "false_positives", "recall", "precision", "f1", "critical_score", "critical_checks")
DEFAULTS = {
    "exam": "cast('' as string)", "findings": "cast('' as string)", "modality": "cast('OTHER' as string)", "locale": "'en-US'", "reference": "cast(null as string)",
    "gold": "cast(array() as array<struct<finding:string,severity:string,location:string,laterality:string,measurements:array<string>,negated:boolean>>)",
    "urgent": "cast(array() as array<string>)", "expectations": "cast(array() as array<struct<guideline:string,classification:string,recommendation:string,required:boolean>>)",
    "relevance": "cast(null as map<string,int>)", "retrieved": "cast(array() as array<string>)", "structural": f"cast(array() as {CHECK})",
}


def with_defaults(cases: DataFrame) -> DataFrame:
    """cases with all columns that the evaluators look at."""
    new = {}
    for name, empty in DEFAULTS.items():
        new[name] = F.coalesce(F.col(name), F.expr(empty)) if name in cases.columns else F.expr(empty)
    return cases.withColumns(new)


def check(dim: str, name: Column | str, title: Column | str, severity: Column | str, passed: Column, evidence: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(dim).alias("dim"), as_column(name).alias("id"), as_column(title).alias("name"), as_column(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"), as_column(evidence).alias("evidence"))


def listed(*checks: Column) -> Column:
    """The checks that apply, as an array."""
    return F.array_compact(F.array(*checks)).cast(CHECK)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def weighted_share(checks: Column, weights: dict[str, float]) -> Column:
    """Weight of the passed checks in percent of all, rounded; 100 without checks."""
    w = lambda c: F.coalesce(*(F.when(c["severity"] == s, v) for s, v in weights.items()), F.lit(weights["minor"]))
    total = F.aggregate(checks, F.lit(0.0), lambda a, c: a + w(c))
    passed = F.aggregate(checks, F.lit(0.0), lambda a, c: a + F.when(c["passed"], w(c)).otherwise(0.0))
    return F.when(F.size(checks) == 0, 100).otherwise(half_up(passed / total * 100))


def served(keys) -> Column:
    """The row's locale, en-US where it is null. One that isn't among the keys is an error: no row is lost."""
    key = F.coalesce(F.col("locale"), F.lit("en-US"))
    return F.when(key.isin(*keys), key).otherwise(F.raise_error(F.concat(F.lit("no words for the locale "), key)))


def by_locale(cases: DataFrame, step, locales=LOCALES) -> DataFrame:
    """step(rows, lexicon) over the rows of each locale."""
    keys = [lex.key for lex in locales]
    parts = [step(cases.where(served(keys) == lex.key), lex) for lex in locales]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class _Steps:
    """Stands in for a DataFrame and notes the columns that are added to it, step by step."""

    def __init__(self):
        self.steps: list[dict[str, Column]] = []

    def withColumns(self, new: dict[str, Column]) -> _Steps:  # noqa: N802
        self.steps.append(dict(new))
        return self

    def withColumn(self, name: str, x: Column) -> _Steps:  # noqa: N802
        return self.withColumns({name: x})


_built: dict[tuple, list[dict[str, Column]]] = {}


def _added(rows: DataFrame, build, *settings) -> DataFrame:
    """rows with the columns of build(rows, *settings), whose expressions are made once for each JVM and settings: making them takes
    seconds, adding them to a plan doesn't."""
    key = (id(rows.sparkSession._jvm), build, *settings)
    if key not in _built:
        steps = _Steps()
        build(steps, *settings)
        _built[key] = steps.steps
    for step in _built[key]:
        rows = rows.withColumns(step)
    return rows


# ---- Quality


def _gold_structs(lex: Lexicon) -> Column:
    """Gold findings that a report must have, with what matching needs."""
    scored = F.filter("gold", lambda g: ~clinical.raises_or_manages(g["finding"]))
    return F.transform(scored, lambda g: F.struct(
        g["finding"].alias("finding"), g["severity"].alias("severity"), g["location"].alias("location"), g["laterality"].alias("laterality"), g["measurements"].alias("measurements"),
        F.coalesce(g["negated"], F.lit(False)).alias("negated"), fold(g["finding"]).alias("folded"), clinical.tokens(g["finding"]).alias("tokens"),
        clinical.tokens(clinical.primary_clause(g["finding"])).alias("primary"),
        (F.coalesce(g["negated"], F.lit(False)) | clinical.has_cue(clinical.primary_clause(g["finding"]), lex)).alias("denied"),
    ))


def _nearest(tokens: Column) -> Column:
    """The sentence that holds the largest share of the tokens as parts of its folded text, if that is half of them."""
    top = clinical.best(F.col("_sentences"), lambda s: F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: F.contains(s["folded"], t))), F.size(tokens)), F.lit(0.0)))
    return let(top, lambda x: F.when(x["worth"] >= 0.5, x["item"]["text"]))


def _agrees(g: Column, text: Column, lex: Lexicon, negated: Column | None = None) -> Column:
    """The text affirms what gold affirms, or denies what gold denies."""
    there = let(text, lambda t: clinical.has_cue(clinical.primary_clause(t), lex) | clinical.mention_denied(t, g["finding"], lex))
    return g["denied"] == (there if negated is None else negated | there)


def _rated(lex: Lexicon) -> Column:
    """For each gold finding all that the greedy step decides by."""

    def candidate(g: Column, f: Column) -> Column:
        bonus = F.when(fold(g["location"]) == fold(f["location"]), 0.1).otherwise(0.0) + F.when(g["laterality"] == f["laterality"], 0.1).otherwise(0.0)
        kept = F.size(F.filter(g["measurements"], lambda m: measurement_present(fold(f["text"]), fold(m)))) / F.size(g["measurements"])
        bonus = bonus + F.when(F.size(g["measurements"]) > 0, kept * 0.1).otherwise(0.0)
        made = lambda alike: F.struct(alike.alias("alike"), F.least(F.lit(1.0), alike + bonus).alias("total"), (g["denied"] == (f["negated"] | f["cue"] | clinical.mention_denied(f["text"], g["finding"], lex))).alias("agrees"))
        return let(similarity(g["tokens"], f["tokens"]), made)

    def basis(g: Column) -> Column:
        """What stands literally, what is covered, and the sentence that decides about polarity."""
        direct = F.contains("_folded", g["folded"])
        own = F.when(F.size(g["primary"]) > 0, g["primary"]).otherwise(g["tokens"])
        literal = F.get(F.filter("_sentences", lambda s: F.contains(s["folded"], g["folded"])), F.lit(0))["text"]
        return F.struct(direct.alias("direct"), coverage(g["tokens"], F.col("_tokens")).alias("covered"), F.coalesce(F.when(direct, literal), _nearest(own), F.col("_folded")).alias("said"), _nearest(g["tokens"]).alias("near"))

    def rated(g: Column, b: Column) -> Column:
        wide = (F.size(g["tokens"]) > 0) & (b["covered"] >= 0.92)
        return F.struct(
            g["finding"].alias("finding"), g["severity"].alias("severity"), (b["direct"] | wide).alias("literal"), _agrees(g, b["said"], lex).alias("agrees"),
            F.transform("_found", lambda f: candidate(g, f)).alias("candidates"),
            F.greatest(b["covered"], clinical.backed_coverage(g["tokens"], F.col("_tokens"), F.col("_clauses"))).alias("ratio"),
            F.when(b["near"].isNotNull(), _agrees(g, b["near"], lex)).otherwise(~g["negated"]).alias("loose"),
        )

    def one(g: Column) -> Column:
        return let(basis(g), lambda b: rated(g, b))

    return F.transform("_gold", one)


INVENTED = "array<struct<text:string,confidence:string>>"
MATCHES = "array<struct<finding:string,severity:string,match:string,score:double>>"


def _greedy() -> Column:
    """Matches in order of gold, and the extracted findings that are taken."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.expr(f"cast(array() as {MATCHES})").alias("out"))

    def top(acc: Column, x: Column, field: str, agreeing: bool) -> Column:
        def worth(c: Column) -> Column:
            return c["c"][field]

        numbered = F.transform(x["candidates"], lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        free = F.filter(numbered, lambda c: ~F.array_contains(acc["used"], c["i"]) & (c["c"]["agrees"] if agreeing else F.lit(True)))
        return clinical.best(free, worth)

    def decided(x: Column, same: Column, alike: Column) -> Column:
        reach = F.coalesce(alike["worth"], F.lit(0.0))
        loose = (x["ratio"] >= 0.55) & x["loose"]
        kind = F.when(x["literal"], F.when(x["agrees"], "exact").otherwise("missed")).when(reach >= 0.7, "exact").when((reach >= 0.4) | loose, "partial").otherwise("missed")
        partial = F.when(reach >= 0.4, reach).otherwise(F.greatest(F.lit(0.55), F.least(F.lit(0.78), x["ratio"] * 0.9)))
        taken = F.when(x["literal"], F.when(x["agrees"], same["item"]["i"])).when(reach >= 0.4, alike["item"]["i"])
        return F.struct(kind.alias("kind"), partial.alias("partial"), taken.alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        def put(d: Column) -> Column:
            score = F.when(d["kind"] == "exact", 1.0).when(d["kind"] == "missed", 0.0).otherwise(d["partial"])
            match = F.struct(x["finding"].alias("finding"), x["severity"].alias("severity"), d["kind"].alias("match"), score.alias("score"))
            return F.struct(F.array_compact(F.array_append(acc["used"], d["taken"])).cast("array<int>").alias("used"), F.array_append(acc["out"], match).cast(MATCHES).alias("out"))

        return let(top(acc, x, "alike", False), lambda same: let(top(acc, x, "total", True), lambda alike: let(decided(x, same, alike), put)))

    return F.aggregate("_rated", start, step)


def _invented(lex: Lexicon) -> Column:
    """Extracted findings that neither gold nor the source backs: (text, confidence)."""
    source = F.concat_ws(" ", "findings", "reference", F.array_join(F.transform("gold", lambda g: g["finding"]), " "), F.array_join("urgent", " "))
    known_malignant = fold(source).rlike(lexicon.MALIGNANT)
    reference = F.filter("gold", lambda g: ~F.coalesce(g["negated"], F.lit(False)) & ~fold(g["finding"]).rlike(lex.normality))
    reference = F.transform(reference, lambda g: clinical.tokens(fold(g["finding"])))

    # What a row has once is bound outside of the lambdas: the optimizer moves a column that is named once into them.
    def judged(f: Column, folded: Column, row: Column) -> Column:
        backed = (F.char_length(folded) >= 8) & (F.contains(row["source"], folded) | (coverage(f["tokens"], row["tokens"]) >= 0.58))
        clauses = F.filter(F.transform(F.split(folded, "[.,;]"), clinical.trim), lambda c: c != "")
        normal = let(clauses, lambda cs: (F.size(cs) > 0) & F.forall(cs, lambda c: c.rlike(lex.normality) | (F.size(clinical.tokens(c)) < 2)))
        grave = let(F.regexp_extract(folded, lexicon.MALIGNANT, 0), lambda term: (term != "") & ~row["known"] & ~clinical.mention_denied(f["text"], term, lex))
        nearest = F.coalesce(F.array_max(F.transform(row["reference"], lambda r: similarity(r, f["tokens"]))), F.lit(0.0))
        far = let(nearest, lambda near: F.when(near < 0.1, "high").when(near < 0.2, "medium"))
        confidence = F.when(backed | normal, F.lit(None)).when(grave, "high").otherwise(far)
        return F.struct(f["text"].alias("text"), confidence.alias("confidence"))

    def of(row: Column) -> Column:
        left = F.filter(F.transform("_found", lambda f, i: F.when(~F.array_contains(row["used"], i), f)), lambda f: f.isNotNull())
        return F.filter(F.transform(left, lambda f: let(fold(f["text"]), lambda t: judged(f, t, row))), lambda h: h["confidence"].isNotNull())

    row = F.struct(F.col("_greedy")["used"].alias("used"), F.col("_source").alias("source"), F.col("_source_tokens").alias("tokens"), F.col("_reference").alias("reference"), F.col("_known").alias("known"))
    return reference, known_malignant, let(row, of)


def utility_floor(matches: Column, invented: Column) -> Column:
    """The least score that a report has earned by what it did find."""

    def of(missed: Column) -> Column:
        share = (F.size(matches) - F.size(missed)) / F.size(matches)
        slight = F.forall(missed, lambda m: m["severity"].isin("minor", "incidental"))
        return (
            F.when(F.size(matches) == 0, 100).when(F.exists(missed, lambda m: m["severity"] == "critical"), 0).when((F.size(missed) > 0) & slight, 84)
            .when(F.exists(invented, lambda h: h["confidence"] == "high"), F.when(share >= 0.8, 72).otherwise(0)).when(F.size(missed) == 0, 88).when(share >= 0.9, 84).when(share >= 0.8, 80).otherwise(0)
        )

    return let(F.filter(matches, lambda m: m["match"] == "missed"), of)


def finding_score(matches: Column, invented: Column) -> Column:
    """Share of gold by weight, less a penalty for what is invented, not under the floor."""
    w = lambda m: F.coalesce(*(F.when(m["severity"] == s, v) for s, v in GOLD_WEIGHTS.items()), F.lit(0.0))
    total = F.aggregate(matches, F.lit(0.0), lambda a, m: a + w(m))
    got = F.aggregate(matches, F.lit(0.0), lambda a, m: a + w(m) * m["score"])
    penalty = F.aggregate(invented, F.lit(0), lambda a, h: a + F.when(h["confidence"] == "high", 5).otherwise(1))
    base = F.when(total > 0, got / total * 100).otherwise(100.0)
    return F.when(F.size(matches) == 0, 100.0).otherwise(F.greatest(utility_floor(matches, invented).cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - penalty))))


def synthesis_words(x: Column) -> Column:
    return F.filter(F.split(fold(strip_tags(x)), r"\W+"), lambda t: (F.char_length(t) > 3) & ~clinical.one_of(t, lexicon.SYNTHESIS_STOPWORDS))


def copy_ratio(findings: Column, html: Column) -> tuple[Column, Column]:
    """Share of the report's words that stand in the findings, and its distinct words that don't."""
    given, said = F.array_distinct(synthesis_words(findings)), synthesis_words(html)
    return F.try_divide(F.size(F.filter(said, lambda t: F.array_contains(given, t))), F.size(said)), F.array_except(F.array_distinct(said), given)


def _synthesis() -> Column:
    """(penalty, copied, added, clinical, reason): whether the report does more than copy."""
    copied, added = F.col("_copied"), F.size("_added")
    clinical_added = F.size(F.array_intersect("_added", "_known_words"))
    counted = F.when(F.size(F.array_except("_known_words", "_given")) >= 4, clinical_added).otherwise(added)
    covered = F.size(F.filter("_principal", lambda g: F.contains(F.col("_conclusion"), g["folded"]) | clinical.reflected(g["tokens"], F.col("_conclusion_tokens"), F.col("_clauses"))))
    no_basis = (F.size("_given") == 0) | (F.size("_words") == 0)
    cases = [
        (no_basis, 0, "no-token-basis"),
        ((F.size("_gold") > 0) & ~F.col("_whole"), 10, "missing-conclusion-section"),
        ((F.size("_principal") > 0) & (covered == 0), 12, F.concat(F.lit("principalCovered=0/"), F.size("_principal").cast("string"))),
        (F.col("_whole") & ~F.col("_echo"), 0, "substantive-conclusion"),
        ((copied >= 0.78) & (counted < 12), 14, "high-copy-low-addition"),
        ((copied >= 0.72) & (counted < 18), 10, "moderate-copy-low-addition"),
        ((copied >= 0.66) & (counted < 15), 6, "borderline-copy-low-addition"),
    ]
    result = F
    for when, penalty, reason in cases:
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        result = result.when(when, F.struct(F.lit(penalty).alias("penalty"), reason.alias("reason")))
    result = result.otherwise(F.struct(F.lit(0).alias("penalty"), F.lit("sufficient-token-distance").alias("reason")))
    zero = lambda x: F.when(no_basis, 0).otherwise(x)
    return let(result, lambda r: F.struct(r["penalty"].alias("penalty"), F.when(no_basis, 0.0).otherwise(copied).alias("copied"), zero(added).alias("added"), zero(clinical_added).alias("clinical"), r["reason"].alias("reason")))


def side_kept(g: Column, sentences: Column, report: Column) -> Column:
    """The report names the side of a gold finding in a sentence that speaks of the finding. sentences, report: folded."""
    # How sides are named.
    named = {
        "right": r"(?i)\b(?:direit[ao]?|right)\b", "left": r"(?i)\b(?:esquerd[ao]?|left)\b",
        "bilateral": r"(?i)\b(?:bilateral|bilaterais)\b|(?:\bdireit[ao]?\b[\s\S]{0,80}\besquerd[ao]?\b)|(?:\besquerd[ao]?\b[\s\S]{0,80}\bdireit[ao]?\b)",
    }
    on_side = lambda s: F.coalesce(*(F.when(g["laterality"] == k, s.rlike(p)) for k, p in named.items()), F.lit(False))
    words = lambda x: F.array_distinct(F.filter(F.split(fold(x), r"\s+"), lambda t: (F.char_length(t) > 3) & ~clinical.one_of(t, lexicon.SIDE_STOPWORDS)))
    every = words(F.concat_ws(" ", g["finding"], g["location"], F.array_join(F.coalesce(g["measurements"], F.expr("cast(array() as array<string>)")), " ")))
    anchors = words(F.concat_ws(" ", g["location"], g["finding"]))
    beside = lambda own: F.exists(sentences, lambda s: on_side(s) & F.exists(own, lambda t: F.contains(s, t)))
    mentioned = lambda own: (F.size(own) == 0) | (F.size(F.filter(own, lambda t: F.contains(report, t))) >= F.least(F.lit(2), F.size(own)))
    return let(every, lambda e: let(anchors, lambda a: beside(e) | (mentioned(e) & beside(a))))


def _quality(rows: DataFrame, lex: Lexicon) -> DataFrame:
    c = F.col
    # What only gold is compared with isn't made for cases without it.
    some = lambda x: F.when(F.size("gold") > 0, x)
    rows = rows.withColumns({
        "_folded": fold(strip_tags(c("html"))), "_clauses": some(clinical.source_clauses(c("findings"))), "_gold": _gold_structs(lex),
        "_sentences": some(F.transform(clinical.sentences(c("html"), r"[.\n;]", 4), lambda s: F.struct(s.alias("text"), fold(s).alias("folded")))),
        "_found": some(F.transform(extraction.findings(c("html"), lex), lambda f: F.struct(f["text"].alias("text"), f["location"].alias("location"), f["laterality"].alias("laterality"), f["negated"].alias("negated"), clinical.has_cue(clinical.primary_clause(f["text"]), lex).alias("cue"), clinical.tokens(f["text"]).alias("tokens")))),
        "_said": strip_tags(F.concat_ws("\n", "findings", F.coalesce("reference", F.lit("")))), "_conclusion": some(clinical.conclusion(c("html"), lex)),
    })
    rows = rows.withColumns({"_tokens": some(clinical.tokens(c("_folded"))), "_source": some(fold(c("_said"))), "_source_tokens": some(clinical.tokens(c("_said"))), "_conclusion_tokens": clinical.tokens(c("_conclusion"))})
    rows = rows.withColumns({"_rated": _rated(lex), "_principal": F.filter("_gold", lambda g: ~g["negated"] & g["severity"].isin("critical", "major"))})
    rows = rows.withColumn("_greedy", _greedy())
    reference, known, invented = _invented(lex)
    rows = rows.withColumns({"_reference": reference, "_known": known, "matches": c("_greedy")["out"]}).withColumn("invented", F.coalesce(some(invented), F.expr(f"cast(array() as {INVENTED})")))
    given, said = synthesis_words(c("findings")), synthesis_words(c("html"))
    source = F.concat_ws(" ", F.coalesce("reference", F.lit("")), F.array_join(F.transform("gold", lambda g: g["finding"]), " "), F.array_join("urgent", " "))
    rows = rows.withColumns({"_given": some(F.array_distinct(given)), "_words": some(said), "_known_words": some(F.array_distinct(synthesis_words(source))), "_whole": some(clinical.has_conclusion(c("html"), lex)), "_echo": some(clinical.conclusion_repeats_findings(c("html"), lex))})
    rows = rows.withColumns({"_added": F.array_except(F.array_distinct("_words"), "_given"), "_copied": F.try_divide(F.size(F.filter("_words", lambda t: F.array_contains("_given", t))), F.size("_words"))})
    rows = rows.withColumn("synthesis", some(_synthesis()))
    rows = _stored_sections(rows, lex)
    return rows.withColumns({
        "quality_mode": F.when(F.size("gold") > 0, "gold-findings").when(c("_has_reference"), "reference-comparison").otherwise("structural-fallback"),
        "quality_score": F.when(F.size("gold") > 0, half_up(F.greatest(F.lit(0.0), finding_score(c("matches"), c("invented")) - c("synthesis")["penalty"]))).when(c("_has_reference"), c("_like")).otherwise(weighted_share(c("_qual"), CHECK_WEIGHTS)),
        "quality_checks": F.when(F.size("gold") > 0, _gold_checks()).when(c("_has_reference"), listed(check("QUAL", "QR01", "Reference report similarity", "major", c("_like") >= 50, F.concat(F.lit("overall similarity: "), c("_like").cast("string"), F.lit("%"))))).otherwise(c("_qual")),
    })


def _stored_sections(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """What the checks of quality count, each a column of its own."""
    c = F.col
    plain = fold(clinical.lines(c("html")))
    rows = rows.withColumns({
        "_lined": plain, "_sections": F.when(F.size("gold") == 0, clinical.section_scores(c("html"), c("reference"), lex)), "_qual": F.filter("structural", lambda s: s["dim"] == "QUAL"),
        "_has_reference": c("reference").isNotNull() & (c("reference") != ""), "_sided": F.filter("_gold", lambda g: g["laterality"].isNotNull()),
        "_measured": F.flatten(F.transform(F.filter("_gold", lambda g: F.size(g["measurements"]) > 0), lambda g: g["measurements"])),
        "_urgent": F.filter("_principal", lambda g: g["severity"] == "critical"),
    })
    rows = rows.withColumns({
        "_pieces": F.filter(F.transform(F.split("_lined", r"[.\n;]"), clinical.trim), lambda s: s != ""),
        "_like": F.when(F.size("_sections") > 0, half_up(F.aggregate("_sections", F.lit(0.0), lambda a, s: a + s["score"]) / F.size("_sections"))).otherwise(0),
        "_needed": F.when(F.size("_urgent") > 0, c("_urgent")).otherwise(c("_principal")), "_kept": F.size(F.filter("_measured", lambda m: measurement_present(c("_folded"), fold(m)))),
    })
    unsaid = F.filter("_needed", lambda g: ~(F.contains(c("_conclusion"), g["folded"]) | clinical.reflected(g["tokens"], c("_conclusion_tokens"), c("_clauses"))))
    return rows.withColumns({"_absent": unsaid, "_right": F.size(F.filter("_sided", lambda g: side_kept(g, c("_pieces"), c("_lined"))))})


def _gold_checks() -> Column:
    c = F.col
    n = lambda kind: F.size(F.filter("matches", lambda m: m["match"] == kind))
    missed = lambda *s: F.filter("matches", lambda m: (m["match"] == "missed") & m["severity"].isin(*s))
    text = lambda x: x.cast("string")
    high = F.size(F.filter("invented", lambda h: h["confidence"] == "high"))
    shown = F.when(F.size("_urgent") > 0, F.size("_absent") == 0).otherwise(F.size("_absent") < F.size("_needed"))
    synthesis = c("synthesis")
    return listed(
        F.when(F.size("matches") > 0, check("QUAL", "QG01", "Gold finding detection rate", F.when(F.size(missed("critical", "major")) > 0, "critical").otherwise("major"),
            (n("missed") == 0) | ((n("exact") + n("partial")) / F.size("matches") >= 0.8),
            F.concat(F.lit("exact="), text(n("exact")), F.lit(" partial="), text(n("partial")), F.lit(" missed="), text(n("missed")), F.lit(" total="), text(F.size("matches"))))),
        F.when(F.size(missed("critical")) > 0, check("QUAL", "QG02", "Critical findings not missed", "critical", F.lit(False), F.concat(F.lit("missed critical: "), F.array_join(F.transform(missed("critical"), lambda m: m["finding"]), "; ")))),
        check("QUAL", "QG03", "No significant hallucinations", "major", high == 0, F.when(F.size("invented") > 0, F.concat(text(F.size("invented")), F.lit(" potential hallucinations"))).otherwise("ok")),
        check("QUAL", "QG07", "Report synthesizes findings beyond input copy", "major", synthesis["penalty"] == 0,
            F.concat(F.lit("copiedOutputRatio="), text(half_up(synthesis["copied"] * 100)), F.lit("% addedTokens="), text(synthesis["added"]), F.lit(" clinicalAddedTokens="), text(synthesis["clinical"]), F.lit(" reason="), synthesis["reason"])),
        F.when(F.size("_measured") > 0, check("QUAL", "QG04", "Gold finding measurements preserved", "minor", c("_kept") / F.size("_measured") >= 0.67, F.concat(text(c("_kept")), F.lit("/"), text(F.size("_measured")), F.lit(" measurements preserved")))),
        F.when((F.size("_principal") > 0) & (F.trim("_conclusion") != ""), check("QUAL", "QG06", "Impression reflects the principal finding", "major", shown,
            F.when(shown, "principal finding(s) reflected in impression").otherwise(F.concat(F.lit("impression does not address: "), F.array_join(F.transform("_absent", lambda g: g["finding"]), "; "))))),
        F.when(F.size("_sided") > 0, check("QUAL", "QG05", "Gold finding laterality correct", F.when(F.exists("_sided", lambda g: g["severity"] == "critical"), "critical").otherwise("major"),
            c("_right") == F.size("_sided"), F.concat(text(c("_right")), F.lit("/"), text(F.size("_sided")), F.lit(" laterality correct")))),
    )


def quality(cases: DataFrame, locales=LOCALES) -> DataFrame:
    """cases with matches, invented, synthesis, quality_mode, quality_score and quality_checks.

    What is invented and what a report synthesises is told against gold: without gold none and null."""
    names = [*cases.columns, *QUALITY]
    full = with_defaults(cases)
    return by_locale(full, lambda rows, lex: _added(rows, _quality, lex).select(*dict.fromkeys([*full.columns, *names])), locales).select(*dict.fromkeys(names))


# ---- Urgent findings


def scored_label(x: Column, lex: Lexicon) -> Column:
    """A label of an urgent finding that a report must have: one of its urgent terms is affirmed in its clause."""
    terms = F.regexp_extract_all(x, F.lit(clinical.any_case(lex.bands[0][1])), 0)
    affirmed = lambda ts: F.when(F.size(ts) == 0, ~clinical.has_cue(x, lex)).otherwise(F.exists(ts, lambda t: ~clinical.mention_denied(x, t, lex)))
    return ~clinical.raises_or_manages(x) & let(terms, affirmed)


def _detected(lex: Lexicon) -> Column:
    """(label, hit) for each label, and the mentions that are taken, in order of the labels."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.expr("cast(array() as array<struct<label:string,hit:boolean>>)").alias("out"))

    def said(folded: Column, tokens: Column) -> Column:
        """The sentence that holds the label literally, else the one that covers half of it."""
        literal = F.get(F.filter("_sentences", lambda s: F.contains(s["folded"], folded)), F.lit(0))["text"]
        nearest = let(clinical.best(F.col("_sentences"), lambda s: coverage(tokens, s["tokens"])), lambda x: F.when(x["worth"] >= 0.5, x["item"]["text"]))
        return F.when(F.contains("_folded", folded), literal).otherwise(nearest)

    def one(label: Column) -> Column:
        return let(fold(label), lambda f: let(clinical.tokens(label), lambda t: let(coverage(t, F.col("_tokens")), lambda r: let(said(f, t), lambda x: rated(label, f, t, r, x)))))

    def rated(label: Column, folded: Column, tokens: Column, ratio: Column, x: Column) -> Column:
        against = x.isNotNull() & (clinical.sides_conflict(label, x) | clinical.mention_denied(x, label, lex))
        strong = F.contains("_folded", folded) | ((F.size(tokens) > 0) & (ratio >= 0.92))
        own = F.transform("_mentions", lambda m: F.struct(F.contains(fold(m["text"]), folded).cast("double").alias("holds"), coverage(tokens, clinical.tokens(fold(m["text"]))).alias("alike")))
        return F.struct(label.alias("label"), ((strong | (ratio >= 0.55)) & ~F.coalesce(against, F.lit(False))).alias("hit"), strong.alias("strong"), own.alias("own"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(F.transform(x["own"], lambda m, i: F.struct(F.when(x["strong"], m["holds"]).otherwise(m["alike"]).alias("w"), i.alias("i"))), lambda m: ~F.array_contains(acc["used"], m["i"]))
        put = lambda top: F.struct(
            F.array_compact(F.array_append(acc["used"], F.when(x["hit"], top["item"]["i"]))).cast("array<int>").alias("used"),
            F.array_append(acc["out"], F.struct(x["label"].alias("label"), x["hit"].alias("hit"))).cast("array<struct<label:string,hit:boolean>>").alias("out"),
        )
        return let(clinical.best(free, lambda m: m["w"]), put)

    return F.aggregate(F.transform("_labels", one), start, step)


def _backed(text: Column, lex: Lexicon) -> Column:
    """The source's nearest clause affirms the mention too."""

    def of(top: Column, terms: Column) -> Column:
        clause = top["item"]["text"]
        affirmed = F.when(F.size(terms) == 0, ~clinical.has_cue(clause, lex)).otherwise(F.exists(terms, lambda t: F.contains(F.lower(clause), F.lower(t)) & ~clinical.mention_denied(clause, t, lex)))
        return F.coalesce((top["worth"] >= 0.55) & affirmed, F.lit(False))

    nearest = let(clinical.tokens(text), lambda own: clinical.best(F.col("_source_clauses"), lambda s: coverage(own, s["tokens"])))
    return let(nearest, lambda top: let(F.regexp_extract_all(text, F.lit(clinical.any_case(lex.bands[0][1])), 0), lambda terms: of(top, terms)))


def told_by(column: str | None):
    """A detector that takes a model's word: the column lists the labels that the report affirms (see models.detected). None is an
    error, so a model is never assumed silently."""
    if not column:
        raise ValueError("a model's detector needs the column of its answers")

    def detect(lex: Lexicon) -> Column:
        affirmed = lambda x: F.coalesce(F.array_contains(F.col(column), x), F.lit(False))
        return F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.transform("_labels", lambda x: F.struct(x.alias("label"), affirmed(x).alias("hit"))).alias("out"))

    return detect


def rates(tp: Column, fn: Column, fp: Column) -> tuple[Column, Column, Column]:
    """recall, precision and their harmonic mean; 1 where there is nothing to find."""
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    return recall, precision, F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def _critical(rows: DataFrame, lex: Lexicon, detect=None) -> DataFrame:
    c = F.col
    sentence = lambda s: F.struct(s.alias("text"), fold(s).alias("folded"), clinical.tokens(s).alias("tokens"))
    source = strip_tags(F.concat_ws("\n", "findings", F.coalesce("reference", F.lit("")), F.array_join(F.transform("gold", lambda g: g["finding"]), "\n")))
    of_gold = F.transform(F.filter("gold", lambda g: (g["severity"] == "critical") & ~F.coalesce(g["negated"], F.lit(False))), lambda g: g["finding"])
    rows = rows.withColumns({
        "_folded": fold(strip_tags(c("html"))), "_tokens": clinical.tokens(c("html")), "_mentions": extraction.critical_mentions(c("html"), lex),
        "_sentences": F.transform(clinical.sentences(c("html"), least=4), sentence), "_labels": F.filter(F.when(F.size("urgent") > 0, c("urgent")).otherwise(of_gold), lambda x: scored_label(x, lex)),
        "_source_clauses": F.transform(F.filter(F.transform(F.split(F.regexp_replace(source, r"(?i)<br\s*/?>", "\n"), r"[.\n;]"), clinical.trim), lambda s: s != ""), lambda s: F.struct(s.alias("text"), clinical.tokens(s).alias("tokens"))),
    })
    rows = rows.withColumn("_detected", (detect or _detected)(lex))
    # A mention that shares a word for a lesion or a process with a label isn't held against the report.
    modifiers = F.split(F.lit(" ".join(lexicon.MODIFIERS)), " ")
    needle = lambda x: let(clinical.tokens(x), lambda t: let(F.array_except(t, modifiers), lambda own: F.struct(x.alias("label"), F.when(F.size(own) > 0, own).otherwise(t).alias("words"))))
    free = F.filter(F.transform("_mentions", lambda m, i: F.when(~F.array_contains(c("_detected")["used"], i), F.struct(m["text"].alias("text"), clinical.tokens(m["text"]).alias("tokens")))), lambda m: m.isNotNull())
    rows = rows.withColumns({"_needles": F.transform("_labels", needle), "_free": free})
    akin = lambda m: F.exists("_needles", lambda n: (coverage(n["words"], m["tokens"]) >= 0.25) & ~clinical.sides_conflict(n["label"], m["text"]))
    rows = rows.withColumn("_false", F.filter(F.filter("_free", lambda m: (F.size("_labels") == 0) | ~akin(m)), lambda m: ~_backed(m["text"], lex)))
    rows = rows.withColumns({"_hits": c("_detected")["out"], "_missed": F.filter(c("_detected")["out"], lambda h: ~h["hit"])})
    hits, missed = c("_hits"), c("_missed")
    rows = rows.withColumns(dict(zip(("recall", "precision", "f1"), rates(F.size(hits) - F.size(missed), F.size(missed), F.size("_false")), strict=True)))
    tp, fn, fp = F.size(hits) - F.size(missed), F.size(missed), F.size("_false")
    recall, precision, f1 = c("recall"), c("precision"), c("f1")
    percent = lambda x: half_up(x * 100).cast("string")
    text = lambda x: x.cast("string")
    said = F.array_join(F.transform("_false", lambda m: m["text"]), "; ")
    own = F.filter("structural", lambda s: s["dim"] == "CRIT")
    each = F.transform(missed, lambda h: check("CRIT", F.concat(F.lit("CG02-"), F.substring(F.regexp_replace(fold(h["label"]), r"\s+", "-"), 1, 20)), F.concat(F.lit("Missed critical finding: "), h["label"]), "critical", F.lit(False), "not found in report")).cast(CHECK)
    gold = F.concat(
        listed(check("CRIT", "CG01", "Critical finding recall", "critical", recall >= 0.9, F.concat(F.lit("recall="), percent(recall), F.lit("% (TP="), text(tp), F.lit(" FN="), text(fn), F.lit(")")))), each,
        listed(
            check("CRIT", "CG03", "Critical finding precision", F.when(fp > 0, "critical").otherwise("major"), precision >= 0.7, F.concat(F.lit("precision="), percent(precision), F.lit("% (FP="), text(fp), F.lit(")"))),
            check("CRIT", "CG04", "Critical finding F1 score", "major", f1 >= 0.8, F.concat(F.lit("F1="), percent(f1), F.lit("%"))),
        ),
    )
    none = listed(F.when(fp > 0, check("CRIT", "CG00", "No unexpected critical finding", "critical", F.lit(False), F.concat(F.lit("unexpected critical mention(s): "), said))).otherwise(
        check("CRIT", "CG00", "No gold critical finding expected", "minor", F.lit(True), "goldFindings contain no affirmative critical-severity finding")))
    labelled, some = F.size("_labels") > 0, F.size("gold") > 0
    return rows.withColumns({
        "critical_mode": F.when(labelled, "gold-critical").when(some, "gold-critical-none").otherwise("structural-fallback"), "true_positives": F.transform(F.filter(hits, lambda h: h["hit"]), lambda h: h["label"]),
        "false_negatives": F.transform(missed, lambda h: h["label"]), "false_positives": F.transform("_false", lambda m: m["text"]),
        "critical_score": F.when(labelled, half_up(recall * 70 + precision * 30)).when(some, F.when(fp > 0, 0).otherwise(100)).otherwise(weighted_share(own, CHECK_WEIGHTS)),
        "critical_checks": F.when(labelled, gold).when(some, none).otherwise(own),
    })


def critical(cases: DataFrame, detect=None, locales=LOCALES) -> DataFrame:
    """detect: another detector, lexicon -> column of (used: places in _mentions, out: array of label and hit) over _labels, _mentions and _sentences.

    Result: cases with critical_mode, true_positives, false_negatives, false_positives, recall, precision, f1, critical_score and critical_checks."""
    full = with_defaults(cases)
    return by_locale(full, lambda rows, lex: _added(rows, _critical, lex, detect).select(*dict.fromkeys([*full.columns, *CRITICAL])), locales).select(*dict.fromkeys([*cases.columns, *CRITICAL]))


# ---- Guidelines


def _context(wide: bool) -> Column:
    gold = F.array_join(F.transform("gold", lambda g: F.concat_ws(" ", g["finding"], g["location"], F.array_join(F.coalesce(g["measurements"], F.expr("cast(array() as array<string>)")), " "))), " ")
    return fold(F.concat_ws(" ", "exam", "findings", gold, strip_tags(F.coalesce("reference", F.lit("")))) if wide else F.concat_ws(" ", "exam", "findings"))


def applies(g: lexicon.Guideline) -> Column:
    text = F.col("_wide") if g.wide else F.col("_narrow")
    out = F.col("modality").isin(*g.modalities) & ~F.col("_wide").rlike(g.unless)
    for pattern in g.context:
        out = out & text.rlike(clinical.any_case(pattern))
    return out


def _mentions(g: lexicon.Guideline, plain: Column) -> tuple[Column, Column]:
    """(the report names the guideline, it says what to do next)."""
    return plain.rlike(g.mention), plain.rlike(g.recommendation)


def guidelines(cases: DataFrame, registry: tuple[lexicon.Guideline, ...] = lexicon.GUIDELINES) -> DataFrame:
    """cases with guide_mode, guide_score and guide_checks. registry: the guidelines that are known; further ones can be added.

    A guideline is expected explicitly, or because the reference report names it, or, without a reference report, because
    the source calls for it. Without any expectation the guidelines that a report names itself are checked, else the
    structural coverage checks whose word the source has.
    """
    return _added(with_defaults(cases), _guidelines, registry).select(*cases.columns, "guide_mode", "guide_score", "guide_checks")


def _guidelines(rows: DataFrame, registry: tuple[lexicon.Guideline, ...]) -> DataFrame:
    c = F.col
    rows = rows.withColumns({"_plain": strip_tags(c("html")), "_ref": strip_tags(F.coalesce("reference", F.lit(""))), "_wide": _context(True), "_narrow": _context(False)})
    rows = rows.withColumns({"_found": extraction.classifications(c("html")), "_ref_found": extraction.classifications(F.coalesce("reference", F.lit("")))})
    has_ref = c("reference").isNotNull() & (c("reference") != "")
    expected, observed, any_expected, any_observed = [], [], [], []
    known = [g.id for g in registry]
    for g in registry:
        explicit = F.get(F.filter("expectations", _is(g.id)), F.lit(0))
        in_ref, ref_next = _mentions(g, c("_ref"))
        ref_class = F.get(F.filter("_ref_found", _of(g.id)), F.lit(0))["raw"]
        by_ref = has_ref & applies(g) & in_ref
        by_source = ~has_ref & applies(g) & (c("_wide").rlike(clinical.any_case(lexicon.PROSTATE)) if g.id == "pirads" else F.lit(True))
        wanted = explicit.isNotNull() | by_ref | by_source
        wanted_class = F.when(explicit.isNotNull(), explicit["classification"]).when(by_ref, ref_class)
        wanted_next = F.when(explicit.isNotNull(), F.coalesce(explicit["required"], F.lit(False))).when(by_ref, ref_next).otherwise(F.lit(False))
        present, says_next = _mentions(g, c("_plain"))
        found = F.filter("_found", _of(g.id))
        raw = F.array_join(F.transform(found, lambda x: x["raw"]), ", ")
        title = g.name.split(" (")[0]
        details = F.when(present, F.lit("Fleischner referenced") if g.id == "fleischner" else F.concat(F.lit(f"{title.removesuffix(' Classification')} found: "), F.coalesce(F.nullif(raw, F.lit("")), F.lit("mentioned without value")))).otherwise(g.absent)
        # Fleischner has no categories: naming it is right. Others are judged only where a value stands.
        right = F.when(wanted_class.isNotNull(), present) if g.id == "fleischner" else F.when(wanted_class.isNotNull() & (F.size(found) > 0), F.exists(found, lambda x: x["normal"] == extraction.normal_value(wanted_class)))
        first = F.lit(None).cast("string") if g.id == "fleischner" else F.get(found, F.lit(0))["raw"]
        wrong = F.filter(found, lambda x: ~extraction.valid_value(x["system"], x["normal"])) if g.id != "fleischner" else F.filter(found, lambda x: F.lit(False))

        def ranges(prefix: str, when: Column, wrong=wrong, g=g) -> Column:
            made = F.transform(wrong, lambda x: check("GUIDE", f"{prefix}-{g.id}-valid-range", f"{g.name}: classification value in valid range", "critical", F.lit(False), F.concat(F.lit('invalid value "'), x["raw"], F.lit('" (normalized: "'), x["normal"], F.lit(f'") — not in allowed set for {g.id}')))).cast(CHECK)
            return F.when(when, made).otherwise(F.expr(f"cast(array() as {CHECK})"))

        content = F.filter(F.split(fold(explicit["recommendation"]), r"\s+"), lambda t: F.char_length(t) > 3)
        held = let(fold(c("_plain")), _standing(content))
        correct = F.when(right.isNotNull(), check("GUIDE", f"GE-{g.id}-correct", f"{g.name}: classification correct", "critical", right, F.concat(F.lit("found="), F.when(right, F.coalesce(first, F.lit("undefined"))).otherwise(F.coalesce(first, F.lit("none"))), F.lit(" expected="), wanted_class))).when(
            present & first.isNull(), check("GUIDE", f"GE-{g.id}-correct", f"{g.name}: classification correct", "critical", F.lit(False), F.concat(F.lit("guideline named but no actionable category supplied; expected="), wanted_class)))
        expected.append(F.concat(
            listed(F.when(wanted, check("GUIDE", f"GE-{g.id}-presence", f"{g.name}: classification present", "major", present, details))), ranges("GE", wanted & present),
            listed(
                F.when(wanted & wanted_class.isNotNull(), correct),
                F.when(wanted & wanted_next, check("GUIDE", f"GE-{g.id}-recommendation", f"{g.name}: recommendation present", "minor", says_next, F.when(says_next, "recommendation found").otherwise("recommendation missing"))),
                F.when(explicit["recommendation"].isNotNull(), check("GUIDE", f"GE-{g.id}-rec-content", f"{g.name}: expected recommendation content", "minor", (F.size(content) == 0) | (F.size(held) / F.size(content) >= 0.5), F.concat(F.size(held).cast("string"), F.lit("/"), F.size(content).cast("string"), F.lit(" key terms matched")))),
            ),
        ))
        any_expected.append(wanted)
        seen = applies(g) & present
        observed.append(F.concat(listed(F.when(seen, check("GUIDE", f"GA-{g.id}", f"{g.name}: classification mentioned", "minor", present, details))), ranges("GA", seen)))
        any_observed.append(seen)
    unknown = F.filter("expectations", lambda e: ~e["guideline"].isin(*known))
    odd = F.transform(unknown, lambda e: check("GUIDE", F.concat(F.lit("GX-"), e["guideline"]), F.concat(F.lit("Unknown guideline: "), e["guideline"]), "minor", F.lit(True), "guideline module not registered")).cast(CHECK)
    rows = rows.withColumns({"_expected": F.concat(odd, *expected), "_observed": F.concat(*observed), "_wanted": clinical.any_of(any_expected) | (F.size("expectations") > 0), "_seen": clinical.any_of(any_observed)})
    scope = fold(F.concat_ws(" ", "findings", F.array_join(F.transform("gold", lambda g: F.concat_ws(" ", g["finding"], g["location"], F.array_join(F.coalesce(g["measurements"], F.expr("cast(array() as array<string>)")), " "))), " "), "_ref"))
    own = F.filter("structural", lambda s: s["dim"] == "GUIDE")
    token = lambda s: fold(F.coalesce(F.nullif(F.regexp_extract(s["evidence"], r"(?i)^missing:\s*(.+)$", 1), F.lit("")), F.regexp_extract(s["name"], r"(?i)Anatomical coverage:\s*(.+)$", 1)))
    scoped = F.when(scope == "", own).otherwise(F.filter(own, lambda s: (token(s) != "") & F.contains(scope, token(s))))
    out = rows.withColumns({
        "guide_mode": F.when(c("_wanted"), "expected-guidelines").when(c("_seen"), "auto-detect-observed").otherwise("anatomical-coverage-fallback"),
        "guide_checks": F.when(c("_wanted"), c("_expected")).when(c("_seen"), c("_observed")).otherwise(scoped),
    })
    share = weighted_share(c("guide_checks"), CHECK_WEIGHTS)
    floor = lambda n: F.when(F.size("guide_checks") == 0, 100).otherwise(F.greatest(F.lit(n), share))
    return out.withColumn("guide_score", F.when(c("_wanted"), floor(55)).when(c("_seen"), floor(75)).otherwise(share))


def _standing(words: Column):
    return lambda text: F.filter(words, lambda w: F.contains(text, w))


def _is(name: str):
    return lambda e: e["guideline"] == name


def _of(name: str):
    return lambda x: x["system"] == name


# ---- Retrieval


def unsupported_acquisition(html: Column, source: Column) -> Column:
    """Details of acquisition that the report has and the source has not."""
    said, given = fold(strip_tags(html)), fold(source)
    return F.array_compact(F.array(*(F.when(said.rlike(p) & ~given.rlike(p), F.lit(n)) for n, p in lexicon.ACQUISITION)))


def _gain(grades: Column) -> Column:
    # Powers of two are exact; the sum runs in order of rank.
    return F.aggregate(F.transform(grades, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)


def _retrieval(rows: DataFrame) -> DataFrame:
    c = F.col
    own = F.filter("structural", lambda s: (s["dim"] == "RAG") & (s["id"] != "R05"))
    odd = unsupported_acquisition(c("html"), F.concat_ws(" ", "exam", "findings", F.coalesce("reference", F.lit(""))))
    rows = rows.withColumns({"_own": own, "_odd": odd, "_docs": F.array_distinct("retrieved"), "_graded": F.coalesce(F.size(F.map_keys("relevance")), F.lit(0)) > 0})
    rows = rows.withColumns({"_grades": F.transform("_docs", lambda d: F.coalesce(c("relevance")[d], F.lit(0))), "_ideal": F.reverse(F.array_sort(F.map_values("relevance"))), "_k": F.least(F.lit(5), F.size("_docs"))})
    top = F.slice("_grades", F.lit(1), F.greatest(c("_k"), F.lit(1)))
    found = F.size(F.filter(top, lambda r: r >= 1))
    wanted = F.size(F.filter("_ideal", lambda r: r >= 1))
    ideal = _gain(F.slice("_ideal", F.lit(1), F.greatest(c("_k"), F.lit(1))))
    first = F.array_position(F.transform("_grades", lambda r: r >= 1), True)
    rows = rows.withColumns({
        "_p": F.when(F.size(top) > 0, found / F.size(top)).otherwise(0.0), "_r": F.when(wanted > 0, found / wanted).otherwise(1.0), "_n": F.when(ideal > 0, _gain(top) / ideal).otherwise(0.0), "_m": F.when(first > 0, 1.0 / first).otherwise(0.0),
    })
    percent = lambda x: F.concat(half_up(x * 100).cast("string"), F.lit("%"))
    at = lambda name, x: F.concat(F.lit(f"{name}@"), c("_k").cast("string"), F.lit("="), percent(x))
    title = lambda name: F.concat(F.lit(f"{name}@"), c("_k").cast("string"))
    graded = listed(
        check("RAG", "RG01", title("Precision"), "major", c("_p") >= 0.6, at("P", c("_p"))), check("RAG", "RG02", title("Recall"), "major", c("_r") >= 0.5, at("R", c("_r"))),
        check("RAG", "RG03", title("nDCG"), "major", c("_n") >= 0.5, at("nDCG", c("_n"))), check("RAG", "RG04", "Mean Reciprocal Rank", "major", c("_m") >= 0.5, F.concat(F.lit("MRR="), percent(c("_m")))),
    )
    extra = listed(F.when(F.size("_odd") > 0, check("RAG", "R-ACQ", "No unsupported acquisition details", "major", F.lit(False), F.array_join("_odd", ", "))))
    fallback = F.concat("_own", extra)
    piped = c("_graded") & (F.size("_docs") > 0)
    rows = rows.withColumn("retrieval_checks", F.when(piped, graded).when(c("_graded"), c("_own")).otherwise(fallback))
    mode = F.when(piped, "retrieval-evaluation").when(c("_graded"), "retrieval-gold-present-no-pipeline").when(F.size("retrieval_checks") > 0, "structural-fallback").otherwise("unscored")
    score = F.when(piped, F.least(F.lit(100), half_up(c("_r") * 40 + c("_p") * 20 + c("_n") * 25 + c("_m") * 15))).when(F.size("retrieval_checks") > 0, weighted_share(c("retrieval_checks"), RETRIEVAL_WEIGHTS)).otherwise(-1)
    return rows.withColumns({"retrieval_mode": mode, "retrieval_score": score})


def retrieval(cases: DataFrame) -> DataFrame:
    """cases with retrieval_mode, retrieval_score (-1: not scored) and retrieval_checks."""
    return _added(with_defaults(cases), _retrieval).select(*cases.columns, "retrieval_mode", "retrieval_score", "retrieval_checks")


def evaluate(cases: DataFrame, locales=LOCALES, guide: bool = True) -> DataFrame:
    """cases of these locales with the results of all four evaluators, or of those but the guidelines' (guide=False)."""
    new = [*QUALITY, *CRITICAL]
    full = with_defaults(cases)
    both = by_locale(full, lambda rows, lex: _added(_added(rows, _quality, lex).select(*dict.fromkeys([*full.columns, *QUALITY])), _critical, lex, None).select(*dict.fromkeys([*full.columns, *new])), locales)
    guided = ["guide_mode", "guide_score", "guide_checks"] if guide else []
    return retrieval(guidelines(both) if guide else both).select(*dict.fromkeys([*cases.columns, *new, *guided, "retrieval_mode", "retrieval_score", "retrieval_checks"]))
