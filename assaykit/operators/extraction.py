"""Structured data from report markup: findings, classifications, recommendations, urgent mentions. One projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical, lexicon
from ..functions.lexicon import ENGLISH, LOCALES, Lexicon
from ..functions.text import fold, strip_tags

# Lines that are no findings.
HEADS = r"(?iu)^(?:análise|conclusão|técnica|findings|impression|technique)\s*$"
NOTHING = "(?iu)^(?:sem alterações|normal|unremarkable|within normal limits)"


def findings(html: Column, lex: Lexicon = ENGLISH) -> Column:
    """Array of (text, location, laterality, severity, measurements, negated): lines and sentences of eight characters or more."""
    pieces = F.transform(F.split(clinical.lines(html), r"\n|(?<=\.)\s+(?=[A-ZÁÀÂÃÉÈÊÍÏÓÔÕÖÚÜÇ])"), clinical.trim)
    held = F.filter(pieces, lambda s: (F.char_length(s) >= 8) & ~s.rlike(HEADS) & ~s.rlike(NOTHING))
    return F.transform(held, lambda s: F.struct(
        s.alias("text"), clinical.location(s, lex).alias("location"), clinical.side(s, lex).alias("laterality"), clinical.severity(s, lex).alias("severity"),
        clinical.measures(s).alias("measurements"), clinical.denied(s, lex).alias("negated"),
    ))


def _normal_form(system: str, value: Column) -> Column:
    v = F.upper(value)
    if system == "tirads":
        return F.regexp_replace(value, "[^0-9]", "")
    if system == "lirads":
        return F.upper(F.regexp_replace(F.regexp_replace(value, r"(?i)^LR[-\s]?", ""), r"\s+", " "))
    if system == "bosniak":
        return F.coalesce(F.create_map(*(F.lit(x) for kv in lexicon.ROMAN.items() for x in kv))[v], v)
    if system == "fleischner":
        return F.when(clinical.trim(value) == "", "mentioned").otherwise(F.lower(clinical.trim(value)))
    return v if system in ("birads", "lungrads") else value


def classifications(html: Column) -> Column:
    """Array of (system, raw, value, normal): mentions of classification systems, each system and normal form once."""
    plain = strip_tags(html)
    parts = []
    for k, (system, pattern) in enumerate(lexicon.CLASSIFICATIONS):
        raw, value = (F.regexp_extract_all(plain, F.lit(pattern), g) for g in (0, 1))
        pair = F.arrays_zip(raw.alias("raw"), value.alias("value"))
        alone = k and lexicon.CLASSIFICATIONS[k - 1][0] == system  # the form without the acronym
        name = lambda v, s=system, a=alone: F.regexp_replace(F.upper(v), r"\s+", "") if a else _normal_form(s, v)
        parts.append(_named(pair, system, name))
    return clinical.let(F.concat(*parts), lambda xs: _first_of(xs, lambda x: F.concat_ws(":", x["system"], x["normal"])))


def _first_of(items: Column, key) -> Column:
    """The first item of each key."""
    keys = F.transform(items, key)
    return clinical.let(keys, lambda ks: F.filter(F.transform(items, lambda x, i: F.when(F.array_position(ks, key(x)) == i + 1, x)), lambda x: x.isNotNull()))


def _named(pair: Column, system: str, normal) -> Column:
    def one(x: Column) -> Column:
        value = clinical.trim(x["value"])
        return F.struct(F.lit(system).alias("system"), x["raw"].alias("raw"), value.alias("value"), normal(value).alias("normal"))

    return F.transform(pair, one)


def normal_value(value: Column) -> Column:
    """A classification value without the name of its system, for comparison."""
    return clinical.let(fold(value), _plain_value)


def _plain_value(f: Column) -> Column:
    out = f
    # Names and marks, the first of each of which is dropped, in order.
    for pattern in (r"\bacr\s+", "®", r"bi[-\s]?rads\s*", r"ti[-\s]?rads\s*", r"li[-\s]?rads\s*", r"pi[-\s]?rads\s*", r"lung[-\s]?rads\s*", r"bosniak\s*", r"lr[-\s]?", r"tr[-\s]?(?=\d)"):
        out = F.regexp_replace(out, f"^(.*?)(?:{pattern})", "$1")
    out = F.regexp_replace(out, r"^[-:\s]+", "")
    out = F.upper(F.regexp_replace(out, r"\s+", ""))
    roman = F.create_map(*(F.lit(x) for kv in lexicon.ROMAN.items() for x in kv))
    return clinical.let(out, lambda v: F.when(f.contains("bosniak"), F.coalesce(roman[v], v)).otherwise(v))


def valid_value(system: Column, normal: Column) -> Column:
    """The value exists in its system; systems without a list take any."""
    out = F
    for name, values in lexicon.VALID.items():
        out = out.when(system == name, normal.isin(*values.split()))
    return out.otherwise(F.lit(True))


def recommendations(html: Column, lex: Lexicon = ENGLISH) -> Column:
    """Array of (text, type, timeframe): sentences of more than ten characters that say what to do next, the first type that fits."""

    def kind(s: Column) -> Column:
        return F.coalesce(*(F.when(s.rlike(clinical.any_case(p)), name) for name, p in lex.recommendations))

    made = F.transform(F.filter(F.transform(F.split(strip_tags(html), r"[.\n]"), clinical.trim), lambda s: F.char_length(s) > 10), lambda s: F.struct(
        s.alias("text"), kind(s).alias("type"), F.nullif(F.regexp_extract(s, clinical.any_case(lex.timeframe), 1), F.lit("")).alias("timeframe"),
    ))
    return F.filter(made, lambda x: x["type"].isNotNull())


def critical_mentions(html: Column, lex: Lexicon = ENGLISH) -> Column:
    """Array of (text, category): for each sentence the first category whose mention isn't denied in its clause; each category once."""

    def first(s: Column) -> Column:
        found = []
        for c in lex.categories:
            words, letters = F.regexp_extract(s, clinical.any_case(c.words), 0), F.regexp_extract(s, c.letters, 0)
            mention = clinical.let(words, _or(letters))
            found.append(clinical.let(mention, _unless_denied(s, c.name, lex)))
        return F.coalesce(*found)

    made = F.filter(F.transform(clinical.sentences(html, least=6), lambda s: F.struct(s.alias("text"), first(s).alias("category"))), lambda x: x["category"].isNotNull())
    return clinical.let(made, lambda xs: _first_of(xs, lambda x: x["category"]))


def _or(other: Column):
    return lambda w: F.when(w != "", w).otherwise(other)


def _unless_denied(sentence: Column, name: str, lex: Lexicon):
    return lambda m: F.when((m != "") & ~clinical.mention_denied(sentence, m, lex), name)


def extract(reports: DataFrame, kind: str, keys=("case_id",), html="html", locale: str | None = None) -> DataFrame:
    """(keys, n, ...): one row for each finding, classification, recommendation or critical mention of the reports, numbered from 0.

    locale: the column that names each report's locale; without it all are English.
    """
    made = {"findings": findings, "recommendations": recommendations, "critical_mentions": critical_mentions}

    def column(lex: Lexicon) -> Column:
        return classifications(F.col(html)) if kind == "classifications" else made[kind](F.col(html), lex)

    if locale is None:
        return _rows(reports, column(ENGLISH), keys)
    parts = [_rows(reports.where(F.col(locale) == lex.key), column(lex), keys) for lex in LOCALES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _rows(reports: DataFrame, items: Column, keys) -> DataFrame:
    """A row for each item. The outer form, as the optimizer would else compute the items once more to filter by their number."""
    return reports.select(*keys, F.posexplode_outer(items).alias("n", "x")).where(F.col("n").isNotNull()).select(*keys, "n", "x.*")
