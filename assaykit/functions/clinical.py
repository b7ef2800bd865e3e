"""Clinical text as columns: tokens, coverage, negation by clause, sections, sentences. Everything stays in the JVM.

Functions take a text column as it stands unless they say folded; token columns are arrays of distinct tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .lexicon import Lexicon
from .text import CONFUSABLE, fold, strip_tags, token_matches

EMPTY = "cast(array() as array<string>)"


def one_of(x: Column, words) -> Column:
    """x is one of the words: a single pattern, as a plan with a literal for each would be long."""
    return x.rlike(f"^(?:{'|'.join(words)})$")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def any_case(pattern: str) -> str:
    return f"(?iu){pattern}"


def lines(html: Column) -> Column:
    """Text of markup, with line breaks where the markup has them."""
    return strip_tags(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"))


def sentences(html: Column, stops: str = r"[.\n]", least: int = 1) -> Column:
    """Trimmed pieces of the text of at least that many characters."""
    return F.filter(F.transform(F.split(lines(html), stops), trim), lambda s: F.char_length(s) >= least)


def tokens(x: Column) -> Column:
    """Distinct words that count: abbreviations written out, three letters or more, no stopwords."""
    x = F.concat(F.lit(" "), strip_tags(x), F.lit(" "))
    for pattern, by in lexicon.CAPITALS:
        x = F.regexp_replace(x, pattern, by)
    x = F.regexp_replace(fold(x), "[^a-z0-9]+", " ")
    for pattern, by in lexicon.WRITTEN_OUT:
        x = F.regexp_replace(x, pattern, by)
    return F.array_distinct(F.filter(F.split(x, r"\s+"), lambda t: (F.char_length(t) > 2) & ~one_of(t, lexicon.STOPWORDS)))


def comparable(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def let(x: Column, body) -> Column:
    """body(x) with x computed once, however often body names it. Keeps plans as long as they read."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def hits(needle: Column, haystack: Column) -> Column:
    """Number of the needle's tokens that match one of the haystack's, see text.token_matches.

    Pairs aren't compared one by one: a token stands in the haystack, or its first five letters start a token there. Only
    words that can be confused are held against each token.
    """
    confusable = sorted({w for pair in CONFUSABLE for w in pair.split("|")})
    starts = lambda hs: F.transform(F.filter(hs, lambda c: F.char_length(c) >= 5), lambda c: F.substring(c, 1, 5))

    def matched(t: Column, hs: Column, five: Column) -> Column:
        begun = (F.char_length(t) >= 5) & F.array_contains(five, F.substring(t, 1, 5))
        return F.array_contains(hs, t) | (begun & (~one_of(t, confusable) | F.exists(hs, lambda c: token_matches(t, c))))

    return let(haystack, lambda hs: let(starts(hs), lambda five: F.size(F.filter(needle, lambda t: matched(t, hs, five)))))


def coverage(needle: Column, haystack: Column) -> Column:
    """Share of the needle's tokens that match one of the haystack's; 0 without tokens."""
    return let(needle, lambda n: F.when(F.size(n) == 0, 0.0).otherwise(hits(n, haystack) / F.size(n)))


def similarity(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise((hits(x, y) / F.size(x) + hits(y, x) / F.size(y)) / 2)))


def best(items: Column, worth) -> Column:
    """The first of the items with the highest worth above 0, as a struct (worth, item); null if there is none."""

    def of(xs: Column) -> Column:
        top = F.array_max(F.transform(xs, lambda x, i: F.struct(worth(x).cast("double").alias("worth"), (-i).alias("at"))))
        return let(top, lambda t: F.when(t["worth"] > 0, F.struct(t["worth"].alias("worth"), F.get(xs, -t["at"]).alias("item"))))

    return let(items, of)


# ---- Negation


def denied(x: Column, lex: Lexicon) -> Column:
    """The sentence as a whole denies something."""
    return fold(x).rlike(lex.denials)


def has_cue(x: Column, lex: Lexicon) -> Column:
    """Any cue of denial, wherever it stands."""
    return fold(x).rlike(f"{lex.before}|{lex.after}|{lex.denials}")


def mention_denied(sentence: Column, mention: Column, lex: Lexicon) -> Column:
    """The clause of the mention denies it; where the sentence doesn't hold the mention literally, any cue counts."""

    def of(s: Column, m: Column, at: Column) -> Column:
        # What stands before and after it, up to the nearest border of a clause on either side.
        before = F.regexp_replace(F.substring(s, F.lit(1), at - 1), f"(?s)^.*(?:[,;:]|{lexicon.TURN})", "")
        after = F.regexp_extract(F.substring(s, at + F.char_length(m), F.char_length(s)), f"(?s)^(.*?)(?:[,;:]|{lexicon.TURN}|$)", 1)
        anywhere = s.rlike(f"{lex.before}|{lex.after}|{lex.denials}")
        return F.when(at == 0, anywhere).otherwise(before.rlike(lex.before) | after.rlike(lex.after))

    return let(fold(sentence), lambda s: let(fold(mention), lambda m: let(F.call_function("instr", s, m), lambda at: of(s, m, at))))


def primary_clause(x: Column) -> Column:
    """The first clause that says something, else the whole text."""

    def of(t: Column) -> Column:
        clauses = F.transform(F.split(t, f"(?i)[,;:.\\n]|{lexicon.TURN}"), trim)
        return F.coalesce(F.get(F.filter(clauses, lambda c: F.size(tokens(c)) >= 1), F.lit(0)), t)

    return let(x, of)


def raises_or_manages(x: Column) -> Column:
    """Only a possibility, or nothing but a recommendation: not a finding that a report must have."""

    def of(f: Column) -> Column:
        rest = F.filter(F.transform(F.split(f, r"[.,;\n]"), trim), lambda c: (c != "") & ~c.rlike(lexicon.MANAGEMENT))
        return f.rlike(any_case(lexicon.POSSIBILITY)) | (f.rlike(any_case(lexicon.MANAGEMENT)) & (F.size(tokens(F.array_join(rest, " "))) < 2))

    return let(fold(x), of)


# ---- Format of one mention


def severity(x: Column, lex: Lexicon) -> Column:
    out = F
    for name, pattern in lex.bands:
        out = out.when(x.rlike(any_case(pattern)), name)
    return out.otherwise("incidental")


def side(x: Column, lex: Lexicon) -> Column:
    """The side that a text names; both sides are bilateral."""

    def of(t: Column) -> Column:
        on = {name: t.rlike(any_case(p)) for name, p in lex.sides}
        return F.when(on["bilateral"] | (on["right"] & on["left"]), "bilateral").when(on["right"], "right").when(on["left"], "left")

    return let(x, of)


def sides(x: Column) -> Column:
    """All sides that a text of either language names."""
    named = (("right", r"\b(?:right|direit[ao]s?)\b"), ("left", r"\b(?:left|esquerd[ao]s?)\b"), ("bilateral", r"\b(?:bilateral|bilaterais)\b"))
    return let(fold(x), lambda f: F.array_compact(F.array(*(F.when(f.rlike(p), F.lit(n)) for n, p in named))))


def sides_conflict(expected: Column, observed: Column) -> Column:
    """Two texts: what the first has on one side stands on the other one only in the second."""
    has = F.array_contains

    def of(x: Column, y: Column) -> Column:
        one = has(y, "right") != has(y, "left")
        turned = (has(x, "right") & has(y, "left") & ~has(y, "right")) | (has(x, "left") & has(y, "right") & ~has(y, "left"))
        return (F.size(x) > 0) & (F.size(y) > 0) & F.when(has(x, "bilateral"), ~has(y, "bilateral") & one).otherwise(turned)

    return let(sides(expected), lambda x: let(sides(observed), lambda y: of(x, y)))


def location(x: Column, lex: Lexicon) -> Column:
    return F.nullif(trim(F.regexp_extract(x, any_case(lex.location), 0)), F.lit(""))


def measures(x: Column) -> Column:
    """Distinct measurements with all their axes, as they stand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?i)\b\d+(?:[.,]\d+)?(?:\s*x\s*\d+(?:[.,]\d+)?)*\s*(?:mm|cm)\b"), 0), trim))


# ---- Sections


def section(plain: Column, heads, others) -> Column:
    """Folded text after the first line that has a head, up to the first later line that has another one; lines with heads left out."""
    named = lambda hs: F.lit("|".join(rf"\b{_folded(h)}\b" for h in hs))
    own, stop = named(heads), named([h for h in others if h not in heads])
    kind = lambda r: F.when(F.regexp_like(r, own), 1).when(F.regexp_like(r, stop), 2).otherwise(0)
    rows = F.transform(F.split(plain, r"\n"), lambda r: let(fold(r), lambda x: F.struct(kind(x).alias("kind"), x.alias("r"))))
    place = lambda xs, n: F.array_position(F.transform(xs, lambda k: k["kind"]), n).cast("int")

    def of(rest: Column, end: Column) -> Column:
        held = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
        return trim(F.array_join(F.transform(F.filter(held, lambda k: k["kind"] == 0), lambda k: k["r"]), " "))

    def after(xs: Column, start: Column) -> Column:
        rest = F.slice(xs, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size(xs), F.lit(0)))
        return F.when(start > 0, let(rest, lambda r: let(place(r, 2), lambda end: of(r, end)))).otherwise("")

    return let(rows, lambda xs: let(place(xs, 1), lambda start: after(xs, start)))


def _folded(head: str) -> str:
    import re
    import unicodedata

    return re.escape("".join(c for c in unicodedata.normalize("NFD", head) if not 0x300 <= ord(c) <= 0x36F).lower())


def tagged_conclusion(html: Column, lex: Lexicon) -> Column:
    """Text after the bold head of the conclusion, to the end."""
    found = F.regexp_extract(html, rf"(?iu)<b>\s*{lex.conclusion_tag}[^<]*</b>\s*(?:<br\s*/?>|\s|:)*([\s\S]*)$", 1)
    return trim(lines(found))


def _heads(lex: Lexicon) -> tuple[str, ...]:
    return (*lex.analysis_heads, *lex.conclusion_heads, *lex.technique_heads)


def conclusion(html: Column, lex: Lexicon) -> Column:
    """Folded conclusion; the whole text where no conclusion can be told."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (fold(tagged_conclusion(html, lex)), section(lines(html), lex.conclusion_heads, _heads(lex)))), fold(lines(html)))


def has_conclusion(html: Column, lex: Lexicon) -> Column:
    """A conclusion of three words or more."""
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda t: F.char_length(t) > 2))
    return (words(fold(tagged_conclusion(html, lex))) >= 3) | (words(section(lines(html), lex.conclusion_heads, _heads(lex))) >= 3)


def conclusion_repeats_findings(html: Column, lex: Lexicon) -> Column:
    """Nine of ten tokens of each of the two sections stand in the other one."""
    plain = lines(html)
    a, b = (tokens(section(plain, own, _heads(lex))) for own in (lex.conclusion_heads, lex.analysis_heads))
    both = lambda x, y: (F.size(F.array_intersect(x, y)) / F.size(x) >= 0.9) & (F.size(F.array_intersect(y, x)) / F.size(y) >= 0.9)
    return let(a, lambda x: let(b, lambda y: F.when((F.size(x) < 2) | (F.size(y) < 2), F.lit(False)).otherwise(both(x, y))))


def section_scores(candidate: Column, reference: Column, lex: Lexicon) -> Column:
    """(section, share of the reference's words in percent) of each section that the reference has."""
    heads = [h for _, own in lex.compared for h in own]
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda t: F.char_length(t) > 2))
    made = []
    for name, own in lex.compared:
        ref, cand = words(section(lines(reference), own, heads)), words(section(lines(candidate), own, heads))
        made.append(_share(name, ref, cand))
    return F.array_compact(F.array(*made))


def _share(name: str, ref: Column, cand: Column) -> Column:
    made = lambda r: F.struct(F.lit(name).alias("section"), (F.size(F.array_intersect(r, cand)) / F.size(r) * 100.0).alias("score"))
    return let(ref, lambda r: F.when(F.size(r) > 0, made(r)))


# ---- Coverage by way of the source


def source_clauses(x: Column) -> Column:
    """Tokens of each clause of three tokens or more."""
    return F.filter(F.transform(F.split(lines(x), r"[.\n;]"), lambda c: tokens(trim(c))), lambda t: F.size(t) >= 3)


def backed_coverage(gold: Column, report: Column, clauses: Column) -> Column:
    """How much of the source's clause that is nearest to a finding stands in the report. gold, report: tokens."""

    def of(top: Column) -> Column:
        near = (top["worth"] >= F.least(F.lit(2), F.size(gold))) | (top["worth"] / F.size(gold) >= 0.5)
        return F.when((F.size(gold) > 0) & near & (coverage(gold, report) > 0), coverage(top["item"], report)).otherwise(0.0)

    return let(best(clauses, lambda c: hits(gold, c)), of)


def reflected(gold: Column, report: Column, clauses: Column) -> Column:
    return (coverage(gold, report) >= 0.5) | (backed_coverage(gold, report, clauses) >= 0.55)


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
