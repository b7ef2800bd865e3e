"""How often checks notice changed reports, by kind of change, with no more evaluated than decides.

A change is noticed if any dimension of its kind fails, so dimensions are looked at in turn: what structural checks and
retrieval decide first, then quality, then urgent findings, each over the reports that nothing before has noticed. A
dimension's checks and score depend on that dimension alone, so the order changes no result.

Cases that agree in all that is looked at are changed and evaluated once, with their number. A case's id counts only by the
draws that it seeds, and these only by what the change makes of them.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import let
from ..functions.lexicon import LOCALES
from ..functions.rounding import to_fixed
from ..sources.scratch import spread, stored
from . import evaluators, robustness, scoring
from .evaluators import CHECK_WEIGHTS, served, with_defaults
from .submission import EVALUATED, GATES, given, has_rich_gold, structured

#: Columns of a case that one dimension alone looks at.
LOOKED_AT = {"relevance": "RAG", "retrieved": "RAG", "expectations": "GUIDE"}
#: How the draw of critical_invent is told apart: by its place among the sentences of each locale.
PLACES = lcm(*map(len, robustness.INVENTED.values()))


def asks() -> list[tuple[str | None, tuple[str, ...], list[str]]]:
    """(kind whose seed counts, columns of LOOKED_AT that count, kinds): what kinds take from a case."""
    out: dict[tuple, list[str]] = {}
    for kind, dims, _ in robustness.KINDS:
        out.setdefault((kind if kind in robustness.SEEDED else None, tuple(c for c, d in LOOKED_AT.items() if d in dims)), []).append(kind)
    return [(*key, kinds) for key, kinds in out.items()]


def _draws(kind: str | None, source: Column) -> Column:
    """The draws of a case as far as they count: any draw of the same side or place makes the same text."""
    if kind is None:
        return F.expr("cast(null as array<double>)")
    seed = F.col(f"_seed_{kind}")
    if kind == "critical_invent":
        return F.array((F.floor(robustness.draw_seeded(seed, F.lit(1)) * PLACES) + 0.5) / PLACES)
    side = lambda _, i: F.when(robustness.draw_seeded(seed, i + 1) < 0.5, 0.25).otherwise(0.75)
    return F.transform(F.regexp_extract_all(source, F.lit(robustness.SCRAMBLED), 1), side)


def _source() -> Column:
    return F.coalesce(F.nullif("reference", F.lit("")), F.col("findings"))


def alike(cases: DataFrame) -> DataFrame:
    """cases that agree in what an ask looks at, once: their columns but case_id and html, with rich, ask, draws and their number n. A case without an id has no report."""
    own = [c for c in cases.columns if c not in ("case_id", "html")]
    kept = [c for c in own if c not in LOOKED_AT]
    rows = with_defaults(cases.where(F.col("case_id").isNotNull()).select("case_id", *own, F.struct(*own).alias("_own")))
    rows = rows.withColumns({f"_seed_{k}": robustness.seeds(F.concat(F.col("case_id").cast("string"), F.lit(f"::{k}"))) for k in robustness.SEEDED})
    types = {f.name: f.dataType for f in cases.schema.fields}
    made = []
    for i, (seeded, looked, _) in enumerate(asks()):
        shown = (F.col("_own")[c] if c in looked else F.lit(None).cast(types[c]) for c in own if c in LOOKED_AT)
        made.append(F.struct(F.lit(i).alias("ask"), _draws(seeded, _source()).alias("draws"), *(x.alias(c) for c, x in zip((c for c in own if c in LOOKED_AT), shown, strict=True))))
    # What has no measurement has none to change.
    asked = F.filter(F.array(*made), lambda a: a["draws"].isNull() | (F.size(a["draws"]) > 0))
    flat = rows.select(*(F.col("_own")[c].alias(c) for c in kept), has_rich_gold().alias("rich"), F.explode(asked).alias("_a")).select(*kept, "rich", "_a.*")
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


def changed(groups: DataFrame, locales=LOCALES) -> DataFrame:
    """groups (see alike) with kind and html: each change that means something. locales: see robustness.matrix."""
    own = groups.columns
    full = with_defaults(groups.withColumn("_own", F.struct(*own))).withColumns({"_source": _source(), "_affirmed": F.transform(F.filter("gold", lambda g: ~F.coalesce(g["negated"], F.lit(False))), lambda g: g["finding"])})
    parts = []
    for lex in locales:
        rows = full.where(served([x.key for x in locales]) == lex.key)

        def one(kind: str, key=lex.key) -> Column:
            text = robustness.perturb(kind, F.col("_source"), key, F.col("urgent"), F.col("_affirmed"), draws=lambda i: F.get("draws", i))
            return let(text, robustness.row(kind, F.col("_source"), F.col("gold"), F.col("urgent")))

        listed = F.coalesce(*(F.when(F.col("ask") == i, F.filter(F.array(*map(one, kinds)), lambda r: r["applies"])) for i, (_, _, kinds) in enumerate(asks())))
        # The outer form, as the optimizer would else put a filter on the array's size, and all its changes, below it.
        parts.append(rows.select("_own", F.explode_outer(listed).alias("r")).where(F.col("r").isNotNull()).select("_own.*", "r.kind", F.col("r")["text"].alias("html")).drop("ask", "draws"))
    return reduce(DataFrame.union, parts)


# ---- What is noticed


def dimension(d: str) -> dict[str, Column]:
    """crit_, major_ and combined_ of one dimension, as submission.results has them without a judge: over structural, rich, and the score and checks of the dimension's evaluator."""
    own = F.filter("structural", lambda c: c["dim"] == d)
    n = lambda checks, keep: F.size(F.filter(checks, keep))
    failed = lambda severity: lambda c: ~c["passed"] & (c["severity"] == severity)
    counted = lambda checks: scoring.share(n(checks, lambda c: c["passed"]), F.size(checks), n(checks, failed("critical")), n(checks, failed("major")))
    plain = {"crit": n(own, failed("critical")), "major": n(own, failed("major")), "combined": counted(own)}
    if d not in EVALUATED:
        return {f"{k}_{d}": x for k, x in plain.items()}
    name = EVALUATED[d]
    told = F.col("rich") & (F.col(f"{name}_score") >= 0)
    ids = F.transform(f"{name}_checks", lambda c: c["id"])
    gates = F.filter(own, lambda c: (c["severity"] == "critical") & c["id"].rlike(GATES) & ~F.array_contains(ids, c["id"]))
    e = given(d, name)
    ruled = {"crit": e["crit"], "major": n(F.concat(gates, F.col(f"{name}_checks")), failed("major")), "combined": scoring.given(e)}
    return {f"{k}_{d}": F.when(told, ruled[k]).otherwise(plain[k]) for k in plain}


def hit(*dims: str) -> Column:
    """One of these dimensions notices the row's kind."""
    return F.coalesce(*(F.when(F.col("kind") == k, x) for k, x in robustness.caught(only=dims).items()), F.lit(False))


def _looks(d: str) -> Column:
    return F.col("kind").isin([k for k, dims, _ in robustness.KINDS if d in dims])


def _first(rows: DataFrame) -> DataFrame:
    """rows with what structural checks and retrieval notice (hit), and whether quality and urgent findings are still to be looked at. rows: with structural."""
    full = with_defaults(rows)
    some_gold, some_urgent, reference = F.size("gold") > 0, F.size("urgent") > 0, F.coalesce(F.col("reference"), F.lit("")) != ""
    # Without anything to compare with the evaluators fall back on the structural checks.
    of = lambda d: F.filter("structural", lambda c: c["dim"] == d)
    fallback = {f"{EVALUATED[d]}_{k}": x for d in ("QUAL", "CRIT") for k, x in (("checks", of(d)), ("score", evaluators.weighted_share(of(d), CHECK_WEIGHTS)))}
    to_do = {"QUAL": F.col("rich") & (some_gold | reference), "CRIT": F.col("rich") & (some_gold | some_urgent)}
    out = evaluators.retrieval(full).withColumns(fallback)
    out = out.withColumns({name: x for d in ("TERM", "RAG", "QUAL", "CRIT") for name, x in dimension(d).items()})
    here = hit("TERM", "RAG") | reduce(lambda a, b: a | b, (hit(d) & ~x for d, x in to_do.items()))
    return out.select(*rows.columns, here.alias("hit"), *((_looks(d) & x).alias(f"ask_{d}") for d, x in to_do.items()))


def _next(rows: DataFrame, d: str, evaluate, locales) -> DataFrame:
    own = rows.columns
    out = evaluate(with_defaults(rows.drop("hit")), locales=locales).withColumns(dimension(d))
    return stored(out.withColumn("hit", hit(d)).select(*own))


def rates(cases: DataFrame) -> DataFrame:
    """(kind, n, caught, rate): the changed reports of all cases, and how many are noticed by a dimension that should notice them."""
    groups = stored(alike(cases))
    # Expressions for a locale take seconds to make, so only the locales that occur have theirs.
    there = {r.key for r in groups.select(served([x.key for x in LOCALES]).alias("key")).distinct().collect()} if "locale" in groups.columns else {"en-US"}
    done = []
    for pack, rows in structured(changed(spread(groups), [x for x in LOCALES if x.key in there] or LOCALES), robustness.NOTICING):
        words, keep = (pack.words,), ["kind", "n", "hit"]
        first = stored(_first(rows))
        left = ~F.col("hit")
        second = _next(spread(first.where(left & F.col("ask_QUAL"))), "QUAL", evaluators.quality, words)
        third = _next(spread(first.where(left & ~F.col("ask_QUAL") & F.col("ask_CRIT")).unionByName(second.where(left & F.col("ask_CRIT")))), "CRIT", evaluators.critical, words)
        done += [first.where(~left | ~(F.col("ask_QUAL") | F.col("ask_CRIT"))).select(keep), second.where(~left | ~F.col("ask_CRIT")).select(keep), third.select(keep)]
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = reduce(DataFrame.union, done).groupBy("kind").agg(whole("n").alias("n"), whole(F.when(F.col("hit"), F.col("n"))).alias("caught"))
    return sums.withColumn("rate", to_fixed(F.col("caught").cast("double") / F.col("n") * 100.0, 2))
