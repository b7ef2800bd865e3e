"""Perturbed copies of texts, and how often checks notice them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clinical
from ..functions.clinical import let
from ..functions.lexicon import LOCALES
from ..functions.rounding import to_fixed
from ..functions.text import fold
from .agreement import draw_seeded
from .evaluators import served, with_defaults

# Kinds, dimensions that should notice, severity.
KINDS = [
    ("laterality_flip", ("RAG", "CRIT"), "critical"), ("negation_drop", ("QUAL", "CRIT"), "major"), ("negation_insert", ("QUAL", "CRIT"), "major"),
    ("measurement_scramble", ("RAG", "QUAL"), "major"), ("critical_drop", ("CRIT", "QUAL", "RAG"), "critical"), ("critical_invent", ("CRIT", "QUAL"), "critical"),
    ("terminology_corrupt", ("TERM", "QUAL"), "major"), ("structure_break", ("QUAL", "RAG"), "major"),
]
SEEDED = ("measurement_scramble", "critical_invent")
FLOOR = {"critical": 60.0, "major": 80.0, "minor": 90.0}
#: Dimensions that should notice some kind.
NOTICING = tuple(dict.fromkeys(d for _, dims, _ in KINDS for d in dims))


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(d), s, FLOOR[s]) for k, d, s in KINDS], "kind string, dims array<string>, severity string, floor double")


def caught(judge_dims: Column | None = None, only: tuple[str, ...] | None = None) -> dict[str, Column]:
    """For each kind: a check of its dimensions (only: of those of them) failed at its severity or above, the judge named one of them (judge_dims: array), or one scores under the floor. Rows of scoring.combine()."""
    out = {}
    for kind, dims, severity in KINDS:
        hit = F.lit(False)
        for d in (d for d in dims if only is None or d in only):
            failed = F.col(f"crit_{d}") > 0 if severity == "critical" else F.col(f"crit_{d}") + F.col(f"major_{d}") > 0
            hit = hit | failed | F.coalesce(F.col(f"combined_{d}") < FLOOR[severity], F.lit(False))
            if judge_dims is not None:
                hit = hit | F.coalesce(F.array_contains(judge_dims, d), F.lit(False))
        out[kind] = hit
    return out


def by_kind(results: DataFrame) -> DataFrame:
    """Samples, caught ones, rate (two decimals) of each kind. The eight kinds are unrolled: one pass, no join."""
    hits = caught()
    sums = results.agg(F.count("*").alias("n"), *(F.count_if(h).alias(k) for k, h in hits.items()))
    rows = sums.select("n", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("caught")) for k in hits))))
    return rows.select("kind", "n", "caught", to_fixed(F.col("caught").cast("double") / F.nullif(F.col("n"), F.lit(0)) * 100.0, 2).alias("rate"))


def verdict(rate: Column) -> Column:
    return F.when(rate >= 90, "robust").when(rate >= 70, "leaky").otherwise("broken")


# Cues that are dropped, in order; what a false denial says; words that say little; everyday words for terms.
CUES = {
    "pt-BR": (r"\bsem\s+", r"\bnão\s+há\s+", r"\bnão\s+", r"\bausência\s+de\s+", r"\bausente\s+", r"\bnegativ(?:o|a)\s+(?:para|de)\s+"),
    "en-US": (r"\bno\s+evidence\s+of\s+", r"\bno\s+", r"\babsence\s+of\s+", r"\babsent\s+", r"\bnegative\s+for\s+", r"\bwithout\s+"),
}
DENIAL = {"pt-BR": "não há ", "en-US": "no evidence of "}
LITTLE = "sinais sinal doenca doença associada associado formacao formação trajetos trajeto complexos complexo ativa ativo terminal canal evidence finding findings associated complex active".split()
TERMS = {
    "pt-BR": (
        (r"derrame\s+pleural", "água no pulmão"), ("edema", "inchaço"), ("hemorragia", "sangramento"), ("infarto", "ataque"), ("aneurisma", "bolinha"), ("metástase", "espalhamento"), ("calcificação", "endurecimento"),
        ("estenose", "aperto"), ("oclusão", "entupimento"), ("attenuação", "intensidade"), ("hipodens(?:o|a)", "escuro"), ("hiperdens(?:o|a)", "claro"), ("isodens(?:o|a)", "neutro"), ("hiperintens(?:o|a)", "forte"),
        ("hipointens(?:o|a)", "fraco"), ("contraste", "tinta"), (r"contraste\s+iv", "tinta na veia"), ("realce", "brilho"), ("nódulo", "bolinha"), ("massa", "caroço"), ("cisto", "bolha"), ("fibrose", "endurecimento"),
        ("perfusão", "circulação"), ("trombose", "coágulo grande"), ("pneumotórax", "ar entre o pulmão"), ("derivação", "tubinho"), (r"estrutura\s+vascular", "veias"), ("linfonodo", "íngua"), ("opacidade", "manchinha"),
        ("consolidação", "endurecimento do pulmão"), ("ensbroncopatia", "doença do pulmão"), (r"derrame\s+pericárdico", "água no coração"),
    ),
    "en-US": (
        (r"pleural\s+effusion", "water in lung"), ("edema", "swelling"), ("hemorrhage", "bleeding"), ("infarction", "attack"), ("aneurysm", "ball"), ("metastasis", "spread"), ("calcification", "hardening"),
        ("stenosis", "narrowing"), ("occlusion", "blockage"), ("attenuation", "intensity"), ("hypodense", "dark"), ("hyperdense", "bright"), ("isodense", "neutral"), ("hyperintense", "strong"),
        ("hypointense", "weak"), ("contrast", "dye"), ("enhancement", "shine"), ("nodule", "spot"), ("mass", "lump"), ("cyst", "blister"), ("fibrosis", "scarring"), ("perfusion", "circulation"),
        ("thrombosis", "big clot"), ("pneumothorax", "air around lung"), ("shunt", "tube"), (r"lymph\s+node", "gland"), ("opacity", "smudge"), ("consolidation", "lung hardening"),
        (r"pericardial\s+effusion", "fluid in heart"), ("ventriculomegaly", "big chambers"), ("bronchiectasis", "wide tubes"), ("atelectasis", "lung collapse"),
    ),
}
INVENTED = {
    "pt-BR": (
        "Identificada hemorragia subaracnoidea aguda em sulcos parietais bilaterais. ", "Detectada nova metástase hepática segmento VII medindo 32 mm. ", "Identificado tromboembolismo pulmonar agudo em ramos lobares direitos. ",
    ),
    "en-US": (
        "Acute subarachnoid hemorrhage identified in bilateral parietal sulci. ", "New hepatic metastasis identified in segment VII measuring 32 mm. ", "Acute pulmonary embolism identified in right lobar branches. ",
    ),
}
SCRAMBLED = r"(?i)(\d+(?:[.,]\d+)?)\s*(mm|cm|ml)"
#: Letters that stand for themselves with and without marks when a folded word is looked for in a text.
SPREAD = {"a": "[aáàâã]", "e": "[eéê]", "i": "[ií]", "o": "[oóôõ]", "u": "[uúü]", "c": "[cç]"}
ANY = "(?iu)"


def flip_laterality(x: Column, locale: str = "en-US") -> Column:
    """left and right change places, by way of a mark so that nothing flips twice."""
    pairs = {"en-US": (("right", "left"),), "pt-BR": (("direita", "esquerda"), ("direito", "esquerdo"))}[locale]
    for right, left in pairs:
        for a, b in ((rf"(?i)\b{right}\b", "\u0001"), (rf"(?i)\b{left}\b", right), ("\u0001", left)):
            x = F.regexp_replace(x, a, b)
    return x


def drop_negation(x: Column, locale: str = "en-US") -> Column:
    for cue in CUES[locale]:
        x = F.regexp_replace(x, ANY + cue, "")
    return x


def insert_negation(x: Column, locale: str = "en-US") -> Column:
    """After the first end of a sentence, or in front."""
    at = F.regexp_instr(x, F.lit(r"\.\s+[A-Za-z\u00c0-\u00fa]"))
    lead = F.char_length(F.regexp_extract(x, r"(\.\s+)[A-Za-z\u00c0-\u00fa]", 1))
    prefix = F.lit(DENIAL[locale])
    return F.when(at == 0, F.concat(prefix, x)).otherwise(F.concat(F.substring(x, F.lit(1), at - 1 + lead), prefix, F.substring(x, at + lead, F.char_length(x))))


def salient(label: Column) -> Column:
    """Folded words of five letters or more that say something."""
    return F.filter(F.split(fold(label), r"\s+"), lambda t: (F.char_length(t) >= 5) & ~clinical.one_of(t, LITTLE))


def _spread(word: Column) -> Column:
    """A pattern that finds a folded word in a text with marks, as a whole word."""
    escaped = F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # Letter by letter, so that letters inside the classes aren't replaced again.
    parts = F.transform(F.split(escaped, ""), lambda ch: F.coalesce(F.create_map(*(F.lit(y) for kv in SPREAD.items() for y in kv))[ch], ch))
    return F.concat(F.lit(r"(?iu)\b"), F.regexp_replace(F.array_join(parts, ""), r"\s+", r"\\s+"), F.lit(r"\b"))


def deny_target(x: Column, labels: Column, locale: str = "en-US") -> Column:
    """A denial at the start of the sentence that names the first label found in the text; without one, insert_negation."""

    def word_of(label: Column, folded: Column) -> Column:
        def of(words: Column) -> Column:
            phrase = F.array_join(F.slice(words, 1, 3), " ")
            return F.when((phrase != "") & F.contains(folded, phrase), phrase).otherwise(F.get(F.filter(words, lambda t: F.contains(folded, t)), F.lit(0)))

        return let(salient(label), of)

    word = let(fold(x), lambda f: F.get(F.filter(F.transform(labels, lambda label: word_of(label, f)), lambda w: w.isNotNull()), F.lit(0)))

    def put(at: Column) -> Column:
        before = F.substring(x, F.lit(1), at - 1)
        denied = fold(F.substring(before, F.greatest(at - 30, F.lit(1)), F.lit(30))).rlike(r"(?i)\b(sem|nao ha|no evidence of|no|without)$")
        lead = F.char_length(F.regexp_extract(before, r"(?is)^(.*(?:<br\s*/?>|[.!?]))", 1))
        space = F.char_length(F.regexp_extract(F.substring(x, lead + 1, F.char_length(x)), r"^(\s*)", 1))
        return F.when(denied, x).otherwise(F.concat(F.substring(x, F.lit(1), lead + space), F.lit(DENIAL[locale]), F.substring(x, lead + space + 1, F.char_length(x))))

    found = let(word, lambda w: F.when(w.isNotNull(), F.regexp_instr(x, _spread(w))).otherwise(0))
    return let(found, lambda at: F.when(at > 0, put(at)).otherwise(insert_negation(x, locale)))


def drop_critical(x: Column, labels: Column) -> Column:
    """Without the lines that name a label's words, and without these words elsewhere."""

    def without(text: Column, label: Column) -> Column:
        own = let(salient(label), lambda s: F.when(F.size(s) > 0, s).otherwise(F.filter(F.split(fold(label), r"\s+"), lambda t: F.char_length(t) > 3)))

        def of(words: Column) -> Column:
            # Segments with their break behind them, so that the breaks stay when a segment goes.
            marked = F.regexp_replace(text, r"(?i)(<br\s*/?>)", "\u0001$1\u0001")
            kept = F.filter(F.split(marked, "\u0001"), lambda s: s.rlike(r"(?i)^<br\s*/?>$") | ~F.exists(words, lambda w: F.contains(fold(s), w)))
            joined = F.regexp_replace(F.array_join(kept, ""), r"(?i)(?:<br\s*/?>\s*){3,}", "<br><br>")
            return F.aggregate(words, joined, lambda acc, w: F.regexp_replace(acc, _spread(w), F.lit("")))

        return F.when(F.trim(label) == "", text).otherwise(let(own, lambda ws: F.when(F.size(ws) > 0, of(ws)).otherwise(text)))

    out = F.aggregate(labels, x, without)
    return F.when(F.size(labels) == 0, x).otherwise(F.trim(F.regexp_replace(out, r"\s{2,}", " ")))


def invent_critical(x: Column, first_draw: Column, locale: str = "en-US") -> Column:
    """A made-up urgent finding in front of the conclusion, else after the sentence in the middle."""
    pool = F.array(*map(F.lit, INVENTED[locale]))
    said = F.get(pool, F.floor(first_draw * len(INVENTED[locale])).cast("int"))
    head = F.regexp_instr(x, F.lit(r"(?iu)<br\s*/?>\s*<br\s*/?>\s*<b>\s*(Conclus[aã]o|Impress[aã]o|Conclusion|Impression)\s*</b>"))
    half = F.floor(F.char_length(x) / 2).cast("int")
    stop = F.call_function("locate", F.lit("."), x, half + 1)

    def put(at: Column) -> Column:
        return F.when(at <= 0, F.concat(x, F.lit(" "), said)).otherwise(F.concat(F.substring(x, F.lit(1), at), said, F.substring(x, at + 1, F.char_length(x))))

    return let(F.when(head > 0, head - 1).otherwise(stop), put)


def scramble_measurements(x: Column, draws) -> Column:
    """Each measurement times 0.3 or 4 (by its draw) plus 7, one decimal with a comma. draws: number of the measurement -> draw."""
    numbers, units = (F.regexp_extract_all(x, F.lit(SCRAMBLED), g) for g in (1, 2))
    rest = F.split(x, SCRAMBLED, -1)

    def changed(n: Column, unit: Column, i: Column) -> Column:
        value = F.replace(n, F.lit(","), F.lit(".")).cast("double") * F.when(draws(i) < 0.5, 0.3).otherwise(4.0) + 7
        return F.concat(F.replace(F.format_string("%.1f", to_fixed(value, 1)), F.lit("."), F.lit(",")), F.lit(" "), unit)

    def join(parts: Column) -> Column:
        made = F.transform(numbers, lambda n, i: F.concat(changed(n, F.get(units, i), i), F.get(parts, i + 1)))
        return F.concat(F.get(parts, F.lit(0)), F.array_join(made, ""))

    return let(rest, join)


def break_structure(x: Column) -> Column:
    steps = ((r"(?i)</?(?:center|b)>", ""), (r"(?i)<br\s*/?>", " "), (r"(?iu)\b(?:t[eé]cnica|achados|aspectos|conclus[aã]o|impress[aã]o|technique|findings|impression|conclusion):", ""), (r"\s{2,}", " "))
    for a, b in steps:
        x = F.regexp_replace(x, a, b)
    return F.trim(x)


def corrupt_terms(x: Column, locale: str = "en-US") -> Column:
    """Terms replaced by everyday words, one after the other."""
    for a, b in TERMS[locale]:
        x = F.regexp_replace(x, rf"{ANY}\b{a}\b", b)
    return x


@F.pandas_udf(T.LongType())
def seeds(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else seed(t))


def seed(text: str) -> int:
    """FNV-1a over UTF-16 code units, 32 bits."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def perturb(kind: str, x: Column, locale: str = "en-US", urgent: Column | None = None, affirmed: Column | None = None, seeded: Column | None = None, draws=None) -> Column:
    """The text x changed in the way that kind names. urgent, affirmed: arrays of labels; seeded: the seed of the case and kind, or draws: number of the draw -> draw."""
    none = F.expr("cast(array() as array<string>)")
    urgent, affirmed = (none if c is None else c for c in (urgent, affirmed))
    draws = draws or (lambda i: draw_seeded(F.lit(1).cast("long") if seeded is None else seeded, i + 1))
    made = {
        "laterality_flip": lambda: flip_laterality(x, locale), "negation_drop": lambda: drop_negation(x, locale), "negation_insert": lambda: deny_target(x, F.concat(urgent, affirmed), locale),
        "measurement_scramble": lambda: scramble_measurements(x, draws), "critical_drop": lambda: drop_critical(x, urgent), "critical_invent": lambda: invent_critical(x, draws(F.lit(0)), locale),
        "terminology_corrupt": lambda: corrupt_terms(x, locale), "structure_break": lambda: break_structure(x),
    }
    return made[kind]()


def applicable(kind: str, source: Column, changed: Column, gold: Column, urgent: Column) -> Column:
    """The change means something for the case."""
    has_negated = F.exists(gold, lambda g: F.coalesce(g["negated"], F.lit(False)))
    has_affirmed = F.exists(gold, lambda g: ~F.coalesce(g["negated"], F.lit(False)))
    sided = F.exists(gold, lambda g: g["laterality"].isNotNull()) | F.exists(F.concat(urgent, F.transform(gold, lambda g: g["finding"])), lambda x: x.rlike(r"(?i)\b(?:direit[ao]|esquerd[ao]|right|left)\b"))
    when = {
        "critical_drop": F.size(urgent) > 0, "laterality_flip": sided, "measurement_scramble": source.rlike(r"(?i)\d+(?:[.,]\d+)?\s*(?:mm|cm|ml)\b"), "negation_drop": has_negated,
        "negation_insert": has_affirmed | (F.size(urgent) > 0),
    }
    return (source != changed) & when.get(kind, F.lit(True))


def matrix(cases: DataFrame, only: tuple[str, ...] | None = None, applicable_only: bool = False, locales=LOCALES) -> DataFrame:
    """(case_id, kind, prediction_id, text): each case's reference report (or findings) changed in each way. The kinds are unrolled: one pass, no join.

    locales: those that occur, where they are known; a case of another one is an error."""
    names = [k for k, _, _ in KINDS if only is None or k in only]
    full = with_defaults(cases).withColumn("_source", F.coalesce(F.nullif("reference", F.lit("")), F.col("findings")))
    id_text = F.col("case_id").cast("string")
    parts = []
    for lex in locales:
        rows = full.where(served([x.key for x in locales]) == lex.key).withColumns({"_affirmed": F.transform(F.filter("gold", lambda g: ~F.coalesce(g["negated"], F.lit(False))), lambda g: g["finding"])})
        rows = rows.withColumns({f"_seed_{k}": seeds(F.concat(id_text, F.lit(f"::{k}"))) for k in names if k in SEEDED})
        made = []
        for k in names:
            seeded = F.col(f"_seed_{k}") if f"_seed_{k}" in rows.columns else None
            text = perturb(k, F.col("_source"), lex.key, F.col("urgent"), F.col("_affirmed"), seeded)
            one = let(text, row(k, F.col("_source"), F.col("gold"), F.col("urgent")))
            made.append(one)
        listed = F.filter(F.array(*made), lambda r: r["applies"]) if applicable_only else F.array(*made)
        # The outer form, as the optimizer would else put a filter on the array's size, and all its changes, below it.
        parts.append(rows.select("case_id", F.explode_outer(listed).alias("r")).where(F.col("r").isNotNull()).select("case_id", "r.kind", id_text.alias("prediction_id"), "r.text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def row(kind: str, source: Column, gold: Column, urgent: Column):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), applicable(kind, source, t, gold, urgent).alias("applies"))


def summarize_links(results: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, n, caught, rate) over the links whose prediction has a result. results: case_id and the columns of scoring.combine(); links: kind, prediction_id."""
    hits = caught()
    flags = results.select(F.col("case_id").cast("string").alias("prediction_id"), F.create_map(*(x for k, h in hits.items() for x in (F.lit(k), h))).alias("hits"))
    joined = links.select("kind", F.col("prediction_id").cast("string")).join(flags, "prediction_id")
    sums = joined.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("hits")[F.col("kind")]).alias("caught"))
    return sums.withColumn("rate", to_fixed(F.col("caught").cast("double") / F.col("n") * 100.0, 2))


def overall(per_kind: DataFrame) -> DataFrame:
    """(n, caught, rate, verdict) over all kinds; no samples rate 0."""
    sums = per_kind.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("caught"), F.lit(0)).alias("caught"))
    rated = sums.withColumn("rate", F.when(F.col("n") > 0, to_fixed(F.try_divide(F.col("caught").cast("double"), F.col("n")) * 100.0, 2)).otherwise(0.0))
    return rated.withColumn("verdict", verdict(F.col("rate")))


# ---- Graduated controls: reports made worse step by step

# The levels, and what stands where nothing is known.
LEVELS = {"l1": "measure-perturbation", "l2": "laterality-perturbation", "l3": "noncritical-omission", "l4": "critical-omission", "l5": "null-baseline"}
NULL_REPORT = "Relatorio preliminar sem padrao. Nao ha alteracoes agudas. Sem lesao suspeita, hemorragia, fratura, obstrucao ou embolia. Recomenda-se controle de rotina sem evidencia fornecida."
NO_GOLD = "Sem achados relevantes extraídos do gold público."
NO_FINDING = "Sem achado principal descrito."
FIRST_MEASURE = r"(?isu)^(.*?)(\d+(?:[,.]\d+)?)(\s*(?:cm|mm|ml|centimetros?|centímetros?|milimetros?|milímetros?))(.*)$"
SIDES = (("direita", "esquerda"), ("esquerda", "direita"), ("direito", "esquerdo"), ("esquerdo", "direito"), ("right", "left"), ("left", "right"))
GOLD = "array<struct<finding:string,severity:string>>"


def change_first_measure(x: Column) -> Column:
    """The first measurement one larger, from 10 on five larger; one decimal, with the sign it had."""
    part = lambda k: F.regexp_extract(x, FIRST_MEASURE, k)

    def put(raw: Column) -> Column:
        value = F.replace(raw, F.lit(","), F.lit(".")).cast("double")
        text = F.format_string("%.1f", to_fixed(F.when(value >= 10, value + 5).otherwise(value + 1), 1))
        shown = F.when(F.contains(raw, F.lit(",")), F.replace(text, F.lit("."), F.lit(","))).otherwise(text)
        return F.when(raw == "", x).otherwise(F.concat(part(1), shown, part(3), part(4)))

    return let(part(2), put)


def change_first_side(x: Column) -> Column:
    """The first of the words for sides, in a fixed order, that the text has: its first place changes."""
    made = F
    for a, b in SIDES:
        made = made.when(x.rlike(rf"(?i)\b{a}\b"), F.regexp_replace(x, rf"(?is)^(.*?)\b{a}\b", f"$1{b}"))
    return made.otherwise(x)


def without_finding(x: Column, finding: Column, times: int = 4) -> Column:
    """Without the segments that share most words of four letters with a finding: two words (or all it has) at least, `times` segments at most."""
    words = lambda t: F.filter(F.split(fold(t), "[^a-z0-9]+"), lambda w: F.char_length(w) >= 4)

    def cut(parts: Column, target: Column) -> Column:
        top = clinical.best(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: F.size(F.filter(words(s["p"]), lambda w: F.array_contains(target, w))))
        keep = lambda t: F.when(t["worth"] >= F.least(F.lit(2), F.size(target)), F.filter(parts, lambda p, i: i != t["item"]["i"])).otherwise(parts)
        return let(top, lambda t: F.coalesce(keep(t), parts))

    def of(target: Column) -> Column:
        marked = F.regexp_replace(x, r"(?i)(<br\s*/?>|[.。])", "\u0001$1\u0001")
        left = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.split(marked, "\u0001"), lambda parts, _: cut(parts, target))
        return F.when(F.size(target) == 0, x).otherwise(F.regexp_replace(F.array_join(left, ""), r"(?i)(?:<br\s*/?>\s*){3,}", "<br><br>"))

    return let(F.array_distinct(words(finding)), of)


def _first_where(items: Column, test) -> Column:
    return F.array_position(F.transform(items, test), True).cast("int")


def _omitted(gold: Column, level: str) -> Column:
    """Place (from 1) of the finding that the level leaves out, 0 for none."""
    if level == "l3":
        return _first_where(gold, lambda g: ~g["severity"].eqNullSafe(F.lit("critical")))
    rank = lambda g: F.when(g["severity"] == "critical", 3).when(g["severity"] == "major", 2).when(g["severity"] == "minor", 1).otherwise(0)
    ranks = F.transform(gold, rank)
    return let(ranks, lambda r: F.when(F.size(r) > 0, F.array_position(r, F.array_max(r)).cast("int")).otherwise(0))


def control(level: str, exam: Column, gold: Column, reference: Column) -> Column:
    """The report of one level of control for a case."""
    if level == "l5":
        return F.lit(NULL_REPORT)
    own = F.transform(gold, lambda g: F.struct(g["finding"].alias("finding"), g["severity"].alias("severity")))
    report = change_first_measure(reference)
    report = report if level == "l1" else let(report, change_first_side)
    if level in ("l3", "l4"):
        gone = let(_omitted(own, level), lambda at: F.when(at > 0, F.get(own, at - 1)["finding"]))
        report = let(report, lambda r: let(gone, lambda g: F.when(g.isNull(), r).otherwise(without_finding(r, g))))
    stand_in = F.array(F.struct(F.lit(NO_GOLD).alias("finding"), F.lit("minor").alias("severity"))).cast(GOLD)
    listed = F.when(F.size(own) > 0, own.cast(GOLD)).otherwise(stand_in)

    def changed_once(items: Column, change) -> Column:
        texts = F.transform(items, lambda f: let(f, lambda t: F.struct(t.alias("old"), change(t).alias("new"))))
        return let(texts, lambda ts: let(_first_where(ts, lambda t: t["old"] != t["new"]), lambda at: F.transform(ts, lambda t, i: F.when(i == at - 1, t["new"]).otherwise(t["old"]))))

    def rendered(items: Column) -> Column:
        if level in ("l3", "l4"):
            kept = let(_omitted(items, level), lambda at: F.filter(items, lambda g, i: i != at - 1))
            found = F.transform(kept, lambda g: g["finding"])
        else:
            found = changed_once(F.transform(items, lambda g: g["finding"]), change_first_measure)
            found = changed_once(found, change_first_side) if level == "l2" else found
        return let(F.filter(F.transform(found, lambda f: F.trim(F.coalesce(f, F.lit("")))), lambda f: f != ""), page)

    def page(found: Column) -> Column:
        escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        head = F.coalesce(F.nullif(F.trim(F.get(F.split(F.coalesce(exam, F.lit("Exame")), r"\."), F.lit(0))), F.lit("")), F.lit("Exame"))
        body = F.when(F.size(found) > 0, F.array_join(found, ". ")).otherwise(NO_FINDING)
        end = F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(NO_FINDING)
        return F.concat(F.lit("<center><b>"), escape(head), F.lit("</b></center><br><br><b>Achados</b><br>"), escape(body), F.lit("<br><br><b>Conclusao</b><br>"), escape(end))

    return F.when(F.coalesce(reference, F.lit("")) != "", report).otherwise(let(listed, rendered))


def controls(cases: DataFrame) -> DataFrame:
    """(case_id, level, model, text): predictions of all levels for all cases."""
    full = with_defaults(cases)
    made = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(f"graduated-control-{k}-{name}").alias("model"), control(k, F.col("exam"), F.col("gold"), F.col("reference")).alias("text")) for k, name in LEVELS.items()))
    return full.select("case_id", F.inline(made))
