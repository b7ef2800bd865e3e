"""Structural checks of a report against its case, as one array of conditional structs: a check that doesn't apply isn't emitted.

Rows: html, findings, exam (or modality, region, contrast, abnormal, see exam_meta). Everything a check needs is derived
once as a column; all checks are expressions on one row.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical, text
from ..functions.clinical import any_case, let
from ..functions.lexicon import ENGLISH as ENGLISH_WORDS
from ..functions.lexicon import NEVER, PORTUGUESE as PORTUGUESE_WORDS
from ..functions.lexicon import Lexicon
from .evaluators import CHECK, check
from .scoring import DIMS


def unmarked(x: Column) -> Column:
    """Letters without marks, all else as it stands."""
    return F.regexp_replace(F.translate(x, "".join(text.MARKED), "".join(text.PLAIN)), f"[{text.COMBINING}]", "")


def _unmarked(pattern: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", pattern) if not 0x300 <= ord(c) <= 0x36F)


@dataclass(frozen=True)
class Pack:
    """Words and patterns of one locale for the structural checks."""

    words: Lexicon
    analysis: str
    conclusion: str
    technique: str
    title_abbreviations: str
    forbidden: tuple[tuple[str, str], ...]
    openers: tuple[str, ...]
    contrast: str
    umbrella: str
    banned: tuple[str, ...]
    normal: str
    vocabulary: dict[str, tuple[str, str]]
    title_words: dict[str, tuple[str, ...]]
    region_words: dict[str, tuple[str, ...]]
    regions: tuple[tuple[str, str], ...]
    coverage: dict[str, tuple[str, ...]]
    preserved: tuple[tuple[str, str, str], ...]
    """(label, pattern in the findings, pattern in the report)"""


# The English pack.
ENGLISH = Pack(
    words=ENGLISH_WORDS, analysis="Findings|Analysis", conclusion="Impression|Conclusion", technique="Technique", title_abbreviations=r"^CT\s|^MRI?\s|^US\s|^XR\s",
    forbidden=(
        (r"\bno evidence of\b", "no evidence of→absent/no"), (r"\bfluid\b", "fluid→collection/effusion when specific"), (r"\blesion\b", "lesion→use more specific term when possible"),
        (r"\bappears to\b", "appears to→state directly"), (r"\bcannot be excluded\b", "cannot be excluded→state uncertainty more explicitly"),
    ),
    openers=("There is", "There are", "The patient has", "This is a"),
    contrast=r"\benhancement\b|\bwash[\s-]?out\b|\barterial\s+phase\b|\bportal\s+phase\b|\bdelayed\s+phase\b|\bhyperenhanc",
    umbrella=r"remaining\s+structures|otherwise\s+(?:un)?remarkable|no\s+other\s+(?:significant\s+)?findings", banned=("no other significant findings",),
    normal=r"^normal$|^no\s+acute\s+abnormality|^unremarkable$",
    vocabulary={
        "US": ("Ultrasound uses correct modality vocabulary", r"\battenuation\b|\bdensity\b|\bsignal\s+intensity\b|\benhancement\b"),
        "MRI": ("MRI uses correct modality vocabulary", r"\bechogenicity\b|\bhypoechoic\b|\banechoic\b|\bechogenic\b"), "CT": ("signal intensity→attenuation", r"\bsignal\s+intensity\b"),
    },
    title_words={"CT": ("computed tomography|ct angiography|cta|ct",), "MRI": ("magnetic resonance|mri|mr ",), "US": ("ultrasound|sonogra|doppler",), "XR": ("radiograph|x-ray|xray",), "MG": ("mammography|mammogram",), "MX": ("mammography|mammogram",)},
    region_words={
        "head": ("head", "brain", "cranial"), "chest": ("chest", "thorax"), "abdomen": ("abdomen", "abdominal"), "spine": ("spine", "lumbar", "cervical", "thoracic"), "urinary": ("urinary", "urogra", "urinary tract"),
        "pelvis": ("pelvis", "pelvic"), "breast": ("breast", "mammogra"), "thyroid": ("thyroid",), "neck": ("neck", "cervical"),
    },
    regions=(("thyroid", "thyroid"), ("breast", "breast|mammo"), ("urinary", "urinary|uro|urolog"), ("pelvis", "pelv"), ("head", "head|brain|cranial"), ("chest", "chest|thorax|lung"), ("abdomen", "abd"), ("spine", "spine|lumbar|cervical|thoracic"), ("neck", "neck")),
    coverage={
        "CT:head": ("ventricl", "sulci", "cistern", "parenchym", "calvari", "posterior fossa", "midline", "orbit", "paranasal sinus"),
        "CT:chest": ("pulmon", "trache", "mediast", "lymph", "pleura", "heart", "pericardi", "aorta", "esophag"),
        "CT:abdomen": ("liver", "gallbladder", "bile duct", "pancreas", "spleen", "adrenal", "kidney", "bowel", "aorta", "lymph"),
        "CT:pelvis": ("bladder", "rectum", "lymph", "bone", "musculature", "fat"), "CT:urinary": ("kidney", "ureter", "bladder"), "CT:spine": ("alignment", "vertebra", "canal", "soft tissue"),
        "MRI:head": ("ventricl", "sulci", "parenchym", "signal", "diffusion", "posterior fossa", "midline"), "MRI:abdomen": ("liver", "bile duct", "pancreas", "spleen", "kidney", "adrenal"),
        "MRI:spine": ("alignment", "vertebra", "disc", "canal", "cord", "foramen"), "MRI:pelvis": ("bladder", "rectum", "mesorect", "lymph", "musculature"),
        "US:abdomen": ("liver", "gallbladder", "bile duct", "pancreas", "spleen", "kidney", "aorta"), "US:pelvis": ("bladder", "endometri", "cul-de-sac"), "US:urinary": ("kidney", "bladder"),
        "US:thyroid": ("right lobe", "left lobe", "isthmus", "nodule"), "US:breast": ("nodule", "skin", "axilla"), "MG:breast": ("nodule", "skin", "axilla"), "MX:breast": ("nodule", "skin", "axilla"),
        "XR:chest": ("cardiac", "mediast", "hila", "parenchym", "costophrenic", "soft tissue"),
    },
    preserved=(
        ("steatosis", "steatosis|fatty liver", "steatosis|fatty liver"), ("gallstone", "gallstone|cholelith", "gallstone|cholelith"), ("biliary sludge", "biliary sludge", "biliary sludge"),
        ("renal cyst", "renal cyst|kidney cyst", "renal cyst|kidney cyst"), ("pleural effusion", "pleural effusion", "pleural effusion"), ("CVC", r"\bCVC\b|central venous catheter", r"\bCVC\b|central venous catheter"),
        ("disc herniation", "disc herniation|herniated disc", "disc herniation|herniated disc"), ("foraminal stenosis", "foraminal stenosis", "foraminal stenosis"), ("subdural hematoma", "subdural hematoma", "subdural hematoma"),
        ("hydronephrosis", "hydronephrosis", "hydronephrosis"), ("umbilical hernia", "umbilical hernia", "umbilical hernia"), ("calculus", "calculus|stone", "calculus|stone"),
        ("normality", "^normal$", "no acute abnormality|unremarkable|within normal limits"),
    ),
)

# The Portuguese pack.
PORTUGUESE = Pack(
    words=PORTUGUESE_WORDS, analysis="An[áa]lise|Achados", conclusion="Conclus[ãa]o|Impress[ãa]o", technique="T[ée]cnica", title_abbreviations=r"^TC\s|^RM\s|^US\s|^USG\s|^RX\s",
    forbidden=(
        (r"\bcolônic[oa]\b", "colônico→cólico"), (r"\bpatente\b", "patente→pérvia"), (r"\blinfadenopatia\b", "linfadenopatia→linfonodomegalia"), (r"(?:não há|sem)\s+evidências?\s+de", "sem evidência de→Ausência de"),
        (r"por\s+(?:conta|causa)\s+de", "por conta de→decorrente de"), (r"\bao\s+menos\b", "ao menos→pelo menos"), (r"\bespessação\b", "espessação→espessamento"), (r"\badelgaçamento\b", "adelgaçamento→afilamento"),
        (r"\bfluido\b", "fluido→líquido"), (r"\bnodulação\b", "nodulação→nódulo"), (r"processo\s+col[ií]tico", "processo colítico→colite"), (r"aumentad[oa]\s+de\s+dimensões", "aumentado de dimensões→com dimensões aumentadas"),
        (NEVER, "intravenoso→endovenoso"), (r"estriações?\s+(?:de|da|na)\s+gordura", "estriações gordura→densificação gordura"),
    ),
    openers=("Presença de", "Observa-se", "Nota-se", "Identifica-se", "Evidencia-se", "Visualiza-se", "Detecta-se", "Constata-se", "Demonstra-se"),
    contrast=r"\brealce\b|\bimpregnação\b|\bcontrastação\b|\bcontrastacao\b|\bwash[\s-]?out\b|\bfase\s+(?:arterial|portal|tardia|venosa)\b|\bcaptação\s+(?:de|do|pelo)\s+contraste\b",
    umbrella=r"demais\s+estruturas|outras\s+alterações\s+avaliáveis|sem\s+outros?\s+achados", banned=("ausência de outras alterações avaliáveis",),
    normal=r"^normal$|^sem\s+alterações|^sem\s+achados|^dentro\s+da\s+normalidade",
    vocabulary={
        "US": ("Ultrasound uses correct modality vocabulary", r"\bdensidade\b|\bhipersinal\b"), "MRI": ("MRI uses correct modality vocabulary", r"\becogenicidade\b|\bhipoecoic[oa]s?\b|\banecoic[oa]s?\b"), "CT": ("", NEVER),
    },
    title_words={"CT": ("tomografia|angiotomografia|angio-tc|tc",), "MRI": ("ressonancia|rm",), "US": ("ultrassonografia|ultrassom|usg|ecografia|doppler",), "XR": ("radiografia|defecografia|cinedefecograma|raio x|raios x|raio-x|rx",), "MG": ("mamografia",), "MX": ("mamografia",)},
    region_words={
        "head": ("cranio", "encefalo", "intracrani"), "chest": ("torax",), "abdomen": ("abdome", "abdominal"), "spine": ("coluna", "lombar", "cervical", "toracica"), "urinary": ("vias urinarias", "uro", "urinario"),
        "pelvis": ("pelve", "pelv"), "breast": ("mama", "mamografia"), "thyroid": ("tireoide",), "neck": ("pescoco", "cervical"),
    },
    regions=(("thyroid", "tireoid"), ("breast", "mama|mamograf"), ("urinary", r"vias\s+urin|uro|urinari"), ("pelvis", "pelv"), ("head", "crani|encefal|cerebr|cabeca"), ("spine", "coluna|lombar|cervical"), ("chest", "torax|torac|pulm"), ("abdomen", "abd"), ("neck", "pescoco")),
    coverage={
        "CT:head": ("ventricul", "sulcos", "cisternas", "parenquima", "calota", "fossa posterior", "linha media", "orbit", "seios paranasal"),
        "CT:chest": ("pulmon", "traque", "mediast", "linfonod", "pleura", "coracao", "pericard", "aorta", "esofago"),
        "CT:abdomen": ("figado", "vesicula", "vias biliares", "pancreas", "baco", "adren", "rins", "alcas", "aorta", "linfonod"),
        "CT:pelvis": ("bexiga", "reto", "linfonod", "osso", "musculatura", "gordura"), "CT:urinary": ("rins", "ureter", "bexiga"), "CT:spine": ("alinhamento", "vertebra", "canal", "partes moles"),
        "MRI:head": ("ventricul", "sulcos", "parenquima", "sinal", "difusao", "fossa posterior", "linha media"), "MRI:abdomen": ("figado", "vias biliares", "pancreas", "baco", "rins", "adren"),
        "MRI:spine": ("alinhamento", "vertebra", "disco", "canal", "medula", "forame"), "MRI:pelvis": ("bexiga", "reto", "mesoreto", "linfonod", "musculatura"),
        "US:abdomen": ("figado", "vesicula", "vias biliares", "pancreas", "baco", "rins", "aorta"), "US:pelvis": ("bexiga", "endometrio", "douglas"), "US:urinary": ("rins", "bexiga"),
        "US:thyroid": ("lobo direito", "lobo esquerdo", "istmo", "nodulo"), "US:breast": ("nodulo", "pele", "axilar"), "MG:breast": ("nodulo", "pele", "axilar"), "MX:breast": ("nodulo", "pele", "axilar"),
        "XR:chest": ("area cardiac", "mediast", "hilos", "parenquima", "seios costofren", "partes moles"),
    },
    preserved=(
        ("esteatose", "esteatose", "esteatose"), ("cálculo vesicular", r"c[aá]lculo\s+(?:na\s+)?ves[ií]cula|colecistolit", r"c[aá]lculo\s+(?:na\s+)?ves[ií]cula|colecistolit"), ("lama biliar", r"lama\s+biliar", r"lama\s+biliar"),
        ("cisto renal", r"cisto\s+renal", r"cisto\s+renal"), ("derrame pleural", r"derrame\s+pleural", r"derrame\s+pleural"), ("CVC", r"\bCVC\b|cateter\s+venoso\s+central", r"\bCVC\b|cateter\s+venoso\s+central"),
        ("hérnia discal", r"h[eé]rnia\s+discal", r"h[eé]rnia\s+discal"), ("estenose foraminal", r"estenose\s+foraminal", r"estenose\s+foraminal"), ("hematoma subdural", r"hematoma\s+subdural", r"hematoma\s+subdural"),
        ("hidronefrose", "hidronefrose", "hidronefrose"), ("hérnia umbilical", r"h[eé]rnia\s+umbilical", r"h[eé]rnia\s+umbilical"), ("cálculo", "c[aá]lculo", "c[aá]lculo"),
        ("normalidade", "^normal$", r"sem\s+alteracoes|sem\s+alterações|dentro\s+dos\s+limites|sem\s+achados"),
    ),
)
PACKS = {p.words.key: p for p in (ENGLISH, PORTUGUESE)}

# Patterns that hold for both locales.
HEDGES = "a esclarecer|nao se pode excluir|nao e possivel excluir|a depender de|a criterio|correlacionar? clinica|nao podemos afastar|sugerir? complementac|avaliar? possibilidade|convem correlacionar"
FILLER = "demais estruturas sem alterac|demais orgaos sem|restante do exame sem alterac|nada mais digno de nota"
NOUNS = r"\b(?:hematoma|nodulo|cisto|massa|lesao|derrame|consolidacao|hernia|estenose|calcul|fratura|pneumotorax|atelectasia|efusao|luxacao|adenopatia|linfonodomegalia|hidronefrose|nefrolitiase|hemorrhage|nodule|cyst|mass|lesion|effusion|consolidation|stenosis|calculus|fracture|collection|abscess|disc|tumor)\b"
HEADINGS = r"(?iu)\b(?:T[ée]cnica|An[áa]lise|Achados|Conclus[ãa]o|Impress[ãa]o|Technique|Findings|Analysis|Impression|Conclusion)\s*:?"
MODALITIES = (
    ("MRI", r"\b(?:rm|mri|ressonancia|magnetic resonance)\b"),
    ("US", r"\b(?:us|usg|ultra|ultrassom|ultrassonografia|ultrassonografico|ecografia|ecodoppler|doppler|ultrasound|ultrasonography|sonography|sonogram)\b"),
    ("XR", r"\b(?:rx|x-ray|xray|radiograph|radiographs|radiography|radiografia|radiografias)\b|\braios?[\s-]?x\b"),
    ("MX", r"\b(?:mamografia digital|digital mammography|mx)\b"), ("MG", r"\b(?:mamografia|mammography|mammogram|mg)\b"),
)
CONTRAST_EXAM = r"\b(?:cc|c/c|com contraste|contrastado|with contrast|contrast-enhanced|contrast enhanced)\b"
CONTRAST_CUE = r"\b(?:meio de contraste|contraste (?:administrad\w*|endovenos\w*|injetad\w*)|pos[\s-]?contraste|post[\s-]?contrast|intravenous contrast|gadol[ií]nio|gadolineo|fase arterial|fase (?:porto[\s-]?)?venosa|fase portal|fase tardia|arterial phase|portal[\s-]?venous phase|portal phase|venous phase|delayed phase|washout|wash[\s-]out)\b"
CONTRAST_DOUBT = r"\b(?:realce|impregnacao|contrastacao|enhancement|enhancing|hyperenhanc\w*)\b"
CONTRAST_DENIED = r"\b(?:sem|ausencia de|nao (?:ha|apresenta|demonstra|se observa)|no|without|absent|negative for)\b[^.;]{0,24}\b(?:realce|impregnacao|contrastacao|enhancement|enhancing)\b"


def exam_meta(exam: Column, findings: Column, pack: Pack = ENGLISH) -> dict[str, Column]:
    """modality, region, contrast and abnormal of a case, by ordered rules."""

    def first(pairs, otherwise: str):
        return lambda e: F.coalesce(*(F.when(e.rlike(p), n) for n, p in pairs), F.lit(otherwise))

    def contrast(f: Column) -> Column:
        return f.rlike(CONTRAST_CUE) | (f.rlike(CONTRAST_DOUBT) & ~f.rlike(CONTRAST_DENIED))

    e, f = text.fold(exam), text.fold(findings)
    return {
        "modality": let(e, first(MODALITIES, "CT")), "region": let(e, first(pack.regions, "unknown")), "contrast": e.rlike(CONTRAST_EXAM) | let(f, contrast),
        "abnormal": ~clinical.trim(findings).rlike(any_case(pack.normal)),
    }


def section(html: Column, labels: str) -> Column:
    """Markup after a bold label, up to the next section."""
    return F.regexp_extract(html, rf"(?iu)<b>(?:{labels})[^<]*</b>([\s\S]*?)(?:<br><br><b>|$)", 1)


def title(html: Column) -> Column:
    """The centred title, else what stands before the first heading if it is short."""
    centred = F.trim(F.regexp_extract(F.regexp_replace(html, r"(?i)^(?:\s|<br\s*/?>)*", ""), r"(?i)<center><b>([^<]+)</b></center>", 1))
    before = F.trim(F.get(F.split(F.trim(F.regexp_replace(clinical.lines(html), r"\s+", " ")), HEADINGS, 2), F.lit(0)))
    return F.when(centred != "", centred).otherwise(let(before, lambda b: F.when(F.char_length(b) <= 180, b).otherwise("")))


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def _side_pairs(findings: Column) -> Column:
    """(noun, side) pairs of the sentences of the findings; a noun without a side has a pair too."""

    def of(s: Column) -> Column:
        named = F.array_compact(F.array(F.lit("none"), F.when(s.rlike(r"\b(?:direit[ao]s?|right)\b"), F.lit("right")), F.when(s.rlike(r"\b(?:esquerd[ao]s?|left)\b"), F.lit("left")), F.when(s.rlike(r"\bbilateral\b"), F.lit("bilateral"))))
        nouns = F.regexp_extract_all(s, F.lit(NOUNS), 0)
        return let(named, lambda ds: F.flatten(F.transform(nouns, lambda n: F.transform(ds, lambda d: F.struct(n.alias("noun"), d.alias("side"))))))

    sentences = F.filter(F.transform(F.split(findings, r"[.\n]"), clinical.trim), lambda s: F.char_length(s) > 5)
    return F.array_distinct(F.flatten(F.transform(sentences, lambda s: let(text.fold(s), of))))


def swapped(pairs: Column, sentences: Column, lex: Lexicon) -> Column:
    """A noun that the findings put on one side only stands in a sentence on the other one only, and isn't denied there. sentences: folded."""
    nouns = F.array_distinct(F.transform(pairs, lambda p: p["noun"]))
    has = lambda n, d: F.exists(pairs, lambda p: (p["noun"] == n) & (p["side"] == d))
    one = F.transform(nouns, lambda n: F.struct(n.alias("noun"), F.when(has(n, "left") & ~has(n, "right") & ~has(n, "bilateral"), "left").when(has(n, "right") & ~has(n, "left") & ~has(n, "bilateral"), "right").alias("side")))

    def against(s: Column, n: Column) -> Column:
        right, left = s.rlike(r"\b(?:direit[ao]s?|right)\b"), s.rlike(r"\b(?:esquerd[ao]s?|left)\b")
        other = F.when(n["side"] == "left", right & ~left).when(n["side"] == "right", left & ~right).otherwise(F.lit(False))
        return F.contains(s, n["noun"]) & other & ~clinical.mention_denied(s, n["noun"], lex)

    return let(one, lambda ns: F.exists(sentences, lambda s: F.exists(ns, lambda n: against(s, n))))


def with_parts(reports: DataFrame, pack: Pack = ENGLISH) -> DataFrame:
    """reports with the sections and folded texts that the checks look at."""
    c = F.col
    out = reports.withColumns({"_analysis": section(c("html"), pack.analysis), "_conclusion": section(c("html"), pack.conclusion), "_title": title(c("html")), "_bare": unmarked(c("html")), "_stripped": text.strip_tags(c("html"))})
    out = out.withColumns({"_plain": text.fold(c("_stripped")), "_said": text.strip_tags(c("_conclusion")), "_in": text.fold(c("findings")), "_head": text.fold(c("_title")), "_pairs": _side_pairs(c("findings"))})
    found = [F.when(c("findings").rlike(any_case(p)), F.lit(n)) for n, p, _ in pack.preserved]
    lost = [F.when(c("findings").rlike(any_case(p)) & ~c("html").rlike(any_case(r)), F.lit(n)) for n, p, r in pack.preserved]
    lines_of = lambda x: F.transform(F.split(x, "<br>"), lambda s: clinical.trim(text.strip_tags(s)))
    pt, en = text.language_signals(c("_plain"))
    out = out.withColumns({
        "_expected": F.array_compact(F.array(*found)), "_lost": F.array_compact(F.array(*lost)), "_sentences": F.filter(F.transform(F.split("_said", r"[.\n]"), clinical.trim), lambda s: F.char_length(s) > 10),
        "_measures": F.array_distinct(F.transform(F.regexp_extract_all("findings", F.lit(f"(?i){text.MEASURE}"), 0), text.fold)), "_levels": text.levels(c("findings")), "_sides": text.laterality(c("_in")),
        "_pt": pt, "_en": en, "_folded_said": text.fold(c("_said")), "_long": F.filter(lines_of(c("_analysis")), lambda s: F.char_length(s) > 25),
        "_lead": F.coalesce(F.get(F.filter(lines_of(c("_conclusion")), lambda s: s != ""), F.lit(0)), F.lit("")),
        "_findings": F.greatest(F.size(F.filter(F.transform(F.split("findings", r"[.\n]"), clinical.trim), lambda s: F.char_length(s) > 5)), F.lit(1)),
        "_labels": F.transform(F.regexp_extract_all("html", F.lit("(?i)<b>([^<]+)</b>"), 1), clinical.trim), "_place": F.concat_ws(":", "modality", "region"),
    })
    ours, theirs = (c("_en"), c("_pt")) if pack.words.key == "en-US" else (c("_pt"), c("_en"))
    return out.withColumns({
        "_ratio": F.when(F.size("_expected") == 0, 1.0).otherwise(1 - F.size("_lost") / F.size("_expected")), "_other_language": text.language_mismatch(ours, theirs),
        "_swap": swapped(c("_pairs"), F.split("_plain", r"[.\n]"), pack.words), "_copied": F.size(F.filter("_long", lambda s: F.contains("_folded_said", F.substring(text.fold(s), 1, 35)))),
        "_hedged": F.size(F.filter("_sentences", lambda s: text.fold(s).rlike(HEDGES))),
    })


def _order(pack: Pack) -> Column:
    """The sections come in order: technique if there is one, analysis, conclusion."""
    every = "|".join((pack.analysis, pack.conclusion, pack.technique))
    place = lambda xs, p: F.array_position(F.transform(xs, lambda x: x.rlike(any_case(p))), True)
    held = F.filter("_labels", lambda x: x.rlike(any_case(every)))

    def in_order(xs: Column) -> Column:
        a, t, z = (place(xs, p) for p in (pack.analysis, pack.technique, pack.conclusion))
        return (a > 0) & (z > a) & ((t == 0) | (t < a))

    return let(held, in_order)


def checks(pack: Pack, dims: tuple[str, ...] = DIMS) -> Column:
    """All checks of these dimensions that apply, as an array, over the columns of with_parts."""
    c, made, always = F.col, [], F.lit(True)
    ok = lambda passed, evidence: F.when(passed, "ok").otherwise(evidence if isinstance(evidence, Column) else F.lit(evidence))

    def add(dim: str, name: str, label: str, severity: str, passed: Column, evidence: Column | str = "not ok", when: Column = always) -> None:
        if dim in dims:
            made.append(F.when(when, check(dim, name, label, severity, passed, ok(passed, evidence))))

    html, plain, said, bare = c("html"), c("_plain"), c("_conclusion"), c("_bare")
    add("CRIT", "C01", "No contrast language in non-contrast exam", "critical", ~html.rlike(any_case(pack.contrast)), F.regexp_extract(html, any_case(pack.contrast), 0), ~c("contrast"))
    add("CRIT", "C02", "No umbrella phrase in conclusion", "major", ~said.rlike(any_case(pack.umbrella)), "umbrella phrase in conclusion", c("abnormal"))
    for i, p in enumerate(pack.banned):
        add("CRIT", f"C03{i}", "No banned phrase", "critical", ~html.rlike(any_case(p)), "found banned phrase")
    add("CRIT", "C04", "No markdown or foreign HTML/XML", "critical", ~html.rlike(r"(?m)^#{1,3}\s|^\*\*|```|</?(?:p|div|span|h[1-6]|ul|ol|li|em|strong|a)\b"), "ok")
    add("CRIT", "C05", "No measurements in conclusion", "major", ~said.rlike(r"(?i)\b\d+(?:[.,]\d+)?\s*(?:cm|mm)\b|\b\d+\s*x\s*\d+\b"), "ok")
    add("CRIT", "C06", "Abnormal study cannot lead with normal conclusion", "minor", ~c("_lead").rlike(any_case(pack.normal)), c("_lead"), c("abnormal"))
    add("CRIT", "C07", "Input findings preserved above minimum threshold", "critical", c("_ratio") >= 0.75, F.concat(F.lit("missing: "), F.array_join("_lost", ", ")))
    add("CRIT", "C08", "No boilerplate filler in pathological conclusion", "major", ~c("_said").rlike(f"(?i){FILLER}"), "boilerplate in pathological conclusion", c("abnormal"))
    add("QUAL", "Q01", "Has bold title", "minor", html.rlike(r"(?i)^(?:\s|<br\s*/?>)*<center><b>"), F.substring(html, 1, 40))
    add("QUAL", "Q02", "Title spells out modality", "minor", ~c("_title").rlike(f"(?i){pack.title_abbreviations}"), c("_title"))
    add("QUAL", "Q03", "No <br><br> inside analysis", "minor", ~F.contains("_analysis", F.lit("<br><br>")), "ok")
    add("QUAL", "Q04", "No <br><br> inside conclusion", "minor", ~F.contains(said, F.lit("<br><br>")), "ok")
    add("QUAL", "Q05", "Has section separators", "major", html.rlike("(?i)<br><br><b>"), "ok")
    add("QUAL", "Q06", "Only allowed tags", "major", ~html.rlike(r"(?i)<(?!/?(?:center|b|br)\s*/?>)[a-z][^>]*>"), "ok")
    add("QUAL", "Q07", "No placeholders", "critical", ~html.rlike(r"\[[A-Z_]{2,}\]|_{3,}|(?<!\w)XXX(?!\w)|####"), "ok")
    add("QUAL", "Q08", "Analysis section present", "critical", html.rlike(any_case(pack.analysis)), "ok")
    if "QUAL" in dims:
        made.append(F.when(c("modality") == "US", check("QUAL", "Q09", "Ultrasound technique section is optional and non-gating", "minor", always, F.when(html.rlike(any_case(pack.technique)), "technique section present").otherwise("technique section absent"))))
    add("QUAL", "Q10", "Conclusion is synthesis not copy-paste of analysis", "major", c("_copied") <= 1, F.concat(c("_copied").cast("string"), F.lit(" lines copied")))
    add("QUAL", "Q11", "Conclusion section present and non-empty", "critical", F.char_length(clinical.trim(c("_said"))) > 10, "missing")
    add("QUAL", "Q12", "Analysis has substantive content", "major", _words(text.strip_tags(c("_analysis"))) >= 15, F.concat(_words(text.strip_tags(c("_analysis"))).cast("string"), F.lit(" words")))
    signals = F.concat(F.lit("pt signals: "), c("_pt").cast("string"), F.lit(", en signals: "), c("_en").cast("string"))
    add("TERM", "T-LANG", "Report language matches suite locale", "critical", ~c("_other_language"), signals)
    for i, (p, label) in enumerate(pack.forbidden):
        p = f"(?i){_unmarked(p)}"
        add("TERM", f"T{i:02d}", label, "major", ~bare.rlike(p), F.regexp_extract(bare, p, 0))
    for i, o in enumerate(pack.openers):
        add("TERM", f"TO{i}", f"No forbidden opener: {o}", "major", ~bare.rlike(rf"(?i)(?:<br>|</b>|\.)\s*{re.escape(_unmarked(o))}"), "ok")
    for name, modality, severity in (("TM1", "US", "critical"), ("TM2", "MRI", "critical"), ("TM3", "CT", "major")):
        label, p = pack.vocabulary[modality]
        p = f"(?i){_unmarked(p)}"
        add("TERM", name, label, severity, ~bare.rlike(p), F.regexp_extract(bare, p, 0), c("modality") == modality)
    add("QUAL", "Q14", "Conclusion not excessively hedged", "minor", c("_hedged") / F.size("_sentences") <= 0.4, F.concat(c("_hedged").cast("string"), F.lit("/"), F.size("_sentences").cast("string"), F.lit(" sentences hedged")), F.size("_sentences") > 0)
    add("QUAL", "Q15", "Report not excessively verbose", "minor", _words(c("_stripped")) / c("_findings") <= 200, F.concat(F.round(_words(c("_stripped")) / c("_findings")).cast("int").cast("string"), F.lit(" words/finding")), c("_findings") >= 2)
    for key, tokens in pack.coverage.items():
        for i, t in enumerate(tokens):
            add("GUIDE", f"G{i + 1:02d}", f"Anatomical coverage: {t}", "major", F.contains(plain, F.lit(t)), f"missing: {t}", c("_place") == key)
    holds = lambda variants: clinical.any_of(F.contains("_head", F.lit(folded_variant(v))) for v in variants)
    named = F.coalesce(*(F.when(c("modality") == m, _every(holds(slot.split("|")) for slot in slots)) for m, slots in pack.title_words.items()), always)
    region = F.coalesce(*(F.when(c("region") == r, holds(words)) for r, words in pack.region_words.items()), always)
    if "RAG" in dims:
        made.append(check("RAG", "R01", "Title preserves modality and region", "critical", named & region, F.coalesce(F.nullif(c("_title"), F.lit("")), F.lit("missing title"))))
    # How the report may name a side.
    there = {"right": "right|direit", "left": "left|esquerd", "bilateral": "bilateral|bilater"}
    present = F.forall("_sides", lambda s: F.coalesce(*(F.when(s == n, plain.rlike(p)) for n, p in there.items())))
    add("RAG", "R02", "Laterality preserved and correct", "critical", ~c("_swap") & present, F.when(c("_swap"), "SWAP").otherwise(F.concat(F.lit("missing laterality: "), F.array_join("_sides", ", "))), F.size("_sides") > 0)
    flat = F.regexp_replace(F.upper("_stripped"), r"\s+", "")
    add("RAG", "R03", "Spinal level preserved", "major", F.forall("_levels", lambda x: F.contains(flat, x)), F.array_join("_levels", ", "), F.size("_levels") > 0)
    add("RAG", "R04", "Measurements preserved in body", "major", F.forall("_measures", lambda x: text.measurement_present(plain, x)), F.array_join("_measures", ", "), F.size("_measures") > 0)
    add("RAG", "R05", "Key findings preserved", "critical", c("_ratio") >= 0.8, F.array_join("_lost", ", "), F.size("_expected") > 0)
    add("RAG", "R06", "Section order preserved", "minor", _order(pack), F.array_join("_labels", " → "))
    return F.array_compact(F.array(*made)).cast(CHECK)


def folded_variant(v: str) -> str:
    """A variant as the title is compared with it: folded, so blanks at its ends go."""
    return _unmarked(v).strip().lower()


def _every(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def with_meta(reports: DataFrame, pack: Pack = ENGLISH) -> DataFrame:
    """reports with modality, region, contrast and abnormal where they have an exam but not these."""
    if "exam" not in reports.columns:
        return reports
    meta = exam_meta(F.col("exam"), F.col("findings"), pack)
    return reports.withColumns({k: v for k, v in meta.items() if k not in reports.columns})


def with_checks(reports: DataFrame, pack: Pack = ENGLISH, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """reports with the array structural of all checks of these dimensions that apply."""
    full = with_meta(reports, pack)
    return with_parts(full, pack).withColumn("structural", checks(pack, dims)).select(*full.columns, "structural")


def structural_checks(reports: DataFrame, pack: Pack = ENGLISH, keys=("case_id",)) -> DataFrame:
    """(keys, dim, id, name, severity, passed, evidence): one row for each check that applies."""
    # The outer form, as the optimizer would else put a filter on the array's size, and all its expressions, below them.
    return with_checks(reports, pack).select(*keys, F.inline_outer("structural")).where(F.col("id").isNotNull())
