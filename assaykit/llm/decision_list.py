"""Quality rules as a learned decision list, in Spark expressions only.

Statistics of each whole text are columns. On labelled rows a sequential covering grows conjunctions of thresholds that
single out poor texts: a rule takes the condition with the best FOIL gain until it is pure or three conditions long, is
pruned on rows it was not grown on, and is kept if it is precise there; covered rows leave, and the next rule is grown.
The ordered rules become one CASE expression. Fitted on at most SAMPLE labelled rows, picked by a hash of the id.

Edge cases: a null or empty text has no words, so it fails the base rules; without labels there are no learned rules;
repeated rows give equal rows; long texts are counted whole (window counts take n log n steps).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

SAMPLE = 4_000
SPACE = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: What the rules look at: shares that don't depend on the length of the text.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(q: Column) -> Column:
    """Words in windows whose hash occurs twice or more; q: (h, p) sorted."""
    twice = F.filter(q, lambda x, i: (x["h"] == F.get(q, i - 1)["h"]) | (x["h"] == F.get(q, i + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    return bound(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        ),
    )


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array w. Windows are compared by a 64-bit hash."""
    last = F.size(w) - 3
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    count = bound(
        made,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), _covered)
        ),
    )
    return F.when(last < 1, F.lit(0)).otherwise(count)


def statistics(docs: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns of keep with STATS."""
    keep = [c for c in keep if c not in STATS]
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep, t.alias("_t"), F.array_remove(F.split(t, SPACE), "").alias("_w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    count = lambda p: F.regexp_count("_t", F.lit(p)).cast("long")
    return split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.at if self.above else value <= self.at

    def holds(self, row) -> bool:
        return (row[self.feature] > self.at) == self.above


Rule = tuple[Condition, ...]


def _cuts(values: list[float], bins: int) -> list[float]:
    """Thresholds midway between neighbours among quantiles of the distinct values: far from both sides of a gap."""
    distinct = sorted(set(values))
    marks = sorted({distinct[(len(distinct) - 1) * k // bins] for k in range(bins + 1)}) if distinct else []
    return [(a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)]


def learn(rows: list[dict], poor: list[bool], bins: int = 24, longest: int = 3, precision: float = 0.9, least: int = 5, most: int = 12) -> list[Rule]:
    """Ordered rules for poor rows. Sets of rows are bit masks; every third row is for pruning only."""
    import math

    conditions: dict[Condition, int] = {}
    for f in FEATURES:
        for at in _cuts([r[f] for r in rows], bins):
            mask = sum(1 << i for i, r in enumerate(rows) if r[f] > at)
            conditions[Condition(f, True, at)] = mask
            conditions[Condition(f, False, at)] = ((1 << len(rows)) - 1) & ~mask
    bad = sum(1 << i for i, p in enumerate(poor) if p)
    good = ((1 << len(rows)) - 1) & ~bad
    prune = sum(1 << i for i in range(2, len(rows), 3))
    left = (1 << len(rows)) - 1

    def mask_of(rule) -> int:
        m = left
        for c in rule:
            m &= conditions[c]
        return m

    rules: list[Rule] = []
    while len(rules) < most:
        grow = left & ~prune
        rule: list[Condition] = []
        now = grow
        while len(rule) < longest and now & good:
            p, n = (now & bad).bit_count(), (now & good).bit_count()
            if not p:
                break
            info = math.log2(p / (p + n))
            best, gain = None, 1e-9
            for c, m in conditions.items():
                p1, n1 = (now & m & bad).bit_count(), (now & m & good).bit_count()
                if p1 >= least and (g := p1 * (math.log2(p1 / (p1 + n1)) - info)) > gain:
                    best, gain = c, g
            if best is None:
                break
            rule.append(best)
            now &= conditions[best]
        if not rule:
            break

        def worth(r) -> float:
            m = mask_of(r) & prune
            p, n = (m & bad).bit_count(), (m & good).bit_count()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        m = mask_of(rule)
        p, n = (m & bad).bit_count(), (m & good).bit_count()
        if p < least or p / (p + n) < precision or worth(rule) < 2 * precision - 1:
            break
        rules.append(tuple(rule))
        left &= ~m
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", label="quality", text="text", sample: int = SAMPLE) -> list[Rule]:
    """Rules learned from at most `sample` labelled rows that pass the base rules; label 0 is poor. Of an id that repeats the highest label and the smallest text count."""
    picked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).alias("_y"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col, "_y").limit(sample)
    picked = picked.groupBy(F.col(id_col).alias("_id")).agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # one row for each id
    stats = cut(statistics(rows, "_text", ["_id", "_y"])).where(~base_failed())
    got = stats.select("_id", "_y", *(F.expr(e).alias(n) for n, e in FEATURES.items())).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1:]))
    return learn([r.asDict() for r in got], [r["_y"] == 0 for r in got])


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds, as one ordered CASE expression."""
    out = F
    for rule in rules:
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(docs: DataFrame, rules: list[Rule], text="text", keep=("doc_id",)) -> DataFrame:
    """Statistics with base_failed and kept."""
    return statistics(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
