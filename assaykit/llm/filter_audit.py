"""Interaction audit of filters: what each filter removes in every order of application, and its Shapley share.

Each document has a mask of the filters it fails. Documents are counted by part and mask, so a part has at most 2^k cells
for k filters, whatever its size; everything else is computed from cells. The orders of the filters are visited by
adjacent transpositions: each differs from the one before by one swap, so only the two steps of the swap are counted
anew from the cells, the others are carried over. The Shapley sum of a filter, what it removes at any step over all orders,
accumulates along the same walk.

The five filters here (FILTERS): A: under 100 words; B: under 80 distinct words in 100; C: over 10 capitals A-Z in 100
characters; D: a character of ``#$%&*|``; E: the same text stands under a smaller id. E is one aggregation by a digest of
the text with map-side combination and a join of the texts that stand more than once, both without texts.

Edge cases: a null text is empty, and so is a null part; a null id fails no E and makes nobody fail E; rows that repeat an id and
a text are counted each, and don't fail E for each other; of labels that repeat an id the largest counts; no documents
give no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_python, lean, small

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which the filters that look at the text alone fail it."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def marked(docs: DataFrame, id_col="doc_id", text="text", part="lang") -> DataFrame:
    """(id, part, mask): bit k of the mask is set where the document fails filter k."""
    texts = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures(F.col(text)).values())), F.lit(0))
    rows = cut(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
        F.unhex(F.md5(texts)).alias("digest"),
    ))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n >= 2")
    first = cut(first.select("digest", "first"))
    same = rows.join(small(first), "digest", "left")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return same.select("id", "part", F.when(later, F.col("mask") + (1 << len(FILTERS) - 1)).otherwise(F.col("mask")).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame | None = None, label_id="doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by mask, and how many of them are labelled good and toxic."""
    if labels is None:
        return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id"))
    known = cut(known.agg(F.max("quality").alias("quality"), F.max("toxic").alias("label_toxic")).where("quality = 1 or label_toxic = 1"))
    joined = cut(masks).join(small(known), F.col("id") == F.col("label_id"), "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("label_toxic") == 1).alias("toxic"))


def transpositions(n: int) -> Iterator[int]:
    """Places k so that swapping k and k + 1, one after another, visits all orders of n things once (adjacent transpositions)."""
    if n < 2:
        return
    inner, down = list(transpositions(n - 1)), True
    for swap in [*inner, None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if swap is not None:
            yield swap + 1 if down else swap  # the largest thing stands in front, or behind
        down = not down


class Walk:
    """The steps of one part in the present order, from its cells {mask: counts}."""

    def __init__(self, cells: dict[int, tuple], n: int):
        self.cells, self.order = cells, list(range(n))
        total = sum(c[0] for c in cells.values())
        self.unique = [cells.get(1 << f, (0,))[0] for f in range(n)]
        self.steps: list[list[int]] = []
        for k in range(n):
            self.steps.append(self._step(k, self.steps[-1][0] if k else total))

    def _step(self, k: int, left: int) -> list[int]:
        """[kept, removed, redundant, good_lost, toxic_lost] of the filter at k, which `left` documents reach."""
        own, before = 1 << self.order[k], sum(1 << f for f in self.order[:k])
        removed = redundant = good = toxic = 0
        for mask, (n, g, t) in self.cells.items():
            if mask & own:
                if mask & before:
                    redundant += n
                else:
                    removed, good, toxic = removed + n, good + g, toxic + t
        return [left - removed, removed, redundant, good, toxic]

    def swap(self, k: int) -> None:
        left = self.steps[k][0] + self.steps[k][1]
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.steps[k] = self._step(k, left)
        self.steps[k + 1] = self._step(k + 1, self.steps[k][0])


def walked(cells: dict[int, tuple], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    walk, shapley, out = Walk(cells, len(names)), [0] * len(names), []
    for swap in [None, *transpositions(len(names))]:
        if swap is not None:
            walk.swap(swap)
        order = "".join(names[f] for f in walk.order)
        for k, (f, (kept, removed, redundant, good, toxic)) in enumerate(zip(walk.order, walk.steps, strict=True)):
            shapley[f] += removed
            out.append((order, k + 1, f, kept, removed, redundant, walk.unique[f], good, toxic))
    return [(order, step, *rest, shapley[f]) for order, step, f, *rest in out]


def audit(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the cells of each part."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 2^k cells each

    @lean
    def run(batches):
        for b in batches:
            part, rows = [], []
            for p, own in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                found = walked({c["mask"]: tuple(c[x] for x in COUNTS) for c in own}, names)
                part += [p] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * (2 + len(FIELDS))
            arrays = [pa.array(part, pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *FIELDS])

    return parts.transform(in_python, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in FIELDS))
