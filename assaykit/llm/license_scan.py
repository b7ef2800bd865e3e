"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line or a paragraph (lines between blank lines). A block meets a template if at least `threshold` of the
template's distinct words stand in it. The join is exact. Words are ordered from rare to frequent over the whole corpus;
a block that meets a template must hold one of the template's first |T| - needed + 1 words (prefix filter), must have
enough words of the template vocabulary (length filter), and from the first common word on both sides must have enough
words left (positional filter). Only then the words are counted. Templates are (label, text) pairs or a table of them, of
whole license texts too: each paragraph of LEAST distinct words is a template of its own, so a license is found in each
block that holds one of its paragraphs. A table of templates is collected, up to MAX_TEMPLATES rows and MAX_BYTES bytes.

Edge cases: null and empty texts have no words, no labels and score 0; texts are scanned whole; repeated rows give equal
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .tables import in_python, lean
from .text import pieces, raw, with_columns, words

#: Phrases whose words stand consecutively, and their labels.
PHRASES = [("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: The base phrases of op6's contract, which begins the first of them one word earlier.
CONTRACT = [("under the mit license", "mit"), *PHRASES[1:]]
#: Short notices by which texts commonly name their license.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]
ALL = [*TEMPLATES, *TEXTS]
THRESHOLD = 0.8
LEAST = 6
MAX_TEMPLATES = 20_000
MAX_BYTES = 32 << 20
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def listed(templates) -> list[tuple[str, str]]:
    """(label, paragraph) pairs of a list or a DataFrame (label, text) of templates, each pair once."""
    if isinstance(templates, DataFrame):
        rows, size = templates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if rows > MAX_TEMPLATES or size > MAX_BYTES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates of {MAX_BYTES} bytes in all")
        templates = sorted((r.label, r.text) for r in templates.select("label", "text").where("label is not null and text is not null").collect())
    found = ((label, p) for label, t in templates for p in re.split(r"\n\s*\n", t))
    return list(dict.fromkeys((label, p) for label, p in found if len(set(words(p.encode()))) >= LEAST))


def template_sets(templates=ALL) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(t.encode()))) for label, t in listed(templates)]


def word_order(docs: DataFrame, templates=ALL, text="text") -> list[bytes]:
    """The templates' words from rare to frequent, by the number of documents that hold each. Only they are collected."""
    vocabulary = frozenset().union(*(t for _, t in template_sets(templates)))

    def run(batches):
        n = Counter()
        for b in pieces(batches, text):
            for t in raw(b, text):
                n.update(vocabulary.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])

    rows = docs.select(text).transform(in_python, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r.word): r.n for r in rows}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


class Index:
    """Templates indexed by the words of their prefixes."""

    def __init__(self, order: list[bytes], templates=ALL, threshold: float = THRESHOLD):
        self.place = {w: i for i, w in enumerate(order)}
        self.by_word: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sets = []
        for label, t in template_sets(templates):
            ranks = sorted(self.place[w] for w in t)
            needed = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.sets.append((label, ranks, frozenset(ranks), needed))
            for i, r in enumerate(ranks[: len(ranks) - needed + 1]):
                self.by_word[r].append((len(self.sets) - 1, i))
        self.prefix = frozenset(w for w, r in self.place.items() if r in self.by_word)
        self.least = min((s[3] for s in self.sets), default=1)

    def meets(self, block: list[bytes]) -> dict[int, float]:
        """Templates that the block meets, with the share of the template's words in it."""
        ranks = sorted({self.place[w] for w in block if w in self.place})
        if len(ranks) < self.least:
            return {}
        own, seen, out = frozenset(ranks), set(), {}
        for j, r in enumerate(ranks):
            for k, i in self.by_word.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, t, t_set, needed = self.sets[k]
                if len(ranks) >= needed and 1 + min(len(t) - i - 1, len(ranks) - j - 1) >= needed:
                    both = len(own & t_set)
                    if both >= needed:
                        out[k] = both / len(t)
        return out


def blocks(text: bytes) -> Iterator[bytes]:
    """Lines, and paragraphs of more than one line."""
    held: list[bytes] = []
    for line in [*text.split(b"\n"), b""]:
        if line.strip():
            yield line
            held.append(line)
        else:
            if len(held) > 1:
                yield b"\n".join(held)
            held = []


def places(found: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of each phrase in the words."""
    out = []
    for phrase, label in phrases:
        start = -1
        try:
            while True:
                start = found.index(phrase[0], start + 1)
                if found[start : start + len(phrase)] == phrase:
                    out.append((start, label))
        except ValueError:
            pass
    return out


def scan(docs: DataFrame, templates=ALL, threshold: float = THRESHOLD, phrases=PHRASES, text="text", keep=("doc_id",)) -> DataFrame:
    """The columns of keep with counts, labels and score: the largest share of a template's words found in one block, 1 where a base phrase stands."""
    templates = listed(templates)
    order = word_order(docs, templates, text)
    keep = [c for c in keep if c not in [f.split()[0] for f in FIELDS.split(", ")]]
    wanted = [(words(p.encode()), label) for p, label in phrases]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), FIELDS])

    @lean
    def run(batches):
        index = Index(order, templates, threshold)
        for b in pieces(batches, text):
            rows = []
            for t in raw(b, text):
                w = words(t)
                own = set(w)
                at = [x for p, label in wanted if own.issuperset(p) for x in places(w, [(p, label)])]
                base = {label for _, label in at}
                met: dict[int, float] = {}
                if not own.isdisjoint(index.prefix):
                    for block in blocks(t):
                        for k, share in index.meets(words(block)).items():
                            met[k] = max(share, met.get(k, 0.0))
                labels = base | {index.sets[k][0] for k in met}
                starts = [s for s, _ in at]
                rows.append((len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max(met.values(), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            yield with_columns(b, keep, {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})

    return docs.select(*dict.fromkeys([*keep, text])).transform(in_python, run, schema)
