"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

from pyspark.sql import types as T

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "rt", "l") for c in ("a", "o", "ie", "u")]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("n_words", T.StringType()), T.StructField("items", T.StringType()), T.StructField("label", T.StringType()),
    ]
)


def prose(r: random.Random, n: int) -> str:
    out, line = [], []
    for i in range(n):
        line.append(r.choice(WORDS) + r.choice(WORDS))
        if i % 12 == 11:
            out.append(" ".join(line) + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


def rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    texts = [None, "", "   \n\t", "one", prose(r, 4000)] + [prose(r, r.randint(5, 200)) for _ in range(20)]
    texts += [texts[-1], texts[-1], texts[-2]]
    found = [(i, t, "en", None, None if t is None else len(t), "clash", "clash", "clash", None) for i, t in enumerate(texts)]
    return found + [found[6], (None, "no id here", None, "src0", 10, None, None, None, None)]


def documents(spark, more=(), seed: int = 1):
    extra = [(i, t, "en", "src1", len(t), "x", "x", "x", "x") for i, t in more]
    return spark.createDataFrame(rows(seed) + extra, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
