"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words (ASCII letters lower-cased, symbols split off), hashed into SLOTS slots, and
binned statistics of its structure: shares of capitals, digits and symbols, repeated lines and words, lengths, and the
table's character count. Each feature has a weight and a vector of RANK numbers; pairs of features interact by the
product of their vectors. The sum over all pairs is taken in linear time as half of (sum of vectors)^2 minus the sum of
squares. The score is the logistic of the sum.

Fitted on at most SAMPLE labelled rows, picked by a hash of the id over all labels (rows held out are never picked);
every document is scored. Without labels, or with one class only, each score is that class's share (0.5 without any).

Edge cases: null and empty texts have structure features only and get a score; repeated labels count each time; labels
other than 0 and 1 are left out; repeated rows give equal rows; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import in_python, lean
from .text import Cache, pieces, raw, with_columns

SLOTS = 1 << 16
RANK = 4
SAMPLE = 6_000
EPOCHS = 12
BINS = 12
#: Bytes to word bytes with symbols as words of one kind: digits become 0, symbols stay.
CLASS = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c < 33 or c == 127 else c for c in range(256))
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SCALES = 13


def held_out(id_col="doc_id") -> Column:
    """True for the rows that are never used in fitting: crc32 of the id as text, modulo 3, is 1. Null ids are in."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bin(kind: int, share: float) -> int:
    """Slot of a statistic between 0 and 1, in bins that are finer near 0."""
    return SLOTS + kind * BINS + min(BINS - 1, int((max(0.0, share) ** 0.5) * BINS))


def structure(t: bytes, w: list[bytes], distinct: set[bytes], meta: float | None) -> list[int]:
    """Slots of the structure statistics: one for each kind."""
    n = max(1, len(t))
    count = lambda chars: (len(t) - len(t.translate(None, chars))) / n
    m = max(1, len(w))
    lines = [x for x in t.split(b"\n") if x.strip()]
    size = lambda x: min(1.0, x.bit_length() / 24) ** 2
    return [
        _bin(0, count(UPPER)), _bin(1, count(DIGITS)), _bin(2, count(b"#*$%&|<>")), _bin(3, count(b"!?")), _bin(4, count(b".,;:")),
        _bin(5, 1 - len(set(lines)) / max(1, len(lines))), _bin(6, 1 - len(distinct) / m),
        _bin(7, sum(map(eq, w, w[1:])) / m), _bin(8, size(len(w))),
        _bin(9, size(len(lines))), _bin(10, min(1.0, (n / m / 24) ** 2)), _bin(11, min(1.0, n / 64 / max(1, len(lines)) / 16)),
        _bin(12, size(int(meta)) if meta and meta > 0 else 0.0),
    ]


WORDS = re.compile(rb"[0a-z\x80-\xff]+|[^0a-z\x80-\xff ]+")


def _slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % SLOTS


def _marks(chunk: bytes) -> tuple[int, ...]:
    """Slots of a text without white space: its words, and its runs of symbols."""
    return tuple(_slot(x) for x in WORDS.findall(chunk.translate(CLASS)))


def slots(t: bytes, meta: float | None, cache: Cache) -> list[int]:
    """All feature slots of a text. Each distinct word counts once, structure statistics count as the words together do."""
    w = t.split()
    distinct = set(w)
    return [*set().union(*map(cache.__getitem__, distinct)), *structure(t, w, distinct, meta)]


class Machine:
    """Weights w and vectors v. Features of a text have the values x: words 1/sqrt(number of words), statistics 1."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(SLOTS + SCALES * BINS, dtype=np.float32)
        self.v = r.normal(0, 0.05, (len(self.w), RANK)).astype(np.float32)

    def raw(self, idx: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums before the logistic, and the sums of vectors that gradients need."""
        vx = self.v[idx] * x[:, None]
        total = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, np.einsum("ij,ij->i", vx, vx), n)
        return self.bias + np.bincount(row, self.w[idx] * x, n) + 0.5 * ((total**2).sum(1) - squares), total

    def score(self, texts: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*spread(texts))[0], -30, 30)))

    def fit(self, texts: list[list[int]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Machine:
        """AdaGrad over shuffled batches."""
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            self.v[:] = 0
            return self
        r = np.random.default_rng(seed)
        gw, gv = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                idx, x, row, n = spread([texts[i] for i in own])
                s, total = self.raw(idx, x, row, n)
                d = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[own]) / n
                dx = d[row] * x
                used, inv = np.unique(idx, return_inverse=True)
                grad = np.bincount(inv, dx).astype(np.float32) + decay * self.w[used]
                each = dx[:, None] * (total[row] - self.v[idx] * x[:, None])
                grads = np.stack([np.bincount(inv, each[:, f]) for f in range(RANK)], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += grad**2
                gv[used] += grads**2
                self.w[used] -= rate * grad / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * grads / np.sqrt(gv[used])
                self.bias -= 0.02 * float(d.sum())
        return self


def spread(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature slots, values and rows of a list of texts, end to end."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    idx = np.fromiter(chain.from_iterable(texts), np.int64, int(size.sum()))
    row = np.repeat(np.arange(len(texts)), size)
    n_words = np.maximum(1, size - SCALES)
    x = np.where(idx < SLOTS, 1 / np.sqrt(n_words)[row], 1.0).astype(np.float32)
    return idx, x, row, len(texts)


def _features(docs: DataFrame, text: str, meta: str | None, keep: list[str]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "slots array<int>"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(_marks, 1 << 16)
        for b in pieces(batches, text):
            metas = b.column(meta).to_pylist() if meta else [None] * b.num_rows
            out = [slots(t, m, cache) for t, m in zip(raw(b, text), metas, strict=True)]
            yield with_columns(b, keep, {"slots": pa.array(out, pa.list_(pa.int32()))})

    return docs.select(*dict.fromkeys([*keep, text, *([meta] if meta else [])])).transform(in_python, run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", label="quality", text="text", meta: str | None = "n_chars", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled rows that are not held out: of an id that repeats the highest label and the smallest text."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, F.col(label).alias("_y"))
    picked = usable.orderBy(F.xxhash64(id_col), id_col, "_y").limit(sample)
    meta = meta if meta in docs.columns else None
    own = [F.col(text).alias("_text"), (F.col(meta).cast("double") if meta else F.lit(None).cast("double")).alias("_meta")]
    rows = docs.select(F.col(id_col).alias("_id"), *own).join(F.broadcast(picked.groupBy(F.col(id_col).alias("_id")).agg(F.max("_y").alias("_y"))), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct("_text", "_meta")).alias("x")).select("_id", "_y", "x.*")  # one row for each id
    got = _features(rows, "_text", "_meta", ["_y"]).collect()
    got.sort(key=lambda r: (r._y, r.slots))
    return Machine().fit([list(r.slots) for r in got], np.array([float(r._y) for r in got]))


def score(docs: DataFrame, machine: Machine, text="text", meta: str | None = "n_chars", keep=("doc_id",), into="score") -> DataFrame:
    """The columns of keep with the score of each whole text."""
    keep = [c for c in keep if c != into]
    meta = meta if meta in docs.columns else None
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{into} double"])

    @lean
    def run(batches):
        cache = Cache(_marks, 1 << 16)
        for b in pieces(batches, text):
            metas = b.column(meta).to_pylist() if meta else [None] * b.num_rows
            found = [slots(t, m, cache) for t, m in zip(raw(b, text), metas, strict=True)]
            yield with_columns(b, keep, {into: pa.array(shipped.value.score(found), pa.float64())})

    return docs.select(*dict.fromkeys([*keep, text, *([meta] if meta else [])])).transform(in_python, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The documents whose score reaches `at`; all columns stay as they are."""
    machine = fit(docs, labels)
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name can clash
    where = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = named.withColumn("_text", F.col(where["text"])).withColumn("_meta", F.col(where["n_chars"]) if "n_chars" in where else F.lit(None).cast("double"))
    scored = score(own, machine, "_text", "_meta", keep=named.columns, into="_score")
    return scored.where(F.col("_score") >= at).drop("_score").toDF(*docs.columns)
