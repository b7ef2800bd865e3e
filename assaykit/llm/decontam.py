"""Benchmark decontamination by a hash set of the benchmark's word windows.

Each benchmark item gives its windows of `width` consecutive words (a shorter item is one window). Their number is
counted first: up to MAX_WINDOWS the set is broadcast and each document is scanned once, without a shuffle; beyond it the
documents' window hashes are joined with the set's, both sides shuffled. In the broadcast form a numeric window hash picks
the places to look at and the words themselves decide; the joined form decides by a 128-bit hash of the words.

Edge cases: null and empty texts have no words and no hits; items without words are left out; the same passage in several
items counts for each; repeated rows give equal rows. An empty benchmark leaves every document clean. Columns of any name
stay as they are in `remove_documents` and `remove_spans`; in `scan` those of `keep` named like a result give way to it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tables import aside, cut, fits, id_type, in_python, lean
from .text import pieces, raw, with_columns, words

WIDTH = 10
#: The set is broadcast up to so many windows and bytes of them: it stays under about 200 MB.
MAX_WINDOWS = 500_000
MAX_BYTES = 100 << 20
BITS = 20
STEP = np.uint64(0x9E3779B97F4A7C15)
FIELDS = ("n_words", "n_hit", "items")
ONE_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def item_windows(benchmark: DataFrame, width: int = WIDTH, item="item_id", text="text") -> DataFrame:
    """(item_id, window) rows: the words of each window joined by spaces."""
    kind = id_type(benchmark, item)
    arrow = to_arrow_type(kind)

    def run(batches):
        for b in pieces(batches, text):
            ids, out = [], []
            for i, t in zip(b.column(item).to_pylist(), raw(b, text), strict=True):
                w = words(t)
                found = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else ()
                ids += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(out, pa.binary())], ["item_id", "window"])

    return benchmark.select(F.col(item).cast(kind).alias(item), text).transform(in_python, run, f"item_id {kind.simpleString()}, window binary")


class WindowSet:
    """Windows by length, with a bit table over a numeric hash of each."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.items: dict[bytes, list[int]] = defaultdict(list)
        for item, window in rows:
            self.items[window].append(item)
        split = [w.split(b" ") for w in self.items]
        vocabulary = {x for w in split for x in w}
        self.number = {w: xxhash.xxh3_64_intdigest(w) | 1 for w in vocabulary}
        self.bits: dict[int, np.ndarray] = {}
        for w in split:
            table = self.bits.setdefault(len(w), np.zeros(1 << BITS, dtype=bool))
            table[rolled(np.array([self.number[x] for x in w], dtype=np.uint64), len(w)) >> np.uint64(64 - BITS)] = True

    def scan(self, found: list[bytes]) -> tuple[int, set[int]]:
        """Hit words and the items that have a window in these words."""
        items: set[int] = set()
        if not self.bits or len(found) < min(self.bits):
            return 0, items
        get = self.number.get
        ids = np.fromiter(map(get, found, repeat(0)), np.uint64, len(found))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hit = None
        for n, table in self.bits.items():
            if len(found) < n:
                continue
            whole = unknown[n:] == unknown[:-n]
            if not whole.any():
                continue
            for s in np.flatnonzero(table[rolled(ids, n) >> np.uint64(64 - BITS)] & whole).tolist():
                if own := self.items.get(b" ".join(found[s : s + n])):
                    items.update(own)
                    hit = np.zeros(len(found), dtype=bool) if hit is None else hit
                    hit[s : s + n] = True
        return 0 if hit is None else int(hit.sum()), items


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each n consecutive numbers."""
    m = len(ids) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + m]) * STEP
        h ^= h >> np.uint64(29)
    return h * STEP


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text="text", keep=("doc_id",), max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns of keep with n_words, n_hit (words inside a benchmark window) and items (sorted ids of items found)."""
    keep = [c for c in dict.fromkeys(keep) if c not in FIELDS]
    docs, where = aside(docs.select(*dict.fromkeys([*keep, text])))
    own, text = [where[c] for c in keep], where[text]
    windows = item_windows(benchmark, width)
    known = cut(windows)
    kind = id_type(benchmark, "item_id")
    arrow, result = pa.list_(to_arrow_type(kind)), f"n_words long, n_hit long, items array<{kind.simpleString()}>"
    if known.limit(max_windows + 1).count() > max_windows or not fits(known, MAX_BYTES):
        return _joined(docs, known, width, text, own).toDF(*keep, *FIELDS)
    shipped = docs.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.window)) for r in known.collect()])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(shipped.value)
        for b in pieces(batches, text):
            found = [words(t) for t in raw(b, text)]
            got = [known.scan(w) for w in found]
            yield with_columns(b, own, {
                "n_words": pa.array(map(len, found), pa.int64()),
                "n_hit": pa.array([n for n, _ in got], pa.int64()),
                "items": pa.array([sorted(i for i in x if i is not None) for _, x in got], arrow),
            })

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), result])
    return docs.transform(in_python, run, schema).toDF(*keep, *FIELDS)


def _joined(docs: DataFrame, windows: DataFrame, width: int, text: str, keep: list[str]) -> DataFrame:
    """The same for a benchmark too large to broadcast. Rows are numbered, so repeated rows and null ids stay apart."""
    lengths = sorted(r[0] for r in windows.select(F.expr("size(split(cast(window as string), ' '))")).distinct().collect())
    row = cut(docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", *dict.fromkeys([*keep, text])))
    per = _hits(row, windows, lengths, text)

    @lean
    def counted(batches):
        for b in pieces(batches, text):
            yield with_columns(b, ["_row", *keep], {"n_words": pa.array([len(words(t)) for t in raw(b, text)], pa.int64())})

    schema = ", ".join(["_row long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long"])
    out = row.transform(in_python, counted, schema).join(per, "_row", "left")
    none = F.expr(f"cast(array() as array<{windows.schema['item_id'].dataType.simpleString()}>)")
    return out.select(*keep, "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.array_compact("items"), none).alias("items"))


def _hits(row: DataFrame, windows: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """(_row, hit, items): sorted numbers of the hit words and sorted items of each row that has any, by a shuffled join of window digests."""

    @lean
    def run(batches):
        for b in pieces(batches, text, 1 << 18):
            rows, starts, sizes, digests = [], [], [], []
            for r, t in zip(b.column("_row").to_pylist(), raw(b, text), strict=True):
                w = words(t)
                for n in lengths:
                    own = range(max(0, len(w) - n + 1))
                    rows.append(np.full(len(own), r, np.int64))
                    starts += own
                    sizes.append(np.full(len(own), n, np.int32))
                    digests += [xxhash.xxh3_128_digest(b" ".join(w[s : s + n])) for s in own]
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(starts, pa.int32()), pa.array(np.concatenate(sizes)), pa.array(digests, pa.binary())], ["_row", "s", "n", "h"])

    @F.pandas_udf("binary")
    def digest(x):
        return x.map(xxhash.xxh3_128_digest)

    places = row.select("_row", text).transform(in_python, run, "_row long, s int, n int, h binary")
    found = places.join(windows.select("item_id", digest("window").alias("h")), "h")
    # A row's words and items are sets over all its hits, so map-side combination bounds what is shuffled.
    hits = found.select("_row", "item_id", F.explode(F.sequence("s", F.expr("s + n - 1"))).alias("word"))
    return hits.groupBy("_row").agg(F.array_sort(F.collect_set("word")).alias("hit"), F.array_sort(F.collect_set("item_id")).alias("items"))


def report(scanned: DataFrame, id_col="doc_id") -> DataFrame:
    """Digest columns of scan()'s rows: item ids sorted as strings."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scanned.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that hold a benchmark window; all columns stay as they are, whatever their names."""
    named, where = aside(docs)
    kept = scan(named, benchmark, width, where["text"], named.columns).where(F.col("n_hit") == 0)
    return kept.select(*named.columns).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text="text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents with each hit word replaced by one space; texts without hits stay as they are."""
    columns = docs.columns
    docs, where = aside(docs)
    text = where[text]
    known = cut(item_windows(benchmark, width))
    if known.limit(max_windows + 1).count() > max_windows or not fits(known, MAX_BYTES):
        lengths = sorted(r[0] for r in known.select(F.expr("size(split(cast(window as string), ' '))")).distinct().collect())
        row = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
        marked = row.join(_hits(row, known, lengths, text).select("_row", "hit"), "_row", "left").select(*docs.columns, F.col("hit").alias("_hit"))

        @lean
        def cut_out(batches):
            for b in pieces(batches, text):
                out = [own if own is None or not hit else _without(t, set(hit)) for own, t, hit in zip(b.column(text).to_pylist(), raw(b, text), b.column("_hit").to_pylist(), strict=True)]
                yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string())).select(docs_columns)

        docs_columns = docs.columns
        return marked.transform(in_python, cut_out, docs.schema).toDF(*columns)
    shipped = docs.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.window)) for r in known.collect()])

    @lean
    def run(batches):
        known = WindowSet(shipped.value)
        for b in pieces(batches, text):
            out = []
            for own, t in zip(b.column(text).to_pylist(), raw(b, text), strict=True):
                w = words(t)
                if own is not None and known.scan(w)[0]:
                    hit = {k for n in known.bits for s in range(len(w) - n + 1) if b" ".join(w[s : s + n]) in known.items for k in range(s, s + n)}
                    own = _without(t, hit)
                out.append(own)
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return docs.transform(in_python, run, docs.schema).toDF(*columns)


def _without(t: bytes, hit: set[int]) -> str:
    """The text with the words of these numbers replaced by a space each."""
    number = count()
    return ONE_WORD.sub(lambda m: b" " if next(number) in hit else m[0], t).decode()

