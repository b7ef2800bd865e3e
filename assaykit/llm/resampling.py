"""Importance resampling towards a target distribution, over hashed runs of words.

A text's features are its runs of 1 to RUN consecutive words, joined by one space, each counted as often as it stands.
A feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. A bucket's gain is the logarithm of the ratio of its
shares in the target and in the corpus; a document's weight is the sum of its features' gains, and documents are drawn
without replacement by the largest weight plus Gumbel noise, which a hash of the id gives, so that a rerun draws the same.

The bytes are read by a vectorised automaton: a lookup table classifies every byte of an Arrow buffer at once, words
begin and end where neighbouring classes differ, and table-driven CRC states of all starts advance together, a byte at a
step, over the first word, then the blank and the second, then the third. Words of over WIDE bytes take the rest of
their bytes one by one, so that one long word costs no steps for all others.

The corpus is read twice: once for the counts (a row for each bucket and task is shuffled), once for the weights. Only the
gains, one number for each bucket, are broadcast. Ranks come from range-partitioned, sorted and stored rows without text.

Edge cases: null and empty texts have no words, no features and weight 0; an empty target or corpus gives gains by the
smoothing alone; rows that repeat are separate candidates with equal scores and distinct ranks; a null id is hashed as
the empty text and loses ties; fewer documents than the share needs for one draw none. Names in `keep` that clash with
the results give way to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_python, lean
from .text import WORD_BYTES, pieces, with_columns

RUN = 3
BUCKETS = 10_000
SCALE = 1000
SHARE = 5
LEAST = 20
SEED = 42
#: Bytes of a word that all starts go through together.
WIDE = 48
#: Words whose states advance together: bounds the arrays for a very long text.
BLOCK = 1 << 18
U32 = np.uint32
#: What a byte is in a word, 0 for bytes that separate words.
CLASS = np.frombuffer(WORD_BYTES.replace(b" ", b"\0"), np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & U32(1), c >> U32(1) ^ U32(0xEDB88320), c >> U32(1))
    return c


CRC = _crc_table()


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classified bytes of all texts, and where each word starts, its size and the number of its text."""
    held = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8)
    size = int(ends[-1] - ends[0])
    low = CLASS[np.frombuffer(data, np.uint8, size, int(ends[0]))] if size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = low > 0
    change = inside[1:] != inside[:-1]
    border = ends[1:-1]
    border = border[(border > 0) & (border < size)]
    border = border[inside[border] & inside[border + 1]]  # a word ends and another starts where two texts touch
    change[border] = False
    at = np.flatnonzero(change)
    starts = np.sort(np.concatenate((at[0::2], border)))
    stops = np.sort(np.concatenate((at[1::2], border)))
    return low, starts, stops - starts, np.searchsorted(ends, starts, side="right") - 1


def advanced(state: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of these words; words come by falling size."""
    state = state.copy()
    most = int(min(WIDE, sizes[0])) if len(sizes) else 0
    longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(most), side="right")
    for k, n in enumerate(longer.tolist()):
        own = state[:n]
        state[:n] = CRC[(own ^ low[starts[:n] + k]) & U32(255)] ^ own >> U32(8)
    for i in range(len(sizes) - int(np.searchsorted(sizes[::-1], WIDE, side="right"))):
        rest = low[starts[i] + WIDE : starts[i] + sizes[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(texts: pa.Array, run: int = RUN, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, CRC-32 values) of the runs of 1, 2, ... `run` words, in blocks."""
    low, starts, sizes, text = word_spans(texts)
    block = block or BLOCK
    for first in range(0, len(starts), block):
        own = slice(first, min(len(starts), first + block + run - 1))  # with the words that runs of this block end in
        begin, size, of = starts[own], sizes[own], text[own]
        n = min(block, len(starts) - first)
        order = np.argsort(-np.minimum(size, 1 << 20), kind="stable")
        order = order[np.argsort(-size[order], kind="stable")] if len(size) and size.max() >= 1 << 20 else order
        state = np.full(n, 0xFFFFFFFF, dtype=U32)
        for j in range(run):
            word = order[(order >= j) & (order < n + j)]
            at = word - j
            held = of[at] == of[word]
            word, at = word[held], at[held]
            past = state[at]
            if j:
                past = CRC[(past ^ U32(32)) & U32(255)] ^ past >> U32(8)
            state[at] = advanced(past, low, begin[word], size[word])
            yield of[at], state[at] ^ U32(0xFFFFFFFF)


def counts(docs: DataFrame, text="text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    @lean
    def tally(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in pieces(batches, text):
            for _, crc in features(b.column(text), run):
                total += np.bincount(crc % U32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    return docs.select(text).transform(in_python, tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, s, t, gain) for every bucket, from the counts of the corpus and of the target."""
    spark = corpus.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    for side, name in ((corpus, "s"), (target, "t")):
        every = every.join(side.select("bucket", F.col("n").alias(name)), "bucket", "left")
    every = cut(every.fillna(0, ["s", "t"]))
    total = every.agg(F.sum("s"), F.sum("t")).first()
    share = lambda n, of: (F.col(n).cast("double") + 1) * F.lit(float(of + buckets))
    return every.withColumn("gain", F.floor(F.lit(float(SCALE)) * F.ln(share("t", total[0]) / share("s", total[1]))))


def weigh(docs: DataFrame, gain: DataFrame, text="text", keep=("doc_id",), run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """The columns of keep with n_words, n_features and weight of each whole text."""
    spark, results = docs.sparkSession, ("n_words", "n_features", "weight")
    keep = [c for c in keep if c not in results]
    by = np.zeros(buckets)
    for row in gain.select("bucket", "gain").collect():  # a row for each bucket
        by[row.bucket] = row.gain
    shipped = spark.sparkContext.broadcast(by)

    @lean
    def total(batches):
        table = shipped.value
        for b in pieces(batches, text):
            words, found = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            weight = np.zeros(b.num_rows)
            for k, (of, crc) in enumerate(features(b.column(text), run)):
                n = np.bincount(of, minlength=b.num_rows)
                words += n if k % run == 0 else 0
                found += n
                weight += np.bincount(of, table[crc % U32(buckets)], b.num_rows)  # whole numbers under 2^53: exact
            yield with_columns(b, keep, {c: pa.array(x.astype(np.int64)) for c, x in zip(results, (words, found, weight), strict=True)})

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in results)])
    return docs.select(*dict.fromkeys([*keep, text])).transform(in_python, total, schema)


def scored(weighed: DataFrame, seed: int = SEED, id_col="doc_id") -> DataFrame:
    """weighed with `score`: the weight plus Gumbel noise that a hash of seed and id gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(float(-SCALE)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(weighed: DataFrame, share: int = SHARE, least: int = LEAST, id_col="doc_id") -> DataFrame:
    """Scored rows with `rank`: 1, 2, ... for the highest scores, `share` percent of the rows with at least that many words; null for others.

    Candidates are range-partitioned by score and id, sorted and stored with their place in their part; a place in the
    whole is that plus the sizes of the parts before, a row for each part.
    """
    rows = cut(weighed.withColumn("_tie", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_tie")]
    parts = cut(rows.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in parts.groupBy(part).count().collect()}  # a row for each part
    before, passed = [], 0
    for k in sorted(sizes):
        before.append((k, passed))
        passed += sizes[k]
    offsets = F.broadcast(parts.sparkSession.createDataFrame(before, "_part long, _before long"))
    n = passed * share // 100
    at = parts.join(offsets, part == F.col("_part")).withColumn("rank", F.col("_before") + place + 1)
    drawn = at.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = rows.where(~able | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).union(rest).drop("_tie")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, all columns as they are."""
    named = cut(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("_row", F.monotonically_increasing_id()))
    where = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, doc_id = where["text"], where["doc_id"]
    gain = gains(counts(named, text), counts(target))
    weighed = weigh(named, gain, text, ("_row", doc_id))
    drawn = draw(scored(weighed, seed, doc_id), share, least, doc_id).where("rank is not null").select("_row")
    return named.join(drawn, "_row", "left_semi").drop("_row").toDF(*docs.columns)
