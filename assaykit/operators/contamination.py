"""Known passages inside texts, and canary tokens in runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import canary_form_any, canary_plain
from ..sources.scratch import ship, stored

#: Bytes of a passage that stand for it; a shorter passage stands for itself.
GRAM = 16
#: Places of the table of bits that is broadcast, whatever the passages: 2 MB.
BITS = 24
#: Documents with candidates are broadcast up to so many; beyond it the texts are shuffled to them.
CANDIDATES = 200_000
U = np.uint64


def grams(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each k (up to 16) consecutive bytes as two numbers, which are equal only for equal bytes."""
    x = np.frombuffer(data, np.uint8)
    n = max(0, len(x) - k + 1)
    if k == GRAM and n:
        w = x.astype(U)
        for step in (1, 2, 4):
            w = w[:-step] << U(8 * step) | w[step:]
        return w[:n], w[8 : 8 + n]
    a, b = np.zeros(n, U), np.zeros(n, U)
    for j in range(k):
        own = a if j < 8 else b
        own <<= U(8)
        own |= x[j : j + n]
    return a, b


def slots(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of grams, whose highest bits are places in the table."""
    h = (a ^ b * U(0x9E3779B97F4A7C15) ^ U(k)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(29)) * U(0x94D049BB133111EB)
    return h ^ h >> U(32)


def _marked(passages: DataFrame) -> DataFrame:
    """(k, a, b, slot, off, size, digest) of each distinct passage: the gram that stands for it, where it stands in it, and a digest of the whole."""

    def run(batches):
        for batch in batches:
            rows = []
            for c in batch.column("c").cast(pa.binary()).to_pylist():
                k = min(len(c), GRAM)
                a, b = grams(c, k)
                h = slots(a, b, k)
                at = int(h.argmax())
                rows.append((k, int(a[at].astype(np.int64)), int(b[at].astype(np.int64)), int(h[at] >> U(64 - BITS)), at, len(c), hashlib.md5(c).digest()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["k", "a", "b", "slot", "off", "size", "digest"])

    return passages.mapInArrow(run, "k int, a long, b long, slot int, off int, size int, digest binary")


def passages_in(texts: DataFrame, passages: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(doc_id, item_id) where text c of a document contains text c of a passage, both in canary form.

    A passage stands for itself by one gram of 16 bytes (or itself, if it is shorter). A table of bits, of the same size
    for any number of passages, tells which places of a text can be such a gram; these few are joined with the grams by
    their bytes. Candidates for longer passages are then compared with the text by size and digest. Each text is read once, and
    once more if any passage is a candidate. Empty passages are found nowhere; passages of the same text are one until the
    end. Column types are those of the inputs; rows that repeat a document give rows each.
    """
    spark = texts.sparkSession
    ship(spark)
    items = passages.select("item_id", "c").where("c <> ''")
    known = stored(_marked(items.select("c").distinct()))
    word = F.col("slot").bitwiseAND(63)
    held = known.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), word)).alias("bits")).collect()  # 2^18 rows at most
    table = np.zeros(1 << BITS - 6, U)
    for r in held:
        table[r.w] = U(r.bits & (1 << 64) - 1)
    classes = [r.k for r in known.select("k").distinct().collect()]  # 16 at most
    shipped = spark.sparkContext.broadcast((table, sorted(classes)))
    kind = texts.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def places(batches):
        bits, sizes = shipped.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, c in enumerate(batch.column("c").cast(pa.binary()).to_pylist()):
                for k in sizes if c else ():
                    a, b = grams(c, k)
                    at = slots(a, b, k) >> U(64 - BITS)
                    hit = np.flatnonzero(bits[at >> U(6)] >> (at & U(63)) & U(1))
                    if not len(hit):
                        continue
                    if k < GRAM:  # where it stands doesn't matter
                        hit = hit[np.unique(np.stack((a[hit], b[hit])), axis=1, return_index=True)[1]]
                    for column, x in zip(out, (np.full(len(hit), row), np.full(len(hit), k), a[hit].view(np.int64), b[hit].view(np.int64), hit), strict=True):
                        column.append(x)
            rows, ks, a, b, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(ks, pa.int32()), pa.array(a), pa.array(b), pa.array(at, pa.int32())], ["doc_id", "k", "a", "b", "at"])

    own = texts.select("doc_id", "c").where("c is not null")
    found = stored(own.mapInArrow(places, f"doc_id {kind.simpleString()}, k int, a long, b long, at int").join(known.drop("slot"), ["k", "a", "b"]))
    sure = found.where(F.col("k") < GRAM).select("doc_id", "digest")
    open_ = found.where(F.col("k") == GRAM).select("doc_id", (F.col("at") - F.col("off")).alias("start"), "size", "digest").where("start >= 0")
    listed = stored(open_.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size", "digest")).alias("places")))
    few = listed.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= most
    listed = listed.select(F.col("doc_id").alias("of"), "places")

    def compare(batches):
        for batch in batches:
            rows, digests = [], []
            for row, (c, asked) in enumerate(zip(batch.column("c").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), strict=True)):
                for digest in {p["digest"] for p in asked if p["start"] + p["size"] <= len(c) and hashlib.md5(c[p["start"] : p["start"] + p["size"]]).digest() == p["digest"]}:
                    rows.append(row)
                    digests.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())).cast(arrow), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    asked = own.join(F.broadcast(listed) if few else listed, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "c", "places")
    compared = asked.mapInArrow(compare, f"doc_id {kind.simpleString()}, digest binary")
    named = items.select("item_id", F.unhex(F.md5("c")).alias("digest"))
    return sure.union(compared).join(named, "digest").select("doc_id", "item_id")


def scan_run(results: DataFrame, token: str) -> DataFrame:
    """Canary hits, cases that a judge flagged otherwise, and the verdict. results: canary (text in canary form), judge_flag."""
    hit = F.contains("canary", F.lit(canary_plain(token))) if token else F.lit(False)
    sums = results.agg(F.count_if(hit).alias("canary_hits"), F.count_if(~hit & F.col("judge_flag")).alias("judge_flagged"))
    return sums.withColumn("verdict", F.when(F.col("canary_hits") > 0, "contaminated").when(F.col("judge_flagged") > 0, "suspicious").otherwise("clean"))


def scan_runs(results: DataFrame, token: str | None = None) -> DataFrame:
    """(run, canary_hits, judge_flagged, suspicious, verdict) of each run. results: run, case_id, html, token (the run's own, or null), judge_failures (array of maps).

    `token` takes the place of the runs' own. Outputs and tokens are compared in canary form, so blanks, case, invisible
    characters and look-alike code points don't hide one; a case counts as flagged only where no token was found.
    """
    given = F.lit(token) if token else F.col("token")
    rows = results.select("run", "case_id", canary_form_any("html").alias("text"), canary_form_any(given).alias("token"), "judge_failures")
    hit = F.coalesce((F.col("token") != "") & F.contains("text", "token"), F.lit(False))
    flagged = ~hit & F.exists("judge_failures", lambda f: F.lower(f["issue"]).contains("contamination"))
    rows = rows.select("run", "case_id", hit.alias("hit"), F.coalesce(flagged, F.lit(False)).alias("flagged"))
    sums = rows.groupBy("run").agg(F.count_if("hit").alias("canary_hits"), F.count_if("flagged").alias("judge_flagged"), F.array_sort(F.collect_list(F.when(F.col("hit") | F.col("flagged"), F.col("case_id")))).alias("suspicious"))
    return sums.withColumn("verdict", F.when(F.col("canary_hits") > 0, "contaminated").when(F.col("judge_flagged") > 0, "suspicious").otherwise("clean"))
