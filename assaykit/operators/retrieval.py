"""Retrieval metrics from ranked lists and graded relevance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import ship, stored

CUTS = (1, 3, 5, 10)
#: Queries that are broadcast at once: some MB of vectors.
BLOCK = 4096
#: Products that a task holds at once, pairs that it computes anew at once, and how far products may be off.
SLICE, PAIRS, MARGIN = 1 << 22, 1 << 16, 3e-9


def distinct_ranks(retrieved: DataFrame) -> DataFrame:
    """retrieved (query, doc, pos) without repeated documents (the first place counts), ranked from 1."""
    once = retrieved.groupBy("query", "doc").agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos", "doc"))).drop("pos")


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank.cast("double") + 1)


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked with rel; documents that aren't judged have 0."""
    return ranked.join(qrels.select("query", "doc", "rel"), ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ideal(qrels: DataFrame) -> DataFrame:
    """Ideal gains over all judged documents of a query at each cut, and the number of relevant ones."""
    best = qrels.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "doc")))
    return best.groupBy("query").agg(F.count_if(F.col("rel") >= 1).alias("relevant"), *(F.sum(F.when(F.col("k") <= c, gain(F.col("rel"), F.col("k"))).otherwise(0.0)).alias(f"idcg_{c}") for c in CUTS))


def ideal_of_counts(counts: DataFrame) -> DataFrame:
    """ideal() where relevance is 0 or 1: counts (query, relevant) say how many documents are relevant."""
    steps = [0.0]
    import math

    for k in range(1, max(CUTS) + 1):
        steps.append(steps[-1] + 1.0 / math.log2(k + 1))
    table = F.array(*map(F.lit, steps))
    return counts.select("query", "relevant", *(F.get(table, F.least(F.col("relevant"), F.lit(c)).cast("int")).alias(f"idcg_{c}") for c in CUTS))


def metrics(ranked_rel: DataFrame, qrels: DataFrame) -> DataFrame:
    return rated(ranked_rel, ideal(qrels))


def rated(ranked_rel: DataFrame, ideals: DataFrame) -> DataFrame:
    """precision, recall and ndcg at the cuts that the list reaches, mrr, and the composite score.

    Recall without relevant documents is 1, ndcg without ideal gain 0; the composite takes the cut 5 (or the list's length).
    """
    hit = F.col("rel") >= 1
    seen = ranked_rel.groupBy("query").agg(
        F.max("rank").alias("n"), F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        *(F.count_if(hit & (F.col("rank") <= c)).alias(f"found_{c}") for c in CUTS),
        *(F.sum(F.when(F.col("rank") <= c, gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{c}") for c in CUTS),
    )
    both = seen.join(ideals, "query", "left").fillna(0)
    p = lambda c: F.col(f"found_{c}") / F.least(F.lit(c), F.col("n"))
    r = lambda c: F.when(F.col("relevant") == 0, 1.0).otherwise(F.col(f"found_{c}") / F.col("relevant"))
    g = lambda c: F.when(F.col(f"idcg_{c}") == 0, 0.0).otherwise(F.col(f"dcg_{c}") / F.col(f"idcg_{c}"))
    shown = lambda name, f: [F.when(F.col("n") >= c, F.round(f(c), 6)).alias(f"{name}_{c}") for c in CUTS]
    score = F.least(F.lit(100.0), F.floor(F.round(r(5) * 40 + p(5) * 20 + g(5) * 25 + F.col("mrr") * 15, 6) + 0.5).cast("double"))
    return both.select("query", "n", "relevant", F.round("mrr", 6).alias("mrr"), *shown("precision", p), *shown("recall", r), *shown("ndcg", g), score.alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, doc, pos): the k most similar other vectors of each query by cosine (null or zero vectors last), ties to smaller doc.

    A stated query set against all rows, in blocks: up to BLOCK queries go to the tasks at once, so the rows are read once for
    each block. A task multiplies a slice of rows with the block; what comes within MARGIN of a query's k-th best so far is
    computed anew, in order of the dimensions. Each task keeps its own best k before they are shuffled.
    """
    spark = queries.sparkSession
    ship(spark)
    queries = stored(queries.select("id", "v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        part = _near(vectors.select("id", "v"), spark.sparkContext.broadcast(some), k, queries.schema["id"].dataType.simpleString())
        found = part if found is None else found.union(part)
    best = found.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "doc"))).where(F.col("pos") <= k)
    return best.select("query", "doc", "pos")


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles (nulls as zeros) and their norms, summed in order of the dimensions."""
    rows = [x if x is not None and None not in x else [] for x in column.to_pylist()]
    width = max(map(len, rows), default=0)
    if any(len(x) not in (0, width) for x in rows):
        raise ValueError("vectors of different length")
    v = np.array([x or [0.0] * width for x in rows], dtype=np.float64).reshape(len(rows), width)
    return v, np.sqrt(_dots(v, v))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order of the dimensions: the product of matrices may sum in another one."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _near(vectors: DataFrame, block, k: int, id_type: str) -> DataFrame:
    """(query, doc, sim): of each task, all rows that may be among the k best of the block's queries."""

    def run(batches):
        q_ids = np.array(block.value.column("id").to_pylist(), dtype=object)
        if not len(q_ids):
            return
        qv, qn = _matrix(block.value.column("v"))
        unit = qv / np.where(qn > 0, qn, 1.0)[:, None]
        least = np.full(len(q_ids), -np.inf)
        held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=object), np.empty(0))

        def kept(at, docs, sims):
            """The k best of each query by rounded value and doc, and what the rounding leaves in doubt; raises the queries' marks."""
            scaled = np.where(np.isnan(sims), -np.inf, sims) * 1e9
            digits = np.floor(scaled + 0.5)
            doubt = np.abs(np.where(np.isinf(scaled), 0.0, scaled - np.floor(np.where(np.isinf(scaled), 0.0, scaled))) - 0.5) < 1e-3
            # What is in doubt is set aside and takes no place of the others.
            sure = np.flatnonzero(~doubt)
            order = sure[np.lexsort((np.unique(docs, return_inverse=True)[1][sure], -digits[sure], at[sure]))]
            rank = np.arange(len(order)) - np.searchsorted(at[order], at[order], side="left")
            kth = order[rank == k - 1]
            least[at[kth]] = np.maximum(least[at[kth]], np.where(np.isnan(sims[kth]), -2.0, sims[kth]) - MARGIN)
            keep = np.concatenate([order[rank < k], np.flatnonzero(doubt & (sims >= least[at]))])
            return at[keep], docs[keep], sims[keep]

        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            v, n = _matrix(batch.column("v"))
            if v.shape[1] not in (0, qv.shape[1]) and qv.shape[1]:
                raise ValueError("vectors of different length")
            width = max(1, SLICE // len(q_ids))
            for s in range(0, len(ids), width):
                e = min(s + width, len(ids))
                own, norm = v[s:e], n[s:e]
                if own.shape[1] and qv.shape[1]:
                    sims = (own / np.where(norm > 0, norm, 1.0)[:, None]) @ unit.T
                    sims[norm == 0] = -2.0
                    sims[:, qn == 0] = -2.0
                else:
                    sims = np.full((e - s, len(q_ids)), -2.0)
                # The query itself may be among the rows, as often as an id occurs.
                place = e - s - k - int(np.unique(ids[s:e], return_counts=True)[1].max()) if np.isinf(least).any() else -1
                if place >= 0:
                    np.maximum(least, np.partition(sims, place, axis=0)[place] - MARGIN, out=least)
                row, at = np.nonzero(sims >= least)
                other = ids[s + row] != q_ids[at]
                row, at = row[other], at[other]
                for c in range(0, len(row), PAIRS):
                    r, a = row[c : c + PAIRS], at[c : c + PAIRS]
                    scale = qn[a] * norm[r]
                    exact = np.full(len(r), np.nan)
                    some = scale > 0
                    exact[some] = _dots(qv[a[some]], own[r[some]]) / scale[some]
                    held = tuple(np.concatenate(x) for x in zip(held, (a, ids[s + r], exact), strict=True))
                    if len(held[0]) > max(PAIRS, 4 * k * len(q_ids)):
                        held = kept(*held)
        if len(held[0]):
            at, docs, sims = kept(*held)
            kind = block.value.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(list(q_ids[at]), kind), pa.array(list(docs), kind), pa.array(sims, pa.float64(), from_pandas=True)], ["query", "doc", "sim"])

    rows = vectors.mapInArrow(run, f"query {id_type}, doc {id_type}, sim double")
    return rows.select("query", "doc", F.round("sim", 9).alias("sim"))
