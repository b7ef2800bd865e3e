"""Language-model scoring by the difference of cross entropies.

Two bigram models share one vocabulary: the background model counts every token of all training documents, the target
model those of the documents that a flag marks. Every word and every pair of neighbours counts, whatever its frequency, so
the models grow with the corpus and nothing of them is collected or broadcast as a whole. Probabilities are
Dirichlet-smoothed: a bigram's by the unigram's, the unigram's by the even one. A document's score is the mean over its
tokens of the difference of losses, background less target: above 0, it reads more like the target.

    loss(b, w) = log(c(b) + MASS) - log(c(b, w) + MASS * p(w)),  p(w) = (c(w) + MASS / size) / (total + MASS)

The first term belongs to b and the second to w, so both can be found where the pairs of one word are together. That gives
this plan, in which texts never move and no pair table is joined:

1. `totals`: counts of words over the corpus (a table in the shared folder), their number and their sum.
2. `_dealt`: each task packs the distinct pairs of about GATHER bytes of texts, with the documents that hold them, into
   one blob for each lane of words. A bucket has the pairs of about BUCKET tokens, so the number of buckets follows the corpus;
   a lane is a bucket while these are few, else the lanes' blobs of many batches are merged and dealt on to buckets.
3. `_answers`: each bucket counts its pairs over all blobs and answers each blob with the sums of losses by document.
4. `_joined`: the answers to a batch of documents meet with the columns to keep, which were packed along.

Words and pairs that a sample of SAMPLE documents or more shows to be hot (over 1 of HOT tokens, or of as many as there are buckets,
so fewer of each than that) are counted in step 1 and broadcast: hot pairs are answered where they stand, other pairs of hot words are dealt by pair
instead of by word. The sample decides where pairs are counted, never what is counted.

Losses are summed as whole multiples of 2^-24, so sums don't depend on the order of rows. Words are told apart by 64-bit
hashes, the words before one by 48 bits. The rows of docs must come in the same order if a task is run again, as those of
a file do; give a stored table (see `flagged`).

Edge cases: null and empty texts have no tokens, null losses and score 0; without target documents both models are the
background's, and every score is 0; repeated rows count each time; texts are read whole; words and pairs that only scored
documents have fall back to the unigram and to the even probability. Columns of keep that have the name of a result give
way to it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import PACKED, by_lane, columns_in, columns_out, gathered, groups, home, lanes_for, narrow, pack, packed_rows, steps, unpack
from .tables import aside, cut, fits, in_python, lean
from .text import raw, words

MASS = 32.0
UNIT = 1 << 24
GATHER = 8 << 20
BUCKET = 1 << 20
SAMPLE = 2000
HOT, MOST_HOT = 2048, 1 << 20
#: Bytes of text for each word, about.
BYTES = 6
#: Numbers in a batch, and hashes, of what stands before the first word and after the last one.
START, END = 0, 1
RESULT = ("n_tokens", "loss_background", "loss_target", "score")
U = np.uint64


def flagged(docs: DataFrame, labels: DataFrame, id_col="doc_id", label="quality", value=1) -> DataFrame:
    """docs with the column _target: true for documents that the labels mark. Stored if the labels are too many to broadcast."""
    named, where = aside(docs)
    marked = cut(labels.where((F.col(label) == value) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id")).distinct())
    few = fits(marked)
    hit = named.join(F.broadcast(marked) if few else marked, F.col(where[id_col]) == F.col("label_id"), "left")
    hit = hit.select(*(F.col(k).alias(c) for c, k in where.items() if c != "_target"), F.col("label_id").isNotNull().alias("_target"))
    return hit if few else cut(hit)


def mix(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    x = (word ^ (before * U(0x9E3779B97F4A7C15))) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(29))) * U(0x94D049BB133111EB)


class Tokens:
    """The words of a batch, numbered in order of appearance."""

    def __init__(self, texts: list[bytes]):
        ids: dict[bytes, int] = defaultdict(count(2).__next__)
        found = []
        for t in texts:
            own = words(t)
            found.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
        self.size = np.array([len(w) for w in found], dtype=np.int64)
        self.word = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.hash = np.array([START, END, *map(xxhash.xxh3_64_intdigest, ids)], dtype=np.uint64)
        #: 48 bits of the hash, for the word before another.
        self.near = self.hash >> U(16)
        self.near[:2] = START, END

    def before(self) -> np.ndarray:
        first = np.cumsum(self.size) - self.size
        out = np.concatenate(([START], self.word[:-1])) if len(self.word) else self.word
        out[first[self.size > 0]] = START
        return out


@dataclass
class Hot:
    """Hot words (hash) and hot pairs (hash of the word, 48 bits of the word before), sorted by their mixed hash; counts once known."""

    words: np.ndarray
    pairs: np.ndarray
    word_n: np.ndarray | None = None
    pair_n: np.ndarray | None = None

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the hot words, or -1."""
        return _places(self.words, hashes)

    def of_pairs(self, word: np.ndarray, near: np.ndarray) -> np.ndarray:
        return _places(mix(self.pairs[:, 0], self.pairs[:, 1]), mix(word, near))


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def hot_ones(docs: DataFrame, text: str) -> Hot:
    """What a sample shows to be hot: fewer than 2 * limit words and limit pairs, where the limit is the number of buckets (HOT at
    least, MOST_HOT at most), so that a word under it fills half a bucket, and the sample has some 16 of a word at the limit."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    limit = min(max(HOT, size // (BYTES * BUCKET)), MOST_HOT)
    share = max(1.2 * SAMPLE / max(n, 1), 32 * limit * BYTES / max(size, 1) if limit > HOT else 0)
    some = docs.select(F.col(text).alias("_text")).sample(min(1.0, share), 7)

    @lean
    def run(batches):
        for b in gathered(batches, "_text", GATHER):
            t = Tokens(raw(b, "_text"))
            code, n = np.unique(t.word << 32 | t.before(), return_counts=True)
            word, near = t.hash[code >> 32], t.near[code & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(near.view(np.int64)), pa.array(n)], ["word", "near", "n"])

    found = cut(some.transform(in_python, run, "word long, near long, n long").groupBy("word", "near").agg(F.sum("n").alias("n")))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = [(r.word, r.near) for r in found.where(F.col("n") * limit > total).collect()]
    single = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * limit > total)
    named = np.array(sorted({r.word for r in single.collect()} | {w for w, _ in pairs}), dtype=np.int64).view(np.uint64)
    two = np.array(pairs, dtype=np.int64).reshape(-1, 2).view(np.uint64)
    return Hot(np.sort(named), two[np.argsort(mix(two[:, 0], two[:, 1]))])


# step 1


@dataclass
class Models:
    """Totals of (background, target) models, the table of word counts, and the hot words and pairs with their counts."""

    words: DataFrame
    total: tuple[int, int]
    starts: tuple[int, int]
    size: int
    hot: Hot

    def numbers(self) -> tuple:
        return self.total, self.starts, self.size, self.hot


def totals(docs: DataFrame, text="text", target="_target", train: str | None = None) -> Models:
    """Counts of all words and of the hot pairs. Documents count where the column train is true (default: all)."""
    own = docs.select(F.col(text).alias("_text"), F.coalesce(F.col(target), F.lit(False)).alias("_target"), *([F.col(train).alias("_train")] if train else []))
    own = own.where("_train").drop("_train") if train else own
    hot = hot_ones(own, "_text")
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    @lean
    def run(batches):
        known = shipped.value
        for b in gathered(batches, "_text", GATHER):
            t = Tokens(raw(b, "_text"))
            flag = b.column("_target").to_numpy(zero_copy_only=False).astype(bool)
            on = flag[t.doc]
            n, n_target = (np.bincount(x, minlength=len(t.hash)) for x in (t.word, t.word[on]))
            n[START], n_target[START] = np.sum(t.size > 0), np.sum(flag & (t.size > 0))
            out = [(t.hash.view(np.int64), np.full(len(n), -1), n, n_target)]
            near = np.flatnonzero(known.of_words(t.hash)[t.word] >= 0)
            place = known.of_pairs(t.hash[t.word[near]], t.near[t.before()[near]])
            near, place = near[place >= 0], place[place >= 0]
            if len(place):
                two = known.pairs.view(np.int64)
                n, n_target = (np.bincount(x, minlength=len(two)) for x in (place, place[on[near]]))
                out.append((two[:, 0], two[:, 1], n, n_target))
            word, near, n, n_target = (np.concatenate(x) for x in zip(*out, strict=True))
            keep = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (word, near, n, n_target)], ["word", "near", "n", "n_target"])

    made = own.transform(in_python, run, "word long, near long, n long, n_target long")
    table = cut(made.groupBy("word", "near").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")))
    whole = table.where("near = -1")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_target")]
    *total, size = whole.where(F.col("word") != START).agg(*sums, F.count("*")).first()
    starts = whole.where(F.col("word") == START).agg(*sums).first()
    listed = docs.sparkSession.createDataFrame([(int(x),) for x in hot.words.view(np.int64)], "word long")
    known = {(r.word, r.near): (r.n, r.n_target) for r in table.join(F.broadcast(listed), "word").collect()}
    hot.word_n = np.array([known.get((w, -1), (0, 0)) for w in hot.words.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 2)
    hot.pair_n = np.array([known.get((w, b), (0, 0)) for w, b in hot.pairs.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 2)
    return Models(whole.select("word", "n", "n_target"), tuple(total), tuple(starts), size + 1, hot)


def losses(pair_n: np.ndarray, word_n: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of -log(c(b, w) + MASS * p(w)), and of log(c(w) + MASS)."""
    p = (word_n + MASS / size) / (total + MASS)
    return np.rint(-np.log(pair_n + MASS * p) * UNIT), np.rint(np.log(word_n + MASS) * UNIT)


# steps 2 to 4


def distinct(word: np.ndarray, near: np.ndarray, doc: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Sorted distinct triples and how often each stands; documents are numbered below 2^16."""
    if words < 1 << 23:  # in one number
        code = word << 40 | near << 16 | doc
        code.sort()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, n = code[first], np.diff(np.append(first, len(code)))
        return code >> 40, code >> 16 & 0xFFFFFF, code & 0xFFFF, n
    order = np.lexsort((doc, near, word))
    word, near, doc = word[order], near[order], doc[order]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (np.diff(word) != 0) | (np.diff(near) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    return word[first], near[first], doc[first], np.diff(np.append(first, len(word)))


def _dealt(docs: DataFrame, models: Models, keep: list[str], buckets: int) -> DataFrame:
    """Blobs of pairs (kind 1) by bucket, and one blob of each batch's kept columns (kind 0)."""
    numbers, lanes = models.numbers(), lanes_for(buckets)
    shipped = docs.sparkSession.sparkContext.broadcast(numbers)

    @lean
    def run(batches):
        from pyspark import TaskContext

        total, starts, size, hot = shipped.value
        part = TaskContext.get().partitionId()
        for k, b in enumerate(gathered(batches, "_text", GATHER)):
            t = Tokens(raw(b, "_text"))
            flag = [b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_train", "_target")]
            batch = part << 32 | k
            last = np.flatnonzero(t.size > 0)
            word = np.concatenate([t.word, t.word[np.cumsum(t.size)[last] - 1]])
            near = np.concatenate([t.before(), np.full(len(last), END)])
            word, near, doc, n = distinct(word, near, np.concatenate([t.doc, last]), len(t.hash))
            # distinct pairs: where they begin, how many documents hold each
            begin = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(near, prepend=-1) != 0))
            held = np.diff(np.append(begin, len(word)))
            word, near = word[begin], near[begin]
            own, before = t.hash[word], t.near[near]
            place = hot.of_words(own)
            spread = place >= 0
            pair = np.where(spread, hot.of_pairs(own, before), -1) if len(hot.pairs) else np.full(len(own), -1)
            sums = np.zeros((2, len(t.size)), dtype=np.int64)
            here = np.flatnonzero(pair >= 0)
            for m in range(2):
                sums[m, last] += int(np.rint(np.log(starts[m] + MASS) * UNIT))
                if len(here):
                    a, c = losses(hot.pair_n[pair[here], m], hot.word_n[place[here], m], total[m], size)
                    value = np.zeros(len(own))
                    value[here] = a + c
                    sums[m] += np.bincount(doc, np.repeat(value, held) * n, len(t.size)).astype(np.int64)
            bucket = (np.where(spread, mix(own, before), own) % U(buckets)).astype(np.int64)
            lane = bucket % lanes
            lane[here] = lanes
            order = np.argsort(lane, kind="stable")
            edges = np.searchsorted(lane[order], np.arange(lanes + 1))
            counts = [np.add.reduceat(n * f[doc], begin) if len(begin) else n for f in (flag[0], flag[0] & flag[1])]
            counts = [np.where(near == END, 0, x) for x in counts]
            rows = []
            for i in range(lanes):
                p = order[edges[i] : edges[i + 1]]
                if not len(p):
                    continue
                at = np.repeat(begin[p], held[p]) + steps(held[p])
                new = np.flatnonzero(np.diff(word[p], prepend=-1))
                group = np.diff(np.append(new, len(p)))
                low = before[p]
                rows.append((1, i, batch, pack(
                    own[p][new], narrow(group), low.astype(np.uint32), (low >> U(32)).astype(np.uint16), narrow(held[p]),
                    narrow(counts[0][p]), narrow(counts[1][p]), doc[at].astype(np.uint16), narrow(n[at]), *([narrow(bucket[p])] if buckets > lanes else []),
                )))
            head = {f"c{j}": b.column(f"k{j}") for j in range(len(keep))} | {"_n": pa.array(t.size), "_b": pa.array(sums[0]), "_t": pa.array(sums[1])}
            yield packed_rows([*rows, (0, home(batch, lanes), batch, batch.to_bytes(8, "little") + columns_in(head))])

    return by_lane(docs.transform(in_python, run, PACKED), _merged, buckets)


def _merged(rows: list[dict]) -> list[tuple]:
    """The blobs of one lane and some batches as one blob for each bucket; documents are numbered by batch (48 bits) and place in it."""
    found = [unpack(r["blob"]) for r in rows]
    word, low, high, held, n, n_target, bucket = (np.concatenate(x) for x in zip(*((np.repeat(x[0], x[1]), x[2], x[3], x[4].astype(np.int64), x[5].astype(np.int64), x[6].astype(np.int64), x[9]) for x in found), strict=True))
    doc = np.concatenate([x[7].astype(np.int64) | r["batch"] << 16 for x, r in zip(found, rows, strict=True)])
    times = np.concatenate([x[8] for x in found])
    begin = np.cumsum(held) - held
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)), len(order))
    out = []
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p = order[first:end]
        at = np.repeat(begin[p], held[p]) + steps(held[p])
        new = np.flatnonzero(np.append(True, np.diff(word[p]) != 0))
        group = np.diff(np.append(new, len(p)))
        out.append((1, int(bucket[p[0]]), rows[0]["set"], pack(word[p][new], narrow(group), low[p], high[p], narrow(held[p]), narrow(n[p]), narrow(n_target[p]), doc[at], times[at])))
    return out


def _answers(dealt: DataFrame, models: Models) -> DataFrame:
    """For each blob of pairs the sums of losses by document; blobs of columns go through."""
    shipped = dealt.sparkSession.sparkContext.broadcast(models.numbers())

    @lean
    def run(batches):
        total, _, size, hot = shipped.value
        for rows in groups(batches, "bucket"):
            out = [(r["kind"], r["bucket"], r["batch"], r["blob"]) for r in rows if not r["kind"]]
            asked = [r for r in rows if r["kind"]]
            bucket, ids = rows[0]["bucket"], [r["batch"] for r in asked]
            found = [unpack(r["blob"]) for r in asked]
            del rows, asked
            if found:
                word = np.concatenate([np.repeat(x[0], x[1]) for x in found])
                before = np.concatenate([x[2].astype(np.uint64) | x[3].astype(np.uint64) << U(32) for x in found])
                n = [np.concatenate([x[c] for x in found]).astype(np.float64) for c in (5, 6)]
                place = hot.of_words(word)
                _, at = np.unique(word, return_inverse=True)
                word_n = [np.where(place >= 0, hot.word_n[place, m] if len(hot.words) else 0, np.bincount(at, n[m])[at]) for m in range(2)]
                _, at = np.unique(mix(word, before), return_inverse=True)
                pair_n = [np.bincount(at, n[m])[at] for m in range(2)]
                del at, word, place, n
                value = []
                for m in range(2):
                    a, c = losses(pair_n[m], word_n[m], total[m], size)
                    value.append(np.where(before == END, -c, a + c))
                del pair_n, word_n, before
                start = 0
                for batch, x in zip(ids, found, strict=True):
                    own = slice(start, start + len(x[2]))
                    start = own.stop
                    docs, at = np.unique(x[7], return_inverse=True)
                    sums = [np.bincount(at, np.repeat(v[own], x[4]) * x[8]).astype(np.int64) for v in value]
                    out.append((2, bucket, batch, pack(docs, *sums)))
            yield packed_rows(out)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").transform(in_python, run, PACKED)


def _joined(answers: DataFrame, schema: str, names: list[str]) -> DataFrame:
    @lean
    def run(batches):
        for rows in groups(batches, "batch"):
            held: dict[int, list] = {}
            for r in rows:
                if not r["kind"]:
                    *kept, n, background, target = columns_out(r["blob"][8:]).columns
                    held[int.from_bytes(r["blob"][:8], "little")] = [kept, n, background.to_numpy().copy(), target.to_numpy().copy()]
                    continue
                docs, *more = unpack(r["blob"])
                if docs.dtype != np.int64:  # of one batch
                    for s, x in zip(held[r["batch"]][2:], more, strict=True):
                        s[docs] += x
                    continue
                cuts = np.append(np.flatnonzero(np.diff(docs >> 16, prepend=-1)), len(docs))
                for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = docs[first:end]
                    for s, x in zip(held[int(own[0]) >> 16][2:], more, strict=True):
                        s[own & 0xFFFF] += x[first:end]
            for kept, n, *sums in held.values():
                none, many = n.to_numpy() == 0, np.maximum(n.to_numpy(), 1)
                mean = [s / many / UNIT for s in sums]
                out = [*kept, n, *(pa.array(x, pa.float64(), mask=none) for x in mean), pa.array((sums[0] - sums[1]) / many / UNIT)]
                yield pa.RecordBatch.from_arrays(out, names)

    return answers.repartition("batch").sortWithinPartitions("batch", "kind").transform(in_python, run, schema)


def score(docs: DataFrame, models: Models, text="text", target="_target", train: str | None = None, keep=("doc_id",)) -> DataFrame:
    """The columns of keep with n_tokens, loss_background, loss_target (nats a token) and score.

    docs: the documents that `totals` counted (with the same flags), and any others where the column train is false.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in RESULT]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, loss_background double, loss_target double, score double"])
    own = docs.select(
        *(F.col(c).alias(f"k{j}") for j, c in enumerate(keep)), F.col(text).alias("_text"),
        (F.coalesce(F.col(train), F.lit(False)) if train else F.lit(True)).alias("_train"), F.coalesce(F.col(target), F.lit(False)).alias("_target"),
    )
    if not models.total[1]:  # no target documents: both models are the background's
        own = own.withColumn("_target", F.lit(True))
        hot = models.hot
        hot = Hot(hot.words, hot.pairs, hot.word_n[:, [0, 0]], hot.pair_n[:, [0, 0]])
        models = Models(models.words, models.total[:1] * 2, models.starts[:1] * 2, models.size, hot)
    buckets = max(1, -(-models.total[0] // BUCKET))
    return _joined(_answers(_dealt(own, models, keep, buckets), models), schema, [*keep, *RESULT])
