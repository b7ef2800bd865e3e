"""N-gram Jaccard join by chosen paths.

A text's set holds its shingles of `width` words. Texts with equal sets are one node from the start. Each set is embedded
as SKETCH minhash tokens. A run splits sets recursively: at a path, a token is followed if the hash of path and token is
under a threshold, so that a set follows FAN tokens on average and two sets of similarity s share FAN * s of them. Sets
that share a path of DEPTH tokens meet in its bucket. A bucket over BUCKET members is split by further tokens; one that
stays large after SPLITS splits, because its members are alike, is compared block by block. As many runs are made as the
target recall of a pair at the threshold needs (see runs_for). Inside buckets sketches are compared, and only a spanning
forest of the likely pairs goes on. The components of these links are then compared set by set, exactly and wholly: that
gives each text's number of links, and the classes are the components of exact links. A component of more than BLOCK
sets or BYTES bytes is first split by size: sets whose sizes differ by more than the threshold allows never meet, and the
others meet in pairs of blocks of at most BLOCK sets and about BYTES bytes.

So no pair lists are ever made: each block gives its members one number and one link. A pair is missed only if no chain
of likely pairs leads from one to the other.

Edge cases: a text of fewer than `width` words is one shingle; a null or empty text has no shingles, no links and its
own class; classes are named by their smallest id (nulls last), of any type that orders; repeated rows give equal rows and
count as copies. Nodes are told apart by a 64-bit digest of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import aside, cut, id_type, in_python, lean, small
from .text import Cache, hashes, pieces, raw, with_columns, word_hashes, words

WIDTH = 5
THRESHOLD = 0.8
SKETCH = 128
FAN = 2.0
DEPTH = 3
RECALL = 0.998
BUCKET = 1000
SPLITS = 3
BLOCK = 256
BYTES = 4 << 20
#: Sketches differ from the sets' similarity by chance (standard deviation 0.035): pairs are likely from threshold - SLACK on.
SLACK = 0.2
U = np.uint64
DIGEST = "_set_digest"
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
FLIP = _rng.integers(1, 1 << 32, SKETCH, dtype=np.uint32)
STEPS = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(found: list[bytes], cache: Cache, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles."""
    ids = hashes(found, cache)
    n = min(width, len(ids))
    if not n:
        return ids
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + len(h)]) * STEPS[k % 8]
        h ^= h >> U(32)
    return np.unique(mix(h + U(n)))


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH minhashes of a set, of which one byte each is kept."""
    low = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    h = (found >> U(32)).astype(np.uint32)
    for k in range(0, len(h), 1024):
        np.minimum(low, ((h[k : k + 1024, None] ^ FLIP) * MULTIPLY).min(0), out=low)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def tokens(sketches: np.ndarray) -> np.ndarray:
    """Hashed (position, byte) tokens."""
    return mix(sketches.astype(np.uint64) + (np.arange(SKETCH, dtype=np.uint64) << U(8)) + U(1 << 40))


LIMIT = U(int(FAN / SKETCH * 2**64))


def follow(paths: np.ndarray, own: np.ndarray, depth: int) -> np.ndarray:
    """Paths of a set that are `depth` tokens longer."""
    for _ in range(depth):
        h = mix(paths[:, None] ^ own[None, :])
        paths = mix(h[h < LIMIT])
    return np.unique(paths)


def meeting(similarity: float, depth: int = DEPTH) -> float:
    """Chance that two sets share a path in one run (a branching process of mean FAN * similarity)."""
    die = 0.0
    for _ in range(depth):
        die = math.exp(-FAN * similarity * (1 - die))
    return 1 - die


def runs_for(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs that find a pair at the threshold (less one and a half deviations of its sketch) with that chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting(threshold - 0.05))))


def profiles(docs: DataFrame, width: int = WIDTH, id_col="doc_id", text="text") -> DataFrame:
    """(id, v, n, sketch) for each row: v is the digest of the set, n its size; null without words."""
    kind = id_type(docs, id_col)

    @lean
    def run(batches):
        cache = word_hashes()
        for b in pieces(batches, text):
            v, n, s = [], [], []
            for t in raw(b, text):
                own = shingles(words(t), cache, width)
                v.append(_digest(own) if len(own) else None)
                n.append(len(own) or None)
                s.append(sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], ["id", "v", "n", "sketch"])

    return docs.select(F.col(id_col).cast(kind).alias(id_col), text).transform(in_python, run, f"id {kind.simpleString()}, v long, n long, sketch binary")


def _digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _paths(nodes: DataFrame, depth: int, start: int | None) -> DataFrame:
    """(node, v): paths from `start` runs, or further ones from the column node."""

    @lean
    def run(batches):
        for b in batches:
            own = tokens(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH))
            at = b.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if start is None else None
            first = mix(np.arange(1, (start or 0) + 1, dtype=np.uint64))
            found = [follow(first if at is None else at[i : i + 1], own[i], depth) for i in range(b.num_rows)]
            size = [len(x) for x in found]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            v = np.repeat(b.column("v").to_numpy(zero_copy_only=False), size)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(v)], ["node", "v"])

    return nodes.transform(in_python, run, "node long, v long")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches that share their first n_keys values."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield rows


def likely(sketches: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the components of likely pairs: the first member of each. Members that are already together aren't compared again."""
    need = math.ceil(SKETCH * (threshold - SLACK + (1 - threshold + SLACK) / 256))
    label = np.arange(len(sketches))
    for i in range(len(sketches) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(rest):
            hit = rest[(sketches[rest] == sketches[i]).sum(1) >= need]
            if len(hit):
                both = np.append(label[hit], label[i])
                label[np.isin(label, both)] = both.min()
    return label


def _blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Each row once for each pair of blocks that its own block is part of; groups of up to `block` members have one block."""
    parts = rows.withColumn("parts", F.ceil(F.col(size) / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return parts.withColumn("other", other).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that span the likely pairs of all buckets."""
    members = cut(_paths(reps.select("v", "sketch"), DEPTH, runs_for(threshold, recall)))
    ready = None
    for step in range(SPLITS + 1):
        sizes = cut(members.groupBy("node").agg(F.count("*").alias("size")).where("size >= 2"))
        last = step == SPLITS or not sizes.where(F.col("size") > BUCKET).limit(1).count()
        # Always shuffled: the sizes grow with the corpus, and a broadcast of a million of them costs each executor 500 MB.
        now = members.join((sizes if last else sizes.where(F.col("size") <= BUCKET)).hint("merge"), "node").select("node", "v", "size")
        ready = now if ready is None else ready.union(now)
        if last:
            break
        large = members.join(small(sizes.where(F.col("size") > BUCKET).select("node")), "node").join(reps.select("v", "sketch"), "v")
        members = cut(_paths(large.select("node", "v", "sketch"), 1, None))
    dealt = _blocked(cut(ready).join(reps.select("v", "sketch"), "v"), "node", "size", BUCKET)
    dealt = dealt.select("node", "lo", "hi", "v", "sketch").repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "v")

    # Members come in order of v, so links lead to the smallest: the buckets of a large group agree on few roots.
    @lean
    def run(batches):
        a, b = [], []
        for rows in groups(batches, 3):
            label = likely(np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SKETCH), threshold)
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                a.append(rows[i][3])
                b.append(rows[label[i]][3])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.transform(in_python, run, "a long, b long").where("a <> b").distinct()


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of pairs whose Jaccard similarity reaches the threshold, by exact intersections."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2, dtype=np.float64)
        both = np.array([[0, both[0, 1]], [both[0, 1], 0]])
    else:
        _, inv, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        shared = n[inv] >= 2
        number = np.cumsum(n >= 2) - 1
        row, col = row[shared], number[inv[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((m, m), dtype=np.float64)
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            own = slice(*np.searchsorted(col, [start, start + 4096]))
            x = np.zeros((m, 4096), dtype=np.float32)
            x[row[own], col[own] - start] = 1
            both += x @ x.T
    out = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
    np.fill_diagonal(out, False)
    return out


def cells(chosen: DataFrame, threshold: float) -> DataFrame:
    """chosen with its cell (k, part), parts (1 for whole components) and the parts of the next lower and higher sizes."""
    size = F.sum("n") * 8
    whole = cut(chosen.groupBy("comp").agg(((F.count("*") <= BLOCK) & (size <= BYTES)).alias("whole")))
    step = F.floor(F.log("n") / -math.log(threshold) + 1e-9).cast("int")
    rows = cut(chosen.join(whole, "comp").withColumn("k", F.when(F.col("whole"), F.lit(0)).otherwise(step)))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(size / BYTES)).cast("int")
    by = cut(rows.where(~F.col("whole")).groupBy("comp", "k").agg(parts.alias("parts")))
    for name, shift in (("parts", 0), ("lower", 1), ("higher", -1)):
        side = by.select(F.col("comp").alias("_c"), (F.col("k") + shift).alias("_k"), F.col("parts").alias(name))
        rows = rows.join(small(side), (F.col("comp") == F.col("_c")) & (F.col("k") == F.col("_k")), "left").drop("_c", "_k")
    rows = rows.withColumns({"parts": F.when(F.col("whole"), F.lit(1)).otherwise(F.col("parts"))})
    return rows.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))


def _meetings(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of cells that its own cell is part of: (ka, pa, kb, pb), and whether it is in the second one."""
    own, upto = F.struct(F.col("k"), F.col("part").alias("p")), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    none = F.expr("cast(array() as array<struct<a:struct<k:int,p:int>,b:struct<k:int,p:int>,second:boolean>>)")
    pair = lambda a, b, second: F.struct(a.alias("a"), b.alias("b"), second.alias("second"))
    cell = lambda k, p: F.struct(k.alias("k"), p.alias("p"))
    same = F.transform(upto("parts"), lambda o: pair(cell(F.col("k"), F.least(o, F.col("part"))), cell(F.col("k"), F.greatest(o, F.col("part"))), o < F.col("part")))
    higher = F.when(F.col("higher").isNull(), none).otherwise(F.transform(upto("higher"), lambda o: pair(own, cell(F.col("k") + 1, o), F.lit(False))))
    lower = F.when(F.col("lower").isNull(), none).otherwise(F.transform(upto("lower"), lambda o: pair(cell(F.col("k") - 1, o), own, F.lit(True))))
    return rows.withColumn("_m", F.explode(F.concat(same, higher, lower))).select("*", "_m.*").drop("_m")


def exact_links(docs: DataFrame, chosen: DataFrame, width: int, threshold: float, id_col="doc_id", text="text") -> DataFrame:
    """(v, links, root, split) from each block: weighted number of links, and a node that the links lead to.

    chosen: (v, id, copies, n, comp), one document for each node.
    """
    dealt_to = cut(cells(chosen, threshold))
    picked = docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("_id"), F.col(text).alias("_text")).join(small(dealt_to), F.col("_id").eqNullSafe(F.col("id")))
    keep = ["v", "copies", "comp", "k", "part", "parts", "lower", "higher", "whole"]

    @lean
    def sets(batches):
        cache = word_hashes()
        for b in pieces(batches, "_text", 2 << 20):
            own = [shingles(words(t), cache, width) for t in raw(b, "_text")]
            v = b.column("v").to_pylist()
            held = pa.array([len(s) > 0 and _digest(s) == x for s, x in zip(own, v, strict=True)])
            yield with_columns(b, keep, {"own": pa.array([s.tobytes() for s in own], pa.binary())}).filter(held)

    whole = picked.transform(in_python, sets, "v long, copies long, comp long, k int, part int, parts int, lower int, higher int, whole boolean, own binary")
    key = [F.col(c) for c in ("comp", "a", "b")]
    dealt = _meetings(whole).select(*key, "v", "second", F.col("whole"), "copies", "own").repartition(*key).sortWithinPartitions(*key, "v")
    dealt = dealt.select("comp", F.col("a.k").alias("ka"), F.col("a.p").alias("pa"), F.col("b.k").alias("kb"), F.col("b.p").alias("pb"), "v", "second", "whole", "copies", "own")

    @lean
    def compare(batches):
        for found in groups(batches, 5):
            rows = [r for i, r in enumerate(found) if not i or r[5] != found[i - 1][5]]
            if len(rows) < 2:
                continue
            pair = alike([np.frombuffer(r[9], np.uint64) for r in rows], threshold)
            if rows[0][1:3] != rows[0][3:5]:
                second = np.array([r[6] for r in rows])
                pair &= second[:, None] != second[None, :]
            links = pair @ np.array([r[8] for r in rows], dtype=np.float64)
            label = np.arange(len(rows))
            for i in range(len(rows)):
                hit = np.flatnonzero(pair[i])
                if len(hit):
                    merged = np.isin(label, np.append(label[hit], label[i]))
                    label[merged] = label[merged].min()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[5] for r in rows], pa.int64()), pa.array(links.astype(np.int64)), pa.array([rows[k][5] for k in label.tolist()], pa.int64()), pa.array([not r[7] for r in rows], pa.bool_())],
                ["v", "links", "root", "split"],
            )

    return dealt.transform(in_python, compare, "v long, links long, root long, split boolean")


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, id_col="doc_id", text="text") -> DataFrame:
    """(id, class_id, n_links) for each row: the smallest id of its class, and the number of other rows that are similar."""
    rows = cut(profiles(docs, width, id_col, text))
    reps = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    likely_in = cut(components(candidate_links(reps, threshold, recall)))
    chosen = cut(likely_in.join(reps.select("v", "id", "copies", "n"), "v").select("v", "id", "copies", "n", F.col("label").alias("comp")))
    blocks = cut(exact_links(docs, chosen, width, threshold, id_col, text))
    links = blocks.groupBy("v").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    spread = blocks.where("split")
    if spread.limit(1).count():
        named = components(spread.select(F.col("v").alias("a"), F.col("root").alias("b")))
        links = links.join(named.withColumnRenamed("label", "joined"), "v", "left").withColumn("root", F.coalesce("joined", "root"))
    nodes = reps.select("v", "id", "copies").join(links.select("v", "links", "root"), "v", "left").select("v", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "v").alias("root"))
    nodes = cut(nodes)
    names = nodes.groupBy("root").agg(F.min("id").alias("class_id"))
    found = cut(nodes.join(names, "root").select("v", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    out = rows.select("id", "v").join(found, "v", "left")
    return out.select(
        "id", "v", F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those whose class has a smaller id; all columns stay as they are, whatever their names.

    Rows without an id and texts without words stay. Of rows that repeat an id and a set of shingles the one with the
    smallest hash of its columns stays; an id that stands for several sets loses only those whose class has a smaller id.
    """
    named, where = aside(docs)
    doc_id, text = where["doc_id"], where["text"]
    found = cut(classes(named, width, threshold, id_col=doc_id, text=text))
    gone = cut(found.where("id <> class_id").select(F.col("id").alias("gone_id"), "v").distinct())
    same_id = F.col(doc_id).cast(id_type(named, doc_id)) == F.col("gone_id")
    if not found.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        return named.join(small(gone.select("gone_id")), same_id, "left_anti").toDF(*docs.columns)
    own = cut(_with_digest(named, width, text))
    single = F.col(doc_id).isNull() | F.col(DIGEST).isNull()
    hashed = F.xxhash64(*(F.col(f.name) for f in named.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)))
    first = own.where(~single).groupBy(doc_id, DIGEST).agg(F.min_by(F.struct(*named.columns), hashed).alias("first"))
    own = own.where(single).select(*named.columns, DIGEST).union(first.select(*(F.col("first")[c].alias(c) for c in named.columns), DIGEST))
    return own.join(small(gone), same_id & (F.col(DIGEST) == F.col("v")), "left_anti").select(*named.columns).toDF(*docs.columns)


def _with_digest(docs: DataFrame, width: int, text="text") -> DataFrame:
    """docs with the digest of each text's set in the column DIGEST."""

    @lean
    def run(batches):
        cache = word_hashes()
        for b in pieces(batches, text):
            own = [shingles(words(t), cache, width) for t in raw(b, text)]
            yield with_columns(b, names, {DIGEST: pa.array([_digest(s) if len(s) else None for s in own], pa.int64())})

    names = docs.columns
    return docs.transform(in_python, run, T.StructType([*docs.schema.fields, T.StructField(DIGEST, T.LongType())]))
