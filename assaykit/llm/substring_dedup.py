"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each step shifts it by one bit and adds a fixed random number for the byte,
so it depends on the last 16 bytes only. A chunk ends where the hash is the least of some WINDOW neighbouring ones, about
32 bytes on average, wherever the same bytes stand; an insertion moves borders near its own place only. Every WINDOW bytes
have a border, repetitive ones too, whose many equal borders are thinned to SHORT bytes. Chunks are compared by a 64-bit
digest. The chunk that comes first in order of id and place is the original, later ones are copies; a chunk with a copy
is repeated. Neighbouring repeated chunks of LEAST bytes or more are a repeat, neighbouring copied ones a copy, so a
chance agreement of one chunk is none. LEAST is well under the bytes of a passage of over 50 words, as the parts of its
first and last chunk that stand in it can't be told. Replayed with 2,800 random passages of 51 words between other texts
(sf0.1): 0.2 % have fewer than LEAST bytes in whole chunks.

Texts move nowhere, but for `remove_copies`, whose batches carry theirs along. A task packs the distinct digests of about GATHER
bytes of texts into one blob for each lane, which is a bucket of digests while these are few; else the lanes' blobs of many
batches are merged and dealt on to buckets (blobs.by_lane). A bucket finds for each digest the batch that has it first, and answers each blob; the answers meet the batch's
own chunk lengths, packed along. Within a batch equal chunks are asked for once, so a chunk that a third of all texts
hold costs one digest for each batch. A bucket has about BUCKET digests, so their number follows the corpus.

Edge cases: null and empty texts have no chunks; documents without an id take no part and have no repeats; ids are of any type that orders;
rows that repeat an id are documents of their own, the order of which is their place in the table; a text of under WINDOW bytes is
one chunk. The rows of docs must come in the same order if a task is run again, as those of a file do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blobs import PACKED, by_lane, columns_in, columns_out, gathered, groups, home, lanes_for, narrow, pack, packed_rows, unpack
from .tables import id_type, in_python, lean
from .text import raw

SHORT = 8
LEAST = 112
WINDOW = 64
GATHER = 8 << 20
BUCKET = 1 << 20
GEAR = np.random.default_rng(3).integers(0, 1 << 16, 256, dtype=np.uint16)


def ends(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one included."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8):  # the sum over 16 bytes, by doubling
        if len(h) > k:
            h[k:] += h[:-k].copy() << np.uint16(k)
    h = h[15:]  # the first ones don't see 16 bytes
    out = np.flatnonzero(_least(h)) + 16 if len(h) >= WINDOW else np.zeros(0, np.int64)
    if len(out) and np.diff(out, prepend=0).min() < SHORT:
        kept = [0]
        for x in out.tolist():
            if x - kept[-1] >= SHORT:
                kept.append(x)
        out = np.array(kept[1:], dtype=np.int64)
    return out if len(out) and out[-1] == len(text) else np.append(out, len(text))


def _least(h: np.ndarray) -> np.ndarray:
    """True where the hash is the least of a window: where the highest least of all windows around it is itself."""
    low = h
    for k in (1 << i for i in range(WINDOW.bit_length() - 1)):
        low = np.minimum(low[:-k], low[k:])
    high = np.pad(low, WINDOW - 1)
    for k in (1 << i for i in range(WINDOW.bit_length() - 1)):
        high = np.maximum(high[:-k], high[k:])
    return high == h


def _digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests and lengths of the chunks of all texts, and the number of chunks of each."""
    digests, lengths, counts = [], [], []
    for t in texts:
        stop = ends(t).tolist() if t else []
        start = [0, *stop[:-1]] if stop else []
        digests += [xxhash.xxh3_64_intdigest(t[x:y]) for x, y in zip(start, stop, strict=True)]
        lengths.append(np.diff(np.array([0, *stop])))
        counts.append(len(stop))
    return np.array(digests, dtype=np.uint64), np.concatenate([np.zeros(0, np.int64), *lengths]), np.array(counts, dtype=np.int64)


def _asked(docs: DataFrame, id_col: str, text: str, buckets: int, keep: list[str], texts: bool) -> DataFrame:
    """Blobs of digests (kind 1) by bucket, and one blob of each batch's columns and chunk lengths (kind 0)."""
    lanes = lanes_for(buckets)
    own = docs.select(*(F.col(c).alias(f"k{j}") for j, c in enumerate(keep)), F.col(id_col).cast(id_type(docs, id_col)).alias("_id"), F.col(text).alias("_text"))

    @lean
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(gathered(batches, "_text", GATHER)):
            batch = part << 32 | k
            found = raw(b, "_text")
            there = np.flatnonzero(b.column("_id").is_valid().to_numpy(zero_copy_only=False) & np.array([len(t) > 0 for t in found]))
            ids = b.column("_id").take(pa.array(there))  # of any type that orders
            by = np.argsort(_ranks(ids), kind="stable")
            order, ids = there[by], ids.take(pa.array(by))
            digests, lengths, counts = _digests([found[i] for i in order.tolist()])
            u, first, inv = np.unique(digests, return_index=True, return_inverse=True)
            by = np.argsort(first)
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            u, first, inv = u[by], first[by], rank[inv]  # numbered in order of appearance
            holder = np.repeat(np.arange(len(order)), counts)[first]
            bucket = (u % np.uint64(buckets)).astype(np.int64)
            sorted_by = np.argsort(bucket % lanes, kind="stable")
            edges = np.searchsorted((bucket % lanes)[sorted_by], np.arange(lanes + 1))
            rows = []
            for i in range(lanes):
                p = sorted_by[edges[i] : edges[i + 1]]
                if len(p):
                    own, n = np.unique(holder[p], return_counts=True)
                    rows.append((1, i, batch, _with_ids(ids.take(pa.array(own)), u[p], narrow(n))))
            head = {f"c{j}": b.column(f"k{j}") for j in range(len(keep))}
            head |= {"_n": pa.array([len(t) for t in found], pa.int64())} | ({"_text": pa.array(found, pa.binary())} if texts else {})
            numbers = _with_ids(ids, order, narrow(counts), narrow(lengths), np.diff(inv, prepend=0).astype(np.int32), narrow(bucket))
            blob = len(numbers).to_bytes(8, "little") + numbers + columns_in(head)
            yield packed_rows([*rows, (0, home(batch, lanes), batch, batch.to_bytes(8, "little") + blob)])

    whole = _whole(docs, id_col)
    return by_lane(own.transform(in_python, run, PACKED), lambda rows: _merged(rows, buckets, whole), buckets)


def _merged(rows: list[dict], buckets: int, whole: bool) -> list[tuple]:
    """The blobs of one lane and some batches as one blob for each bucket. Two further arrays name the batches, and how many digests and ids of each follow."""
    found = [_ids_out(r["blob"], whole) for r in rows]
    ids = pa.concat_arrays([x for x, _ in found])
    digest = np.concatenate([x[0] for _, x in found])
    holder = np.repeat(np.arange(len(ids)), np.concatenate([x[1] for _, x in found]))
    batch = np.repeat(np.array([r["batch"] for r in rows]), [len(x[0]) for _, x in found])
    bucket = (digest % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    out = []
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p = order[first:end]
        new = np.flatnonzero(np.diff(holder[p], prepend=-1))
        parts = np.append(np.flatnonzero(np.diff(batch[p], prepend=-1)), len(p))
        blob = _with_ids(ids.take(pa.array(holder[p][new])), digest[p], narrow(np.diff(np.append(new, len(p)))), batch[p][parts[:-1]], narrow(np.diff(parts)))
        out.append((1, int(bucket[p[0]]), rows[0]["set"], blob))
    return out


def _ranks(ids: pa.Array) -> np.ndarray:
    """Ranks of ids by their order, equal ones alike."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy()
    return np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)


def _with_ids(ids: pa.Array, *arrays: np.ndarray) -> bytes:
    """Ids of any type and arrays of numbers in one blob."""
    numbers = pack(*arrays)
    own = pack(ids.to_numpy()) if pa.types.is_integer(ids.type) else columns_in({"id": ids})
    return len(numbers).to_bytes(8, "little") + numbers + own


def _ids_out(blob: bytes, whole: bool) -> tuple[pa.Array, list[np.ndarray]]:
    n = 8 + int.from_bytes(blob[:8], "little")
    return pa.array(unpack(blob[n:])[0]) if whole else columns_out(blob[n:]).column(0), unpack(blob[8:n])


def _answered(asked: DataFrame, whole: bool) -> DataFrame:
    """For each digest asked for: 0 if no other batch has it, 1 if others do and this one is first, 2 and the id of the first if not."""

    @lean
    def run(batches):
        for rows in groups(batches, "bucket"):
            out = [tuple(r.values()) for r in rows if not r["kind"]]
            rows = [r for r in rows if r["kind"]]
            found = [_ids_out(r["blob"], whole) for r in rows]
            if found:
                ids = pa.concat_arrays([x for x, _ in found])  # of the holders
                found = [x for _, x in found]
                digest = np.concatenate([x[0] for x in found])
                holder = np.repeat(np.arange(len(ids)), np.concatenate([x[1] for x in found]))
                rank = _ranks(ids)[holder]
                row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                batch = np.concatenate([np.repeat(x[2], x[3]) if len(x) > 2 else np.full(len(x[0]), r["batch"]) for x, r in zip(found, rows, strict=True)])
                order = np.lexsort((batch, rank, digest))
                new = np.flatnonzero(np.diff(digest[order], prepend=digest[order[:1]] + np.uint64(1)) != 0)
                size = np.diff(np.append(new, len(order)))
                code = np.zeros(len(order), np.uint8)
                code[order] = np.where(np.repeat(size, size) > 1, 2, 0)
                code[order[new]] = np.minimum(code[order[new]], 1)
                first = np.empty(len(order), np.int64)
                first[order] = np.repeat(holder[order[new]], size)
                for k, (r, x) in enumerate(zip(rows, found, strict=True)):
                    own = row == k
                    out.append((2, r["bucket"], r["batch"], _with_ids(ids.take(pa.array(first[own][code[own] == 2])), code[own], *x[2:])))
            yield packed_rows(out)

    return asked.repartition("bucket").sortWithinPartitions("bucket", "batch").transform(in_python, run, PACKED)


def _spans(on: np.ndarray, lengths: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first chunk, chunk after the last) of neighbouring chunks that are on, from `least` bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    at = np.concatenate(([0], np.cumsum(lengths)))
    return [(int(at[x]), int(at[y]), x, y) for x, y in edge.reshape(-1, 2).tolist() if at[y] - at[x] >= least]


class Answers:
    """The chunks of one batch with what the buckets answered."""

    def __init__(self, blob: bytes, found: list[tuple[int, pa.Array, np.ndarray]], whole: bool):
        """found: for each bucket that answered its number, the ids where chunks stand first, and a code for each digest."""
        n = 8 + int.from_bytes(blob[:8], "little")
        self.columns = columns_out(blob[n:])
        ids, (self.order, counts, lengths, steps_, bucket) = _ids_out(blob[8:n], whole)
        inv = np.cumsum(steps_.astype(np.int64))
        code, first = np.zeros(len(bucket), np.uint8), np.zeros(len(bucket), np.int64)
        known, passed = [ids], len(ids)
        for k, more, own_code in found:
            own = np.flatnonzero(bucket == k)
            code[own] = own_code
            first[own[code[own] == 2]] = passed + np.arange(len(more))
            known.append(more)
            passed += len(more)
        #: Ids of the batch's documents and of those where its chunks stand first; `first` has places in it.
        self.known = pa.concat_arrays(known)
        counts = counts.astype(np.int64)
        holder = np.repeat(np.arange(len(ids)), counts)
        place = np.full(len(code), len(inv))
        np.minimum.at(place, inv, np.arange(len(inv)))
        self.copy = (code[inv] == 2) | (place[inv] != np.arange(len(inv)))
        self.repeated = self.copy | (code[inv] == 1) | (np.bincount(inv, minlength=len(code))[inv] > 1)
        self.first = np.where(code[inv] == 2, first[inv], holder[place[inv]] if len(inv) else 0)
        self.lengths, self.ends = lengths.astype(np.int64), np.cumsum(counts)
        self.starts = self.ends - counts

    def documents(self, least: int):
        """(row, repeats, copies, ids where the copies stand first) for each document with chunks."""
        for k, row in enumerate(self.order.tolist()):
            own = slice(self.starts[k], self.ends[k])
            if not self.repeated[own].any():
                continue
            copies = _spans(self.copy[own], self.lengths[own], least)
            first = self.first[own]
            places = np.unique(np.concatenate([first[x:y] for *_, x, y in copies])) if copies else np.zeros(0, np.int64)
            yield row, _spans(self.repeated[own], self.lengths[own], least), copies, sorted(set(self.known.take(pa.array(places)).to_pylist()))


def answers(rows: list[dict], whole: bool) -> Iterator[Answers]:
    """The batches of these rows, each with what the buckets answered it."""
    held: dict[int, tuple[bytes, list]] = {}
    for r in rows:
        if not r["kind"]:
            held[int.from_bytes(r["blob"][:8], "little")] = (r["blob"][8:], [])
            continue
        ids, (code, *parts) = _ids_out(r["blob"], whole)
        at = used = 0
        for batch, n in zip(*(x.tolist() for x in parts), strict=True) if parts else [(r["batch"], len(code))]:
            own = code[at : at + n]
            later = int((own == 2).sum())
            held[batch][1].append((r["bucket"], ids.slice(used, later), own))
            at, used = at + n, used + later
    for blob, found in held.values():
        yield Answers(blob, found, whole)


def _buckets(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(1, -(-size // (32 * BUCKET)))


def _by_batch(docs: DataFrame, id_col: str, text: str, keep: list[str], texts: bool) -> DataFrame:
    answered = _answered(_asked(docs, id_col, text, _buckets(docs, text), keep, texts), _whole(docs, id_col))
    return answered.repartition("batch").sortWithinPartitions("batch", "kind")


def _whole(docs: DataFrame, id_col: str) -> bool:
    return isinstance(id_type(docs, id_col), T.LongType)


RESULT = {"n_bytes": pa.int64(), "n_repeats": pa.int64(), "n_copies": pa.int64(), "copied_bytes": pa.int64(), "copies": pa.string(), "first_ids": None, "has_repeat": pa.bool_(), "has_copy": pa.bool_()}


def summary(docs: DataFrame, id_col="doc_id", text="text", least: int = LEAST) -> DataFrame:
    """One row for each document: bytes, repeats, copies and copied bytes, the copies as ``start:end`` bytes, ids where their chunks stand first."""
    whole, wide = _whole(docs, id_col), id_type(docs, id_col)
    kinds = RESULT | {"first_ids": pa.list_(to_arrow_type(wide))}

    @lean
    def run(batches):
        for got in (x for rows in groups(batches, "batch") for x in answers(rows, whole)):
            ids, n_bytes = got.columns.columns
            out = [[0, 0, 0, "", [], False, False] for _ in range(len(ids))]
            for row, repeats, copies, first in got.documents(least):
                out[row] = [len(repeats), len(copies), sum(y - x for x, y, *_ in copies), ",".join(f"{x}:{y}" for x, y, *_ in copies), first, bool(repeats), bool(copies)]
            more = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, n_bytes, *more], ["doc_id", *RESULT])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_repeats long, n_copies long, copied_bytes long, copies string, first_ids array<{wide.simpleString()}>, has_repeat boolean, has_copy boolean"
    return _by_batch(docs, id_col, text, [id_col], False).transform(in_python, run, schema)


def remove_copies(docs: DataFrame, id_col="doc_id", text="text", least: int = LEAST) -> DataFrame:
    """The documents with copied runs cut out of their texts, all other columns as they are. A character that a border splits stays whole."""
    whole = _whole(docs, id_col)

    @lean
    def run(batches):
        for got in (x for rows in groups(batches, "batch") for x in answers(rows, whole)):
            *columns, _, found = got.columns.columns
            texts = found.to_pylist()
            for row, _, copies, _ in got.documents(least):
                texts[row] = _without(texts[row], copies)
            at = docs_columns.index(text)
            null = columns[at].is_null().to_pylist()
            columns[at] = pa.array([None if x else t.decode() for x, t in zip(null, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return _by_batch(docs, id_col, text, docs_columns, True).transform(in_python, run, docs.schema)


def _without(t: bytes, spans: list[tuple]) -> bytes:
    left, at = [], 0
    for start, end, *_ in spans:
        while start < end and t[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(t) and t[end] & 0xC0 == 0x80:
            end -= 1
        left.append(t[at : max(at, start)])
        at = max(at, end)
    return b"".join([*left, t[at:]])
