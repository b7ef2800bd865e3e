"""Numbers packed into compressed blobs, so that a shuffle moves few rows and few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_python, lean
from .text import pieces

#: Rows that pass through a deal: kind 0 holds a batch's own columns, others what is asked and answered.
PACKED = "kind int, bucket int, batch long, blob binary"
TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary())


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one compressed blob."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        kind = np.dtype(chr(kind))
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers (none below 0) in the smallest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text and fewer than 2^16 rows."""
    held, size, rows = [], 0, 0
    for b in pieces(batches, column, limit):
        own = pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if held and (size + own > limit or rows + b.num_rows >= 1 << 16):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, rows = [], 0, 0
        held.append(b)
        size, rows = size + own, rows + b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def groups(batches: Iterator[pa.RecordBatch], *keys: str, limit: int | None = None) -> Iterator[list[dict]]:
    """Rows of sorted batches with the same keys; with a limit in lots of at most so many bytes of blobs (one row at least)."""
    held: list[dict] = []
    size = 0
    for b in batches:
        for row in b.to_pylist():
            own = len(row["blob"]) if limit else 0
            if held and (any(held[0][k] != row[k] for k in keys) or limit and size + own > limit):
                yield held
                held, size = [], 0
            held.append(row)
            size += own
    if held:
        yield held


#: A batch deals to so many lanes at most. Buckets beyond these are told apart in a second step, where a lane's blobs of the
#: batches of TOGETHER neighbouring partitions are merged, so neither step makes a blob for each batch and bucket.
LANES, TOGETHER = 256, 16
#: Bytes of blobs that are merged at once.
MERGED = 32 << 20


def lanes_for(buckets: int) -> int:
    return min(buckets, LANES)


def by_lane(dealt: DataFrame, merge, buckets: int) -> DataFrame:
    """dealt as it is, or beyond LANES buckets what merge(rows of a lane and some batches) gives: rows of buckets.

    The column batch then names the batches that were merged; rows of kind 0 go through.
    """
    if buckets <= LANES:
        return dealt
    shift = 32 + TOGETHER.bit_length() - 1

    @lean
    def run(batches):
        for rows in groups(batches, "bucket", "set", limit=MERGED):
            kept = [(0, home(r["batch"], buckets), r["set"], r["blob"]) for r in rows if not r["kind"]]
            asked = [r for r in rows if r["kind"]]
            yield packed_rows([*kept, *(merge(asked) if asked else [])])

    named = dealt.withColumn("set", F.shiftright("batch", shift))
    return named.repartition("bucket", "set").sortWithinPartitions("bucket", "set", "batch").transform(in_python, run, PACKED)


def columns_in(named: dict[str, pa.Array]) -> bytes:
    """Columns of a batch in one blob."""
    table = pa.RecordBatch.from_arrays(list(named.values()), list(named))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def columns_out(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as f:
        return f.read_next_batch()


def home(batch: int, buckets: int) -> int:
    """A bucket for a batch's own columns: numbers of batches aren't even in their low bits."""
    return (batch * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF) % buckets


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    """(kind, bucket, batch, blob) rows."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(TYPES)], ["kind", "bucket", "batch", "blob"])
