"""Words and Arrow batches for the operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: UTF-8 bytes to lower-cased word bytes: A-Z become a-z, other ASCII but digits and letters become spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


class Cache(dict):
    """A dict that fills itself by make(key), of bounded size: when it holds `entries`, it starts anew, and what is asked for again moves over from the last full one."""

    def __init__(self, make, entries: int = 1 << 17):
        super().__init__()
        self.make, self.entries, self.last = make, entries, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.last = dict(self)
            self.clear()
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def word_hashes() -> Cache:
    """64-bit hashes of words."""
    return Cache(xxhash.xxh3_64_intdigest, 1 << 16)


def hashes(found: list[bytes], cache: Cache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives no bytes."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), names=keep + list(new))
