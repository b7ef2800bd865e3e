"""Reading inputs, cutting lineage and checked broadcasts, shared by the operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from ..sources.scratch import shared_dir, stored

__all__ = ["BROADCAST_BYTES", "aside", "cut", "fits", "id_type", "in_python", "keeper", "lean", "shared_dir", "ship", "small", "table"]

#: A side is broadcast up to so many bytes; beyond it a shuffled join runs.
BROADCAST_BYTES = 32 << 20


#: Rows go to Python workers in batches of at most so many rows and about so many bytes, where the session has Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}

#: What a worker keeps from one task to the next, by the operator that made it.
_kept: dict[str, dict] = {}


def keeper(name: str) -> dict:
    """A dict that outlives the tasks of one operator in a worker, and is emptied when another one's task begins there."""
    return _kept.setdefault(name, {})


def lean(run, keep: str | None = None, hold: bool = False):
    """A function over batches that hands its worker's free memory back to the system when a task ends.

    Workers serve one task after another: what other operators than `keep` kept there goes first, and without `hold` all
    of it when the task ends.
    """

    @functools.wraps(run)
    def wrapped(batches):
        for name, held in _kept.items():
            if name != keep:
                held.clear()
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            for held in () if hold else _kept.values():
                held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def ship(spark: SparkSession) -> None:
    """This package for the Python workers, and smaller batches for them."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)
    scratch.ship(spark)


def in_python(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for `df.transform`: the workers get this package before Spark notes what the function needs, whoever made df."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark's readers understand."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: the plan above it starts from files that outlive any executor."""
    ship(df.sparkSession)
    return stored(df)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df take at most `limit` bytes: 64 a row, 8 a column, and what its texts, binaries, arrays and structs hold.

    df should be cheap to read: a base table or the result of cut().
    """
    of = lambda *kinds: [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, kinds)]
    held = [F.octet_length(c) for c in of(T.StringType, T.BinaryType)] + [F.octet_length(F.to_json(F.struct(c))) for c in of(T.ArrayType, T.MapType, T.StructType)]
    size = sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(64 + 8 * len(df.columns))).cast("long")
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits, else df as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if fits(df, limit) else df


def id_type(df: DataFrame, column: str) -> T.DataType:
    """Integer ids are longs, others keep their type."""
    own = df.schema[column].dataType
    return T.LongType() if isinstance(own, T.IntegralType) else own


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ... by position, so that no name of an operator clashes with one of theirs, and the new names by the old."""
    where = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*where.values()), where
