"""A run over cases as a stream whose checkpoint is the run's ledger.

Cases arrive as files. Each one's state says whether it is claimed, done or failed, and how often it was tried; a case that is done or has
failed for good is passed by when it comes again, in this run or after a restart from the same checkpoint. Results are
written by batch under the batch's number, so a batch that is run again replaces itself. A stop, asked for or by a lost
driver, leaves whole batches: a valid partial run, which `progress` describes and a restart goes on with.

Calls of a batch that didn't end are made again on restart; with models.stored answers (see models.ask, or a `make` that looks
its key up first) they aren't asked twice.

Edge cases: a case id that repeats is run once, with what came first in its batch; null ids are left out (they can't be claimed);
a null prompt is the empty one; an empty folder gives an empty run.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import ship

RESULT = "case_id string, status string, attempts int, output string, error string"
STATE = "status string, attempts int"
TRIES = 2


def case_stream(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """JSON lines with case_id and prompt as a stream."""
    return spark.readStream.schema("case_id string, prompt string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def outcomes(cases: DataFrame, make: Callable[[str], str], tries: int = TRIES) -> DataFrame:
    """A row for each case that is done, or has failed `tries` times, when its first row arrives."""
    ship(cases.sparkSession)

    def step(key: tuple, rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.exists and state.get[0] in ("done", "failed"):
            return
        first = next((r for b in rows for r in b.itertuples(index=False)), None)
        prompt = getattr(first, "prompt", None)
        attempts = state.get[1] if state.exists else 0
        status, output, error = "claimed", None, None
        state.update((status, attempts))
        while status == "claimed":
            attempts += 1
            try:
                output, status, error = make(prompt if isinstance(prompt, str) else ""), "done", None
            except Exception as e:  # noqa: BLE001  failures are rows
                error = f"{type(e).__name__}: {e}"
                status = "failed" if attempts >= tries else "claimed"
        state.update((status, attempts))
        yield pd.DataFrame([(key[0], status, attempts, output, error)], columns=["case_id", "status", "attempts", "output", "error"])

    named = cases.where("case_id is not null")
    return named.groupBy("case_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def start(found: DataFrame, out: str, checkpoint: str, on_batch: Callable[[int], None] | None = None):
    """The query that runs over all that has arrived and ends; on_batch is told each batch's number once it is written."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if on_batch is not None:
            on_batch(number)

    return found.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, folder: str, make: Callable[[str], str], out: str, checkpoint: str, files_per_batch: int = 10, tries: int = TRIES, stop: threading.Event | None = None) -> bool:
    """Run the cases of a folder until all are through or `stop` is set; True if all are. The same arguments go on where a run stopped.

    A stop waits for the batch in hand, so the ledger and the results agree.
    """
    stop = stop or threading.Event()
    query = None

    def after(number: int) -> None:
        if stop.is_set():
            raise StopRun(f"stopped after batch {number}")

    query = start(outcomes(case_stream(spark, folder, files_per_batch), make, tries), out, checkpoint, after)
    try:
        query.awaitTermination()
    except Exception as e:  # noqa: BLE001  the stop comes back as the query's failure
        if not stop.is_set() or "stopped after batch" not in str(e):
            raise
    return not stop.is_set()


class StopRun(Exception):
    """Ends a query after a batch whose results are written."""


def stop_on_signals(signals=(signal.SIGINT, signal.SIGTERM)) -> threading.Event:
    """An event that these signals set, in place of ending the process."""
    told = threading.Event()
    for s in signals:
        signal.signal(s, lambda *_: told.set())
    return told


def results(spark: SparkSession, out: str) -> DataFrame:
    """The results so far, one row for each case."""
    return spark.read.schema(RESULT).parquet(out).groupBy("case_id").agg(F.min(F.struct("status", "attempts", "output", "error")).alias("r")).select("case_id", "r.*")


def progress(cases: DataFrame, done: DataFrame) -> DataFrame:
    """(cases, done, failed, open, partial): how far a run has come. cases: case_id of all that it should cover."""
    rows = cases.where("case_id is not null").select("case_id").distinct().join(done.select("case_id", "status"), "case_id", "left")
    sums = rows.agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("open"))
    return sums.withColumn("partial", F.col("open") > 0)
