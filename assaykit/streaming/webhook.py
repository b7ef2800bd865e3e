"""Events posted to a webhook, as a data source for streams and tables.

    events.writeStream.format("webhook").option("url", ...).option("sent", shared_folder).option("checkpointLocation", ...).start()

Each event has an id. It goes with the request, and is marked in the folder `sent` once the service has taken it, so a batch that is run
again posts only what isn't marked: every event is posted at least once, and more than once only if the writer is lost
between the answer and the mark, which the receiver tells by the id. Failed requests are tried again; what fails for good
stops the batch, or with option strict=false is counted and left out, as for figures that nothing hangs on.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..sources import models
from ..sources.scratch import ship


@dataclass
class Posted(WriterCommitMessage):
    """What one task did."""

    sent: int
    known: int
    failed: int


def plain(x):
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    return float(x) if isinstance(x, Decimal) else x


class Poster:
    """The part that streams and tables share."""

    def __init__(self, options: dict):
        if "url" not in options:
            raise ValueError("the webhook needs the option url")
        self.url, self.sent, self.id = options["url"], options.get("sent"), options.get("id", "id")
        self.strict, self.timeout = options.get("strict", "true").lower() != "false", float(options.get("timeout", "10"))
        self.waits = [float(x) for x in options.get("waits", "1,3,8").split(",") if x]

    def post(self, row: dict) -> None:
        body = json.dumps({k: plain(v) for k, v in row.items()}, default=str).encode()
        request = urllib.request.Request(self.url, body, {"content-type": "application/json", "idempotency-key": str(row[self.id])})
        for wait in (*self.waits, None):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout):
                    return
            except urllib.error.HTTPError as e:
                if wait is None or e.code not in models.AGAIN:
                    raise RuntimeError(f"webhook answered {e.code}") from e
                time.sleep(models.wait_for(e.headers.get("retry-after"), wait))
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if wait is None:
                    raise RuntimeError(f"webhook: {e}") from e
                time.sleep(models.wait_for(None, wait))

    def write(self, iterator: Iterator) -> Posted:
        done = Posted(0, 0, 0)
        for row in iterator:
            own = row.asDict(True)
            key = hashlib.sha256(str(own[self.id]).encode()).hexdigest()
            if self.sent and models.stored_answer(self.sent, key) is not None:
                done.known += 1
                continue
            try:
                self.post(own)
            except RuntimeError as e:
                if self.strict:
                    raise
                logging.getLogger(__name__).warning("event %s: %s", own[self.id], e)
                done.failed += 1
                continue
            if self.sent:
                models.store_answer(self.sent, key, {"id": str(own[self.id])})
            done.sent += 1
        return done


class StreamPoster(Poster, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.tell(f"batch {batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        logging.getLogger(__name__).warning("batch %s was not posted as a whole", batchId)

    def tell(self, what: str, messages: list) -> None:
        told = [m for m in messages if m is not None]
        logging.getLogger(__name__).info("%s: %d posted, %d known, %d failed", what, sum(m.sent for m in told), sum(m.known for m in told), sum(m.failed for m in told))


class TablePoster(Poster, DataSourceWriter):
    pass


class Webhook(DataSource):
    """Options: url, sent (a shared folder of marks), id (the column of ids), strict, timeout, waits (seconds, comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def streamWriter(self, schema, overwrite: bool) -> StreamPoster:  # noqa: N802
        return StreamPoster(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TablePoster:
        return TablePoster(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Webhook)
