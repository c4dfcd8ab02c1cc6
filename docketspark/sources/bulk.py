"""A sink for keyed services: batches of records, retried with backoff, harmless to repeat.

``spark.write.format("bulk")`` sends every partition in batches of ``batch`` records to a client made from the option
``client`` (``module:factory``, called with the options, on the executor).  A client has ``send(records)``, which sets records
by their id, so a batch that is sent twice, by a retry or by a task that runs again, leaves the same records.  An error
whose text matches :data:`RETRYABLE` is tried again after 1, 2, 4, ... seconds and a random part of a second, up to
``retries`` attempts in all; any other fails the task.  Each task reports its counts, which the commit adds up and hands
to the client's ``done(totals)``; a job that fails calls ``failed(totals)`` with what the finished tasks had sent.

How many batches are under way at once is the number of running tasks; ``coalesce`` bounds it.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

# Records of a batch, attempts, and the errors of a busy service.
BATCH, RETRIES = 400, 5
RETRYABLE = re.compile(r"429|RESOURCE_EXHAUSTED|UNAVAILABLE|DEADLINE_EXCEEDED|INTERNAL", re.IGNORECASE)


@dataclass
class Sent(WriterCommitMessage):
    """What one task sent."""

    records: int
    batches: int
    attempts: int


def client_of(options: dict[str, str]) -> Any:
    module, _, factory = options["client"].partition(":")
    return getattr(import_module(module), factory)(options)


def deliver(client: Any, records: list[dict], retries: int, pause: float) -> int:
    """Send one batch; how many attempts it took."""
    attempt = 1
    while True:
        try:
            client.send(records)
            return attempt
        except Exception as error:
            if attempt >= retries or not RETRYABLE.search(str(error)):
                raise
        time.sleep(pause * (2 ** (attempt - 1) + random.random() / 2))
        attempt += 1


class BulkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        client = client_of(self.options)
        size, retries, pause = int(self.options.get("batch", BATCH)), int(self.options.get("retries", RETRIES)), float(self.options.get("pause", 1))
        sent, waiting = Sent(0, 0, 0), []
        for part in iterator:
            for at in range(0, part.num_rows, size):
                waiting += part.slice(at, size).to_pylist()
                while len(waiting) >= size:
                    self._one(client, waiting[:size], retries, pause, sent)
                    waiting = waiting[size:]
        if waiting:
            self._one(client, waiting, retries, pause, sent)
        return sent

    @staticmethod
    def _one(client: Any, records: list[dict], retries: int, pause: float, sent: Sent) -> None:
        sent.attempts += deliver(client, records, retries, pause)
        sent.records += len(records)
        sent.batches += 1

    def _told(self, what: str, messages: list[Sent | None]) -> None:
        ended = [m for m in messages if m is not None]
        totals = {name: sum(getattr(m, name) for m in ended) for name in ("records", "batches", "attempts")}
        tell = getattr(client_of(self.options), what, None)
        if tell is not None:
            tell(totals)

    def commit(self, messages: list[Sent | None]) -> None:
        self._told("done", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        self._told("failed", messages)


class Bulk(DataSource):
    """``df.write.format("bulk").option("client", "module:factory").mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "bulk"

    def writer(self, schema: StructType, overwrite: bool) -> BulkWriter:
        if overwrite:
            raise ValueError("records are set by id; write with mode append")
        return BulkWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and this package to its executors."""
    ship(spark)
    spark.dataSource.register(Bulk)
