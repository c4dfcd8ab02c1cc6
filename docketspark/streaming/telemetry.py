"""Telemetry of jobs: a row for each, merged by name, from streams' progress and from batch jobs alike.

A :class:`Listener` is told of every batch of every named stream.  It adds them up by name in the driver, a row for each
stream, and :meth:`Telemetry.flush` upserts the rows, so listening starts no Spark job of its own and a stream of many
batches costs no row each.  A merge sets only the fields that a report names: a job that reports no errors leaves the
number it reported before.
"""

from __future__ import annotations

import json
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .keyed_store import KeyedStore

SCHEMA = "job string, last_synced_at string, duration_ms bigint, docs_written bigint, errors bigint, stats string, seq bigint"
FIELDS = ["last_synced_at", "duration_ms", "docs_written", "errors", "stats"]


class Telemetry:
    """The table of jobs at a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.store = KeyedStore(spark, folder, SCHEMA, ["job"], "seq", present="present")
        self.listener = Listener()

    def rows(self) -> DataFrame:
        return self.store.read().drop("seq")

    def merge(self, reports: DataFrame) -> None:
        """Reports hold ``job`` and some of :data:`FIELDS`; what a report has not is left as it was."""
        given = [x for x in FIELDS if x in reports.columns]
        rest = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in SCHEMA.split(", ")) if name in FIELDS and name not in given]
        seq = F.lit(self.store.pointer().number + 1).cast("long")
        self.store.upsert(reports.select("job", *given, *rest, seq.alias("seq"), F.array(*map(F.lit, given)).alias("present")))

    def record(self, job: str, started: datetime, docs_written: int | None = None, errors: int | None = None, stats: dict | None = None) -> None:
        """A batch job's report, as it ends."""
        ended = datetime.now(timezone.utc)
        row = {"job": job, "last_synced_at": ended.isoformat(timespec="milliseconds"), "duration_ms": int((ended - started).total_seconds() * 1000)}
        row |= {k: v for k, v in (("docs_written", docs_written), ("errors", errors), ("stats", None if stats is None else json.dumps(stats))) if v is not None}
        kinds = dict(x.split() for x in SCHEMA.split(", "))
        self.merge(self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row)))

    def flush(self) -> int:
        """Upsert what the listener heard since the last time; how many streams that were."""
        heard = self.listener.taken()
        if heard:
            rows = [(job, x["at"], x["ms"], x["rows"], x["errors"], json.dumps({"batches": x["batches"]})) for job, x in heard.items()]
            self.merge(self.spark.createDataFrame(rows, SCHEMA.rpartition(",")[0]))
        return len(heard)


class Listener(StreamingQueryListener):
    """Progress by the stream's name; streams without a name are left out."""

    def __init__(self) -> None:
        self._lock, self._heard, self._names = threading.Lock(), {}, {}

    def taken(self) -> dict[str, dict]:
        with self._lock:
            heard, self._heard = self._heard, {}
        return heard

    def _of(self, job: str) -> dict:
        return self._heard.setdefault(job, {"at": None, "ms": 0, "rows": 0, "errors": 0, "batches": 0})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name:
            self._names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name:
            with self._lock:
                x = self._of(p.name)
                x["at"] = max(x["at"] or "", p.timestamp)
                x["ms"] += p.durationMs.get("triggerExecution", 0)
                x["rows"] += p.numInputRows
                x["batches"] += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        job = self._names.pop(str(event.runId), None)
        if job and event.exception:
            with self._lock:
                x = self._of(job)
                x["errors"] += 1
                x["at"] = x["at"] or datetime.now(timezone.utc).isoformat(timespec="milliseconds")
