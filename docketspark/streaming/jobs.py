"""Streams: idempotent ingestion, late data, event windows and an exact sliding limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .keyed_store import KeyedStore


def follow(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Events by id once each; repeats further apart than ``delay`` are taken as new."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, size: str, by: str, delay: str = "2 days") -> DataFrame:
    """Counts in tumbling windows; events behind the watermark are dropped."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w")["start"].alias("start"), F.col("w")["end"].alias("end"), by, "n")


def upsert_into(folder: str, schema, keys: list[str], sequence: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch is merged by key into the :class:`KeyedStore` at ``folder``."""
    return lambda batch, number: KeyedStore(batch.sparkSession, folder, schema, keys, sequence).sink()(batch, number)


def replay(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run all that is available through a batch sink and stop."""
    return events.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(events: DataFrame, folder: str) -> DataFrame:
    """Run all that is available into Parquet files, each batch exactly once, and return what they hold."""
    writer = events.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(f"{folder}/rows")


class SlidingLimiter(StatefulProcessor):
    """Admits at most ``limit`` hits in any ``seconds``; rejected hits are not recorded."""

    def __init__(self, limit: int = 60, seconds: float = 60.0):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [x[0] for x in self.hits.get()] if self.hits.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "hit"]).itertuples():
            kept = [x for x in kept if x > row.at - self.seconds]
            admitted = len(kept) < self.limit
            if admitted:
                kept.append(row.at)
            out.append((key[0], row.hit, admitted))
        self.hits.put([(x,) for x in kept])
        yield pd.DataFrame(out, columns=["client", "hit", "admitted"])

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """``client, hit, admitted`` for a stream of ``client string, hit long, at double``."""
    return hits.groupBy("client").transformWithStateInPandas(
        SlidingLimiter(limit, seconds), outputStructType="client string, hit long, admitted boolean", outputMode="Append", timeMode="None"
    )
