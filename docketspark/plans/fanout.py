"""Federated fan-out: the top rows of every applicable source in one plan, and a summary per source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """A table that answers for some identifiers: ``bind`` gives its predicate, or None if none of them applies."""

    name: str
    table: Callable[[], DataFrame]
    bind: Callable[[dict], Column | None]
    order: tuple[Column, ...]
    payload: Column
    key: Column


def branches(sources: list[Source], identifiers: dict, wanted: list[str] | None = None) -> list[tuple[Source, Column]]:
    """Sources that accept at least one identifier; unknown names in ``wanted`` are ignored."""
    chosen = [s for s in sources if wanted is None or s.name in wanted]
    bound = [(s, s.bind(identifiers)) for s in chosen]
    return [(s, predicate) for s, predicate in bound if predicate is not None]


def fan_out(sources: list[Source], identifiers: dict, limit: int = 5, wanted: list[str] | None = None) -> DataFrame:
    """``source, rank, key, payload`` of the first ``limit`` rows of each source, with one more to tell of more.

    A source whose columns don't resolve gives one row with an error as its payload instead.
    """
    parts = []
    for source, predicate in branches(sources, identifiers, wanted):
        table = source.table()
        try:
            rows = table.where(predicate).orderBy(*source.order).limit(limit + 1)
            rank = F.row_number().over(Window.orderBy(*source.order)).cast("long")
            parts.append(rows.select(F.lit(source.name).alias("source"), rank.alias("rank"), source.key.cast("string").alias("key"), source.payload.alias("payload")))
        except Exception as error:  # noqa: BLE001  analysis errors of one source stay with it
            text = str(error).split("\n")[0]
            parts.append(
                table.sparkSession.range(1).select(F.lit(source.name).alias("source"), F.lit(0).cast("long").alias("rank"), F.lit("error").alias("key"), F.lit(text).alias("payload"))
            )
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame, limit: int = 5) -> DataFrame:
    """``source, n, has_more, keys`` of each source with rows."""
    own = F.col("rank") <= limit
    return found.groupBy("source").agg(
        F.count_if(own).alias("n"),
        (F.max("rank") > limit).alias("has_more"),
        F.array_join(F.array_sort(F.collect_list(F.when(own, F.col("key")))), ",").alias("keys"),
    )
