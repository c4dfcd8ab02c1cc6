"""Tools: named query specifications over a warehouse of keyed collections, answered with what they cannot know.

A warehouse keeps each collection in a :class:`KeyedStore`, whose pointer holds the least and largest date of every
bucket.  A batch of upserts updates them for the buckets it rewrites, so a tool reads its collection's coverage from a
small file when it plans, and never scans for it.  The verdict on an answer depends on three things only, all known when
the plan is made but the number of rows; so the plan holds the three possible texts and picks one by that number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.keyed_store import KeyedStore
from . import coverage
from .spec import QueryError, Spec, plan


class Warehouse:
    """Collections by name, each a keyed store under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stores: dict[str, KeyedStore] = {}

    def collection(self, name: str, schema: T.StructType | str, keys: list[str], sequence: str, date: str | None) -> KeyedStore:
        self._stores[name] = KeyedStore(self.spark, f"{self.folder}/{name}", schema, keys, sequence, date)
        return self._stores[name]

    def rows(self, name: str) -> DataFrame:
        return self._stores[name].read()

    def covered(self, name: str) -> coverage.Coverage | None:
        """From the pointer; None for a collection without a date."""
        store = self._stores[name]
        return coverage.Coverage(*store.coverage()) if store.date else None


@dataclass
class Registry:
    """Specifications by the tool's name."""

    specs: dict[str, Spec] = field(default_factory=dict)

    def add(self, name: str, spec: Spec) -> Spec:
        if name in self.specs:
            raise ValueError(f"{name} is registered already")
        self.specs[name] = spec
        return spec

    def answer(self, name: str, warehouse: Warehouse, arguments: Mapping[str, Any]) -> DataFrame:
        """``rn, key, has_more, verdict`` of a request's page; one row without a key where the page is empty.

        A request that can't be answered gives one row whose verdict is the error.
        """
        one = warehouse.spark.range(1)
        if name not in self.specs:
            return one.select(*_row(None, None, F.lit(False), F.lit(f"UNKNOWN_TOOL: {name}")))
        spec = self.specs[name]
        try:
            page, limit = plan(spec, warehouse.rows(spec.table), arguments)
        except QueryError as error:
            return one.select(*_row(None, None, F.lit(False), F.lit(str(error))))
        given = [[arguments[x] for x in names if arguments.get(x)] for names in (spec.since, spec.until)]
        held = warehouse.covered(spec.table)
        notes = spec.notes(arguments, held)
        say = lambda n, truncated: F.lit(coverage.joined(coverage.notice(held, n, truncated, *given, spec.gap(arguments), spec.shallow), *notes))
        n = F.count("rn").over(Window.partitionBy("one"))  # of a page
        rows = one.select(F.lit(1).alias("one")).join(page.select("rn", F.col(spec.key).cast("string").alias("key"), F.lit(1).alias("one")), "one", "left")
        verdict = F.when(n == 0, say(0, False)).when(n >= limit, say(1, True)).otherwise(say(1, False)).cast("string")
        found = rows.select("rn", "key", (n > limit).alias("has_more"), verdict.alias("verdict"))
        return found.where(F.col("rn").isNull() | (F.col("rn") <= limit)).select(*_row("rn", "key", F.col("has_more"), F.col("verdict")))


def _row(rn, key, has_more, verdict) -> list:
    plain = [F.lit(None) if x is None else F.col(x) for x in (rn, key)]
    return [plain[0].cast("long").alias("rn"), plain[1].cast("string").alias("key"), has_more.alias("has_more"), verdict.cast("string").alias("verdict")]
