"""Resumable batch loads: a manifest of units with states and attempts, terminal markers and the backlog.

A unit (a quarter, a file, a filing) is in one of :data:`STATES`, or was never tried.  Every transition is one upsert of
the manifest's :class:`KeyedStore`, published by a rename: it holds as a whole or not at all, and of two runs that make
one at the same time, one fails with ``Conflict``.  A run that is lost leaves its unit ``in_progress``; such units, failed
ones and ones not published yet are due again, completed ones and those with a terminal marker are not.

Loads are to be idempotent by key, since a unit whose run was lost after its data were written is loaded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .keyed_store import KeyedStore

#: ``terminal`` marks a unit that was read in full and holds nothing to load.
STATES = ("in_progress", "completed", "failed", "not_published", "terminal")
DONE = ("completed", "terminal")
#: From which states each may follow; None is a unit never tried.
FOLLOWS = {
    "in_progress": (None, "in_progress", "failed", "not_published"),
    "completed": ("in_progress",), "failed": ("in_progress",), "not_published": ("in_progress",), "terminal": (None, "in_progress", "failed"),
}
SCHEMA = "unit string, state string, attempts int, rows bigint, error string, started_at string, ended_at string, seq bigint"


class NotPublished(Exception):
    """The source does not hold the unit yet."""


class NothingInside(Exception):
    """The unit was read and holds no rows, and never will."""


@dataclass
class Summary:
    """What a run did, in units."""

    planned: int = 0
    attempted: int = 0
    completed: int = 0
    skipped: int = 0
    not_published: int = 0
    failed: int = 0
    terminal: int = 0
    rows: int = 0


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


class Manifest:
    """The states of a load's units, at a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], str] = now):
        self.store, self.clock = KeyedStore(spark, folder, SCHEMA, ["unit"], "seq"), clock
        self.spark = spark

    def states(self) -> DataFrame:
        return self.store.read()

    def _held(self, unit: str):
        return self.states().where(F.col("unit") == unit).first()

    def move(self, unit: str, state: str, rows: int | None = None, error: str | None = None, again: bool = False) -> None:
        """One transition; raises ``ValueError`` where it can't follow, but with ``again`` a done unit may start anew."""
        held = self._held(unit)
        before = held.state if held else None
        if before not in FOLLOWS[state] and not (again and state == "in_progress"):
            raise ValueError(f"{unit}: {state} can't follow {before}")
        starts, at = state == "in_progress", self.clock()
        attempts = (held.attempts if held else 0) + starts
        row = (unit, state, attempts, rows, error, at if starts or not held else held.started_at, None if starts else at, (held.seq if held else 0) + 1)
        self.store.upsert(self.spark.createDataFrame([row], SCHEMA))

    def mark_terminal(self, unit: str, why: str) -> None:
        """Take a unit out of the backlog for good; marking it twice is the same as once."""
        held = self._held(unit)
        if not held or held.state != "terminal":
            self.move(unit, "terminal", error=why)

    def run(self, units: Iterable[str], load: Callable[[str], int], force: bool = False, most: int | None = None, dry: bool = False) -> Summary:
        """Load every unit that is due, in order; a failed one is noted and the next one begins.

        ``load`` is a Spark job that returns how many rows it wrote.  With ``most`` only so many are attempted; a dry run
        leaves its units in progress, since nothing was written.
        """
        units = list(units)
        done = {r.unit for r in self.states().where(F.col("state").isin(*DONE)).select("unit").collect()}  # of a planned list
        out = Summary(planned=len(units))
        for unit in units:
            if unit in done and not force:
                out.skipped += 1
                continue
            if most is not None and out.attempted >= most:
                break
            out.attempted += 1
            self.move(unit, "in_progress", again=force)
            try:
                rows = load(unit)
            except NotPublished as error:
                self.move(unit, "not_published", error=str(error))
                out.not_published += 1
            except NothingInside as error:
                self.move(unit, "terminal", error=str(error))
                out.terminal += 1
            except Exception as error:  # noqa: BLE001  any failure is the unit's, the run goes on
                self.move(unit, "failed", error=str(error).split("\n")[0])
                out.failed += 1
            else:
                if not dry:
                    self.move(unit, "completed", rows=rows)
                    out.rows += rows
                out.completed += 1
        return out


def quarters(first: str, last: str) -> list[str]:
    """``2006q1`` and so on up to and with ``last``."""
    at, end = (int(x[:4]) * 4 + int(x[5:]) - 1 for x in (first.lower(), last.lower()))
    return [f"{k // 4}q{k % 4 + 1}" for k in range(at, end + 1)]


def due(planned: DataFrame, states: DataFrame, unit: str = "unit") -> DataFrame:
    """``planned`` units that are not done, with ``state`` and ``attempts`` (0 for those never tried)."""
    held = states.select(F.col("unit").alias(unit), "state", "attempts")
    rows = planned.join(held, unit, "left").where(F.col("state").isNull() | ~F.col("state").isin(*DONE))
    return rows.withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def backlog(planned: DataFrame, states: DataFrame, order: list, cap: int, unit: str = "unit") -> DataFrame:
    """The first ``cap`` due units in order, numbered, each with ``backlog``, the number of all that are due."""
    rows = due(planned, states, unit)
    total = rows.agg(F.count(F.lit(1)).alias("backlog")).withColumn("__one", F.lit(1))  # one row
    return R.top(rows, order, cap).withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")
