"""An exact sliding limiter over a table: at most ``limit`` hits of a client in any window, rejected hits not recorded.

Whether a hit is admitted depends on which earlier ones were, so the rule is a fold in order of time.  Most hits need no
fold: one that has at most ``limit`` hits in its window, itself included, is admitted whatever happened before.  So the
clock is cut into slots as long as the window, and a slot is calm if all its hits are of that kind.  Behind a calm slot
the state is known, because it lies in the hits of that slot alone.  Only runs of slots that are not calm are folded,
each by itself, beginning with the hits of the calm slot before it; the client's other hits are dealt by slot and not by
client, so a client with a third of all hits is counted by as many tasks as it has slots.

A long run is cut at slots into chunks of about ``CHUNK_ROWS`` hits, which are folded in rounds: a round takes one chunk
of every run, sorted within its task and read in Arrow batches, and hands the admitted hits of its last slot, ``2 *
limit`` at most, to the next.  A task holds ``limit`` times and one batch; a lost executor repeats one chunk.

Results for odd input: hits of a null client are one client; a hit with a null time is rejected; equal times go by the
hit's number, repeated rows one by one; a limit of 0 rejects all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_folder, ship

#: A chunk ends with the slot in which it reaches so many hits.
CHUNK_ROWS = 1_000_000


def _written(df: DataFrame) -> DataFrame:
    path = fresh_folder(df.sparkSession, "limiter")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fold(limit: int, window: int):
    """Admission of sorted ``run, at, hit, known`` rows, ``known`` ones being admitted already and not returned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, kept = None, deque()
        for batch in batches:
            out = []
            runs, ats, known = (batch.column(x).to_pylist() for x in ("run", "at", "known"))
            for k, (own, at) in enumerate(zip(runs, ats, strict=True)):
                if own != run:
                    run, kept = own, deque()
                while kept and kept[0] <= at - window:
                    kept.popleft()
                admitted = known[k] or len(kept) < limit
                if admitted:
                    kept.append(at)
                out.append(admitted)
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "admitted"])
            yield rows.filter(pa.compute.invert(rows.column("known")))

    return work


def admitted(hits: DataFrame, limit: int, window: int) -> DataFrame:
    """``client, hit, admitted`` for every row of ``hits (client, hit long, at long)``; ``at`` and ``window`` in one unit.

    A hit looks back over ``(at - window, at]``.
    """
    spark = hits.sparkSession
    none = hits.where("at is null").select("client", "hit", F.lit(False).alias("admitted"))
    hits = hits.where("at is not null").select("client", "hit", F.col("at").cast("long").alias("at"))
    if limit < 1:
        return hits.select("client", "hit", F.lit(False).alias("admitted")).unionByName(none)
    ship(spark)
    slot = F.floor(F.col("at") / window).cast("long")
    slotted = hits.withColumn("slot", slot)
    # a hit counts in its own slot and, as one of the past, in the next; rows of a client are dealt by slot
    both = slotted.select("client", "hit", "at", F.explode(F.array("slot", F.col("slot") + 1)).alias("in_slot"), "slot")
    recent = Window.partitionBy("client", "in_slot").orderBy("at").rangeBetween(-window + 1, 0)
    counted = both.withColumn("n", F.count(F.lit(1)).over(recent)).where("slot = in_slot").drop("in_slot")
    counted = _written(counted)
    # as equal times count each other, the calm ones are those that even the last of them would be
    slots = counted.groupBy("client", "slot").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("n") <= limit).alias("calm"))
    busy = slots.where("not calm")
    in_order = Window.partitionBy("client").orderBy("slot")  # a row for each slot, not for each hit
    begins = (F.col("slot") - F.coalesce(F.lag("slot").over(in_order), F.lit(-(1 << 62)))) > 1
    runs = busy.withColumn("begins", begins).withColumn("run", F.last(F.when(F.col("begins"), F.col("slot")), ignorenulls=True).over(in_order))
    along = Window.partitionBy("client", "run").orderBy("slot")
    filled = F.floor(F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / CHUNK_ROWS)
    runs = runs.withColumn("filled", filled).withColumn("chunk", (F.dense_rank().over(Window.partitionBy("client", "run").orderBy("filled")) - 1).cast("long"))
    runs = _written(runs.select("client", "slot", "run", "chunk"))
    key = F.struct("client", "run").alias("run")
    matched = counted.join(runs, (counted["client"].eqNullSafe(runs["client"])) & (counted["slot"] == runs["slot"]), "left")
    matched = matched.select(counted["client"], "hit", "at", counted["slot"], "run", "chunk")
    calm = matched.where("run is null").select("client", "hit", F.lit(True).alias("admitted"))
    rows = matched.where("run is not null").select("client", key, "chunk", "slot", "at", "hit", F.lit(False).alias("known"))
    # the calm slot before a run, all of whose hits were admitted
    first = runs.where("slot = run").select(F.col("client").alias("c"), "run", (F.col("slot") - 1).alias("before"))
    past = counted.join(first, counted["client"].eqNullSafe(first["c"]) & (counted["slot"] == first["before"]))
    context = past.select("client", key, F.lit(0).cast("long").alias("chunk"), "slot", "at", "hit", F.lit(True).alias("known"))
    spread = _written(rows.unionByName(context))
    last = spread.agg(F.max("chunk")).first()[0]
    done = []
    for chunk in range(0 if last is None else last + 1):
        now = spread.where(F.col("chunk") == chunk)
        if done:
            now = now.unionByName(handed)  # noqa: F821  bound by the round before
        schema = now.schema.add("admitted", "boolean")
        folded = now.repartition("run").sortWithinPartitions("run", "at", "hit").mapInArrow(_fold(limit, window), schema)
        folded = _written(folded)
        # what the next chunk must know: admitted hits within a window of this one's last slot's end
        ends = folded.groupBy("run").agg(F.max("slot").alias("end"))
        carried = folded.where("admitted").join(ends, "run").where("slot = end")
        handed = carried.select("client", "run", F.lit(chunk + 1).cast("long").alias("chunk"), "slot", "at", "hit", F.lit(True).alias("known"))
        done.append(folded.select("client", "hit", "admitted"))
    out = calm.unionByName(none)
    for part in done:
        out = out.unionByName(part)
    return out
