"""Connected components of a set of links, by contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, ship

#: So few links (8 MB) are finished by one task instead of further rounds of joins.
FINISH = 1 << 19


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The lowest node that the links ``(a, b)`` reach from each of the nodes 0 to n - 1."""
    low = np.arange(n)
    while (low[a] != low[b]).any():  # hook the higher root to the lower one, then shorten all paths
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
    return low


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``from, to``: every node of at most ``FINISH`` links and the lowest node of its component."""
    links = [np.stack([x.column("a").to_numpy(), x.column("b").to_numpy()]) for x in batches]
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = lowest(at[: len(a)], at[len(a) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["from", "to"])


def components(links: DataFrame) -> DataFrame:
    """Component of every node of ``links (a long, b long)``: rows ``(node, component)``, the smallest node's id.

    Nodes have a fixed random rank, a hash of the id.  Each round maps every node to the lowest-ranked of its neighbours
    and itself, then contracts the links to the mapped nodes: a star is done in two rounds, and a chain of any ids loses
    a fixed share of its nodes every round.  As soon as no more than ``FINISH`` links are left, one task ends the work.
    Minima are pre-aggregated; a node's links do meet in one join partition, which adaptive execution splits where it is
    large, so callers should link large groups as stars of distinct members.  Self links only add their node; null ends
    are left out.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    left = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    ship(links.sparkSession)
    while True:
        left = cut(left)
        n = left.count()
        if not n:
            break
        if n <= FINISH:
            low = cut(left.coalesce(1).mapInArrow(finish, "from long, to long"))
        else:
            low = cut(
                left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .groupBy("a")
                .agg(F.min(rank("b")).alias("best"))
                .select(F.col("a").alias("from"), F.when(F.col("best") < rank("a"), F.col("best")["b"]).otherwise(F.col("a")).alias("to"))
            )
        nodes = nodes.join(low.withColumnRenamed("from", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        if n <= FINISH:
            break
        first = low.select(F.col("from").alias("a"), F.col("to").alias("x"))
        second = low.select(F.col("from").alias("b"), F.col("to").alias("y"))
        left = (
            left.join(first, "a")
            .join(second, "b")
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
        )
    least = nodes.groupBy("component").agg(F.min("node").alias("least"))
    return nodes.join(least, "component").select("node", F.col("least").alias("component"))


def named(heads: DataFrame, links: DataFrame) -> DataFrame:
    """``heads`` (id, node and more) with ``first (id, node)``: the smallest member of each row's component.

    Nodes are numbers of their own where ids repeat, so the smallest id is found after the components.
    """
    found = heads.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"))
    return found.join(least, "component").drop("component")
