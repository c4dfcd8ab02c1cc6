"""Operators that every query shares: ranking, keyed merging, comparison and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column], n: int, ordinal: str = "rn") -> DataFrame:
    """The first ``n`` rows in a total order, numbered; a top-k, so only ``n`` rows of each task are moved."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn(ordinal, F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in a total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, ordinal: str = "rn") -> DataFrame:
    return df.withColumn(ordinal, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(ordinal) <= n)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Row replacement: of each key the row with the highest sequence."""
    return rank_one(base.unionByName(changes, allowMissingColumns=True), keys, [F.desc(sequence)])


def merge_fields(base: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, present: str) -> DataFrame:
    """Field-level merge: ``present`` names the columns each change sets; an unset column keeps its older value.

    A column that is set to null overwrites; the last change that sets a column wins.
    """
    columns = [c for c in base.columns if c not in (*keys, sequence)]
    whole = base.withColumn(present, F.array(*map(F.lit, columns)))
    rows = whole.unionByName(changes, allowMissingColumns=True)
    picked = [
        F.max_by(F.struct(F.col(c)), F.when(F.array_contains(present, c), F.col(sequence))).getField(c).alias(c) for c in columns
    ]
    return rows.groupBy(*keys).agg(*picked, F.max(sequence).alias(sequence))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def full_compare(now: DataFrame, before: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison of one value: both values, the change and what happened."""
    both = now.withColumnRenamed(value, "now").join(before.withColumnRenamed(value, "before"), list(keys), "full_outer")
    change = F.when(F.col("now").isNull(), -F.col("before")).when(F.coalesce("before", F.lit(0.0)) == 0, F.col("now"))
    kind = (
        F.when(F.col("now").isNull(), "closed")
        .when(F.coalesce("before", F.lit(0.0)) == 0, "new")
        .when(F.col("now") > F.col("before"), "increased")
        .when(F.col("now") < F.col("before"), "decreased")
        .otherwise("unchanged")
    )
    return both.select(*keys, "now", "before", change.otherwise(F.col("now") - F.col("before")).alias("change"), kind.alias("position_change"))


def guarded_prune(existing: DataFrame, fresh: DataFrame, key: str, least_share: float = 0.5) -> DataFrame:
    """Keys to delete: those a fresh snapshot lacks, none if the snapshot has under ``least_share`` of the existing."""
    have, got = existing.select(key).distinct(), fresh.select(key).distinct()
    sides = have.select(F.lit(1).alias("__old")).unionByName(got.select(F.lit(0).alias("__old")))
    sizes = sides.agg(F.count_if(F.col("__old") == 1).alias("__have"), F.count_if(F.col("__old") == 0).alias("__got"))  # one row
    ok = sizes.where((F.col("__have") == 0) | (F.col("__got") >= least_share * F.col("__have"))).select(F.lit(1).alias("__ok"))
    return have.join(got, key, "left_anti").withColumn("__ok", F.lit(1)).join(F.broadcast(ok), "__ok").drop("__ok")


def nest(children: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Children of each key as an array of structs, in a fixed order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return children.groupBy(key).agg(ordered.alias(name))


def unique_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that lead to exactly one value, with it; ambiguous keys are left out."""
    counted = df.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value))
    return counted.where("__n = 1").drop("__n")


def position_changes(now: DataFrame, before: DataFrame, holder: str, key: str, value: str, verified: str) -> DataFrame:
    """Each holder's positions against the period before, and what can't be known.

    ``verified`` says of each row of ``now`` whether its filing was complete.  A holder without any earlier position,
    or with an incomplete filing, gets ``INSUFFICIENT_DATA`` and no change on all rows; only for the others do earlier
    positions that are missing now come back as ``closed``, with a value of 0.  Holders without a row in ``now`` are
    left out.
    """
    filings = now.groupBy(holder).agg(F.bool_and(F.coalesce(F.col(verified), F.lit(False))).alias("__whole"))
    states = filings.join(before.select(holder).distinct().withColumn("__prior", F.lit(True)), holder, "left")
    left = now.select(holder, key, F.col(value).alias("now"), F.lit(True).alias("__held"))
    both = left.join(before.select(holder, key, F.col(value).alias("before")), [holder, key], "full_outer").join(states, holder)
    sure, gone = F.col("__whole") & F.coalesce("__prior", F.lit(False)), F.col("__held").isNull()
    both = both.withColumn("__sure", sure).where(~gone | (F.col("__sure") & (F.col("before") != 0)))
    fresh, held = F.coalesce("before", F.lit(0)) == 0, F.when(gone, 0).otherwise(F.col("now"))
    change = held - F.coalesce("before", F.lit(0))
    kind = F.when(~F.col("__sure"), "INSUFFICIENT_DATA").when(gone, "closed").when(fresh, "new")
    kind = kind.when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged")
    pct = F.floor(change / F.col("before") * 10000 + 0.5) / 100
    return both.select(
        holder, key, held.alias("now"), F.when(F.col("__sure"), change).alias("change"),
        F.when(F.col("__sure") & (F.col("before") > 0), pct).alias("pct"), kind.alias("position_change"),
    )


def supersede(rows: DataFrame, keys: Sequence[str], filed: str, sequence: str, first: Sequence[str], filled: Sequence[str]) -> DataFrame:
    """One row for each key: the latest filed, but ``first`` columns of the earliest filed and ``filled`` ones never blank if any is not.

    ``filed`` is ISO text and ``sequence`` a number that is the order of the rows.  Rows without a filing date supersede
    nothing: where all of a key are so, the first of them holds.  Of equal dates the later row is the latest, the earlier one the
    earliest.  A blank ``filled`` value takes that of the first row that has one.
    """
    dated = F.coalesce(F.col(filed), F.lit("")) != ""
    at = F.coalesce(F.col(filed), F.lit(""))
    latest = F.struct(dated, at, F.when(dated, F.col(sequence)).otherwise(-F.col(sequence)))
    earliest = F.struct(~dated, at, F.col(sequence))
    rest = [c for c in rows.columns if c not in keys]
    present = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(sequence))
    grouped = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), latest).alias("__last"), *[F.min_by(c, earliest).alias(f"__first_{c}") for c in first], *[F.min_by(c, present(c)).alias(f"__any_{c}") for c in filled],
    )
    own = lambda c: F.col("__last")[c]
    made = [F.col(f"__first_{c}") if c in first else F.when(F.coalesce(own(c), F.lit("")) != "", own(c)).otherwise(F.coalesce(f"__any_{c}", own(c))) if c in filled else own(c) for c in rest]
    return grouped.select(*keys, *[x.alias(c) for x, c in zip(made, rest, strict=True)])
