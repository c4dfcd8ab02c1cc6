"""A source's index against what the warehouse holds, for one collection or for all in one plan.

:func:`reconcile_all` tags every key with its collection and compares all collections by one aggregate over
(collection, key): sources and holdings are one table of marks, partly summed before they are moved, so a collection or
a key that many rows repeat is no hot group.  All tallies come from the table of distinct keys that this gives.

Results for odd input: a null key is left out on both sides; of a source's rows with one key the first by ``seq`` holds;
an empty source has a coverage of 0; a null year is counted as ``-``, a blank kind as ``(none)``; a class that the hook
does not know, or null, is ``unclassified``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import fresh_folder


@dataclass(frozen=True)
class Report:
    """Missing and extra keys, and the totals, as frames."""

    missing: DataFrame
    extra: DataFrame
    totals: DataFrame
    census: DataFrame


def reconcile(source: DataFrame, held: DataFrame, key: str, kind: str, expected: list[str]) -> Report:
    """Compare distinct keys; ``kind`` is counted with blank as ``(none)`` and expected kinds at zero.

    Coverage is present / source in per cent, 0 for an empty source.
    """
    first = R.rank_one(source, [key], [F.asc_nulls_last(kind)])
    marked = first.select(key, F.lit(1).alias("s")).join(held.select(key).distinct().withColumn("h", F.lit(1)), key, "full_outer")
    n, present = F.count("s"), F.count_if(F.col("s").isNotNull() & F.col("h").isNotNull())
    totals = marked.agg(
        n.alias("source"),
        present.alias("present"),
        F.count_if(F.col("h").isNull()).alias("missing"),
        F.count_if(F.col("s").isNull()).alias("extra"),
        F.when(n == 0, 0.0).otherwise(present * 100.0 / n).alias("coverage_pct"),
    )
    counted = held.groupBy(F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("(none)")).alias(kind)).agg(F.count("*").alias("n"))
    wanted = held.sparkSession.createDataFrame([(x,) for x in expected], f"{kind} string")
    census = wanted.join(counted, kind, "full_outer").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
    return Report(marked.where("h is null").select(key), marked.where("s is null").select(key), totals, census)


#: What a missing key can turn out to be.
CLASSES = ("recoverable", "nil", "unreadable", "gone", "unclassified")


@dataclass(frozen=True)
class Adapter:
    """One collection: ``source (key, year, seq)`` is what there should be, ``held (key, kind)`` what there is.

    ``classify`` gives the class of a missing key from the columns ``key, year, seq``; it is asked for the first keys of
    the source's order only, since it may be costly.
    """

    collection: str
    source: DataFrame
    held: DataFrame
    expected: tuple[str, ...] = ()
    classify: Callable[[], Column] | None = None


def _marks(adapter: Adapter) -> DataFrame:
    key = F.col("key").cast("string").alias("key")
    name = F.lit(adapter.collection).alias("collection")
    year = F.coalesce(F.col("year").cast("string"), F.lit("-"))
    source = adapter.source.select(name, key, F.struct(F.col("seq").cast("string").alias("seq"), year.alias("year")).alias("from_source"), F.lit(0).alias("held"))
    held = adapter.held.select(name, key, F.lit(None).alias("from_source"), F.lit(1).alias("held"))
    return source.unionByName(held).where("key is not null")


def states(adapters: list[Adapter]) -> DataFrame:
    """``collection, key, state, year, seq``: ``present``, ``missing`` or ``extra`` for every distinct key."""
    marks = reduce(DataFrame.unionByName, [_marks(a) for a in adapters])
    keys = marks.groupBy("collection", "key").agg(F.min("from_source").alias("s"), F.max("held").alias("held"))
    state = F.when(F.col("s").isNull(), "extra").when(F.col("held") == 1, "present").otherwise("missing")
    return keys.select("collection", "key", state.alias("state"), F.col("s")["year"].alias("year"), F.col("s")["seq"].alias("seq"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def totals(keys: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """``collection, source, present, missing, extra, coverage_pct`` of every adapter, those without any key too."""
    n = {x: F.count_if(F.col("state") == x) for x in ("present", "missing", "extra")}
    counted = keys.groupBy("collection").agg(*[c.alias(x) for x, c in n.items()])
    named = keys.sparkSession.createDataFrame([(a.collection,) for a in adapters], "collection string").join(counted, "collection", "left").na.fill(0)
    source = F.col("present") + F.col("missing")
    return named.select("collection", source.alias("source"), "present", "missing", "extra", _share(F.col("present"), source).alias("coverage_pct"))


def years(keys: DataFrame) -> DataFrame:
    """``collection, year, source, missing, coverage_pct``: the source's keys by year."""
    counted = keys.where("state <> 'extra'").groupBy("collection", "year").agg(F.count("*").alias("source"), F.count_if(F.col("state") == "missing").alias("missing"))
    return counted.withColumn("coverage_pct", _share(F.col("source") - F.col("missing"), F.col("source")))


def census(adapters: list[Adapter]) -> DataFrame:
    """``collection, kind, n, expected``: held records by kind, expected kinds at zero too."""
    kind = F.coalesce(F.nullif(F.col("kind").cast("string"), F.lit("")), F.lit("(none)"))
    rows = reduce(DataFrame.unionByName, [a.held.select(F.lit(a.collection).alias("collection"), kind.alias("kind")) for a in adapters])
    counted = rows.groupBy("collection", "kind").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(a.collection, x, True) for a in adapters for x in a.expected], "collection string, kind string, expected boolean")
    both = wanted.join(counted, ["collection", "kind"], "full_outer")
    return both.select("collection", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(False)).alias("expected"))


def classes(keys: DataFrame, adapters: list[Adapter], first: int | None = None) -> DataFrame:
    """``collection, class, n, unexplained`` of the missing keys of adapters that can classify, all classes.

    The hook is asked for the ``first`` keys of each source's order, or for all; the rest is unclassified.
    ``unexplained`` is the recoverable and unclassified ones together, null unless all were asked for.
    """
    parts = []
    for a in (a for a in adapters if a.classify is not None):
        missing = keys.where((F.col("collection") == a.collection) & (F.col("state") == "missing"))
        asked = missing if first is None else missing.orderBy("seq", "key").limit(first)
        found = asked.select("key", a.classify().alias("class"))
        known = F.when(F.col("class").isin(*CLASSES), F.col("class")).otherwise("unclassified")
        tally = found.agg(F.count("*").alias("asked"), *[F.count_if(known == x).alias(x) for x in CLASSES])  # one row
        all_ = missing.agg(F.count("*").alias("missing"))  # one row
        row = tally.withColumn("one", F.lit(1)).join(all_.withColumn("one", F.lit(1)), "one")
        rest = F.col("missing") - F.col("asked")
        whole = F.when(rest == 0, F.col("recoverable") + F.col("unclassified"))
        each = [F.struct(F.lit(x).alias("class"), (F.col(x) + rest if x == "unclassified" else F.col(x)).alias("n")) for x in CLASSES]
        parts.append(row.select(F.lit(a.collection).alias("collection"), F.explode(F.array(*each)).alias("x"), whole.alias("unexplained")).select("collection", "x.*", "unexplained"))
    empty = keys.sparkSession.createDataFrame([], "collection string, class string, n long, unexplained long")
    return reduce(DataFrame.unionByName, parts, empty)


def reconcile_all(adapters: list[Adapter], first: int | None = None) -> DataFrame:
    """All collections' tallies as ``collection, part, name, n, share``, from one table of distinct keys.

    Parts: ``total`` (source, present, missing, extra; the share is the coverage), ``source`` and ``missing`` by year, ``kind``
    of the held records, ``class`` of the missing keys, and ``unexplained``.
    """
    spark = adapters[0].source.sparkSession
    path = fresh_folder(spark, "reconciled")
    found = states(adapters)
    found.write.parquet(path)
    keys = spark.read.schema(found.schema).parquet(path)
    none = F.lit(None).cast("double")

    def rows(df: DataFrame, part, name, n, share=none) -> DataFrame:
        return df.select("collection", F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"), share.alias("share"))

    sums, by_year, of_class = totals(keys, adapters), years(keys), classes(keys, adapters, first)
    out = [rows(sums, "total", F.lit(x), F.col(x), F.col("coverage_pct") if x == "source" else none) for x in ("source", "present", "missing", "extra")]
    out += [rows(by_year, "source", F.col("year"), F.col("source"), F.col("coverage_pct")), rows(by_year.where("missing > 0"), "missing", F.col("year"), F.col("missing"))]
    out += [rows(census(adapters), "kind", F.col("kind"), F.col("n")), rows(of_class, "class", F.col("class"), F.col("n"))]
    out.append(rows(of_class.where("class = 'recoverable' and unexplained is not null"), "unexplained", F.lit("unexplained"), F.col("unexplained")))
    return reduce(DataFrame.unionByName, out)
