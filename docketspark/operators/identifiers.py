"""Identifiers of issuers through three sources, each answer held against the issuer's name before it counts.

1. a map of instruments, whose own name must match the issuer's;
2. a catalogue of names, by the normalised name, the shortest identifier of several;
3. the results of searches by name, whose own name must match again.

Every issuer and name is looked up once: the steps run on distinct pairs of instrument and name, each step only on those
that the one before left open, and the answers join back.  A hot instrument is thus one row in every lookup.

Results for odd input: a null or blank identifier of a source is no answer; an issuer without a name takes the map's answer
unchecked, since an unknown name contradicts nothing, and is asked for nowhere else; null instruments are in no map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import relational as R


def _shortest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the shortest identifier, with its name; ties by text."""
    known = rows.where(F.coalesce(F.trim("ticker"), F.lit("")) != "")
    return R.rank_one(known, keys, [F.length("ticker"), F.asc("ticker"), F.asc_nulls_last("name")])


def validated(holdings: DataFrame, by_instrument: DataFrame, by_name: DataFrame, searched: DataFrame) -> DataFrame:
    """``holdings (instrument, issuer)`` and their other columns with ``ticker`` ("" if none) and ``step`` (1 to 3 or null).

    ``by_instrument (instrument, ticker, name)``, ``by_name (name, ticker)`` and ``searched (asked, ticker, name)`` are the sources.
    """
    asked = holdings.select("instrument", "issuer").distinct().withColumn("key", T.normalize_name(F.col("issuer")))
    named = F.coalesce(F.trim("issuer"), F.lit("")) != ""
    first = _shortest(by_instrument, ["instrument"]).select("instrument", F.col("ticker").alias("t1"), F.col("name").alias("n1"))
    rows = asked.join(first, "instrument", "left").withColumn("t1", F.when(T.names_match(F.col("issuer"), F.col("n1")), F.col("t1")))
    names = by_name.select("name", "ticker", T.normalize_name(F.col("name")).alias("key")).where("key <> ''")
    second = _shortest(names, ["key"]).select("key", F.col("ticker").alias("t2"))
    rows = rows.withColumn("key2", F.when(F.col("t1").isNull() & named & (F.col("key") != ""), F.col("key")))
    rows = rows.join(second.withColumnRenamed("key", "key2"), "key2", "left")
    third = _shortest(searched.where(T.names_match(F.col("asked"), F.col("name"))), ["asked"]).select(F.col("asked").alias("key3"), F.col("ticker").alias("t3"))
    rows = rows.withColumn("key3", F.when(F.coalesce("t1", "t2").isNull() & named, F.col("issuer"))).join(third, "key3", "left")
    step = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    answers = rows.select(F.col("instrument").alias("__i"), F.col("issuer").alias("__n"), F.coalesce("t1", "t2", "t3", F.lit("")).alias("ticker"), step.alias("step"))
    same = holdings["instrument"].eqNullSafe(answers["__i"]) & holdings["issuer"].eqNullSafe(answers["__n"])
    return holdings.join(answers, same, "left").drop("__i", "__n")


def learned(found: DataFrame) -> DataFrame:
    """``instrument, ticker, name, source`` that steps 2 and 3 found, a row for each instrument, for the map's next batch."""
    new = found.where("step > 1 and instrument is not null")
    source = F.when(F.col("step") == 2, "name_fallback").otherwise("name_search")
    rows = new.select("instrument", "ticker", F.col("issuer").alias("name"), source.alias("source"))
    return R.rank_one(rows, ["instrument"], [F.asc("source"), F.asc("ticker"), F.asc("name")])
