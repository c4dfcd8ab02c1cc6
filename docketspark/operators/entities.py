"""Tiered entity resolution: rows that name a member are led to the one member whom a tier makes certain.

Four tiers, the first that answers wins:

1. chamber, state and last name lead to the current member (of several entries the latest holds);
2. without regard to the state, for the senate: the only senator of a last name, or the only one among several whose
   first name or nickname is the first word of the given name;
3. the only current member of the chamber (and of the state, where given) whose compound surname ends in the name;
4. the only former member of that name, chamber and state (any state, for the senate without one) who was in office on
   the row's day.

Every tier is a key that must lead to exactly one entry.  The roster writes out all its keys and one aggregate counts
the entries of each, so a list of candidates is never gathered; a name writes out the keys that it asks for, and one
equi-join answers the first three tiers.  Terms of office are dealt to the calendar years that they touch, so the fourth
tier too is an equi-join, by state and year, and only then by the days; terms of one period are merged before.  Roster,
terms and names grow with the tables and are larger than their files, so no join broadcasts them.  Names are asked and not rows: however many rows share a
name, it is looked up once, and the answer joins back by the name.

Results for odd input: blank and null count alike; a row without a last name is led nowhere; a day that is no date is in
no term; roster entries without an id, chamber, state or last name take no part; two entries of one id under one key are
two, so ambiguous; an empty roster leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: generational suffixes behind a comma.
SUFFIX = r",\s*(jr|sr|ii|iii|iv|v)\.?\s*$"
SENATE = "senate"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x01", F.lit(kind), *parts)


def _current(roster: DataFrame) -> DataFrame:
    rows = roster.select(
        F.col("id"), _text("chamber").alias("chamber"), F.upper(_text("state")).alias("state"), F.lower(_text("last")).alias("last"),
        F.lower(_text("first")).alias("first"), F.lower(_text("nickname")).alias("nickname"), _text("party").alias("party"), "seq",
    )
    return rows.where((F.coalesce("id", F.lit("")) != "") & (F.col("chamber") != "") & (F.col("state") != "") & (F.col("last") != ""))


def _former(terms: DataFrame) -> DataFrame:
    rows = terms.select(
        "id", _text("chamber").alias("chamber"), F.upper(_text("state")).alias("state"), F.lower(_text("last")).alias("last"), _text("start").alias("start"),
        _text("end").alias("end"), _text("party").alias("party"), "seq",
    )
    whole = (F.coalesce("id", F.lit("")) != "") & (F.col("chamber") != "") & (F.col("state") != "") & (F.col("start") != "") & (F.col("end") != "")
    return rows.where(whole & (F.col("last") != ""))


def _year(day: str) -> Column:
    return F.regexp_extract(F.col(day), r"^(\d{4})(?:-|$)", 1).try_cast("int")


def asked_names(rows: DataFrame) -> DataFrame:
    """``rows`` with the key that all tiers ask by: chamber, state, last name, first word of the given name, day."""
    last = F.trim(F.regexp_replace(F.lower(_text("last")), SUFFIX, ""))
    given = F.element_at(F.split(F.trim(F.lower(_text("first"))), r"\s+"), 1)
    day = F.coalesce(F.nullif("date", F.lit("")), F.nullif("disclosed", F.lit("")), F.lit(""))
    return rows.withColumns({"__chamber": _text("chamber"), "__state": F.upper(_text("state")), "__last": last, "__given": given, "__day": day})


KEY = ["__chamber", "__state", "__last", "__given", "__day"]


#: Which tier each of a name's keys belongs to, in the order in which they answer: the last is a term of office.
ORDER = (1, 2, 2, 3, 4)


def index(roster: DataFrame) -> DataFrame:
    """``key, id`` of every key of the current roster that is certain."""
    chamber, state, last, word = F.col("chamber"), F.col("state"), F.col("last"), F.element_at(F.split("last", r"\s+"), -1)
    senate, compound = chamber == SENATE, (word != "") & (word != last)
    called = F.filter(F.array_distinct(F.array("first", "nickname")), lambda x: x != "")
    keys = F.concat(
        F.array(_key("state", chamber, state, last)),
        F.when(senate, F.concat(F.array(_key("sole", last)), F.transform(called, lambda x: _key("called", last, x)))).otherwise(F.array()),
        F.when(compound, F.array(_key("word", chamber, state, word), _key("word", chamber, word))).otherwise(F.array()),
    )
    rows = _current(roster).select("id", "seq", F.explode(keys).alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "seq").alias("id"))
    return counted.where((F.col("n") == 1) | F.col("key").startswith("state\x01")).select("key", "id")  # the latest of one seat holds


def in_office(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Names (columns :data:`KEY`) with the ``id`` of the only former member in office on their day."""
    # an entry is one member's terms under one chamber, state and name; it counts once however many terms hold the day.
    # Of entries with one period the first and the last suffice: an answer is certain where these are one over all periods
    key = ["chamber", "state", "last", "start", "end"]
    former = _former(terms).where(_year("start").isNotNull() & _year("end").isNotNull())
    entry = F.struct("id", F.col("state").alias("of_state"))
    periods = former.groupBy(*key).agg(F.min(entry).alias("low"), F.max(entry).alias("high"))
    anywhere = periods.where(F.col("chamber") == SENATE).groupBy("chamber", "last", "start", "end").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    periods = periods.unionByName(anywhere.withColumn("state", F.lit("")))  # no term has a blank state of its own
    years = F.explode(F.sequence(_year("start"), F.greatest(_year("start"), _year("end"))))
    dealt = periods.select(*[F.col(x).alias(f"__{x}") for x in key[:3]], "start", "end", "low", "high", years.alias("year"))
    days = names.where("__day <> ''").withColumn("year", _year("__day"))
    held = days.join(dealt.hint("merge"), ["__chamber", "__state", "__last", "year"]).where("start <= __day and __day <= end")
    entries = held.groupBy(*KEY).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return entries.where("low = high").select(*KEY, F.col("low")["id"].alias("id"))


def answers(names: DataFrame, roster: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct ``names`` (columns :data:`KEY`) that a tier leads somewhere, with ``__id`` and ``tier``."""
    names = names.where("__last <> ''")
    chamber, state, last, given = (F.col(x) for x in KEY[:4])
    senate = chamber == SENATE
    asked = F.array(
        F.struct(F.lit(0).alias("at"), F.when(state != "", _key("state", chamber, state, last)).alias("key")),
        F.struct(F.lit(1).alias("at"), F.when(senate, _key("sole", last)).alias("key")),
        F.struct(F.lit(2).alias("at"), F.when(senate & (given != ""), _key("called", last, given)).alias("key")),
        F.struct(F.lit(3).alias("at"), F.when(state != "", _key("word", chamber, state, last)).otherwise(_key("word", chamber, last)).alias("key")),
    )
    asked = names.withColumn("__a", F.explode(asked)).select(*KEY, "__a.*").where("key is not null")
    found = asked.join(index(roster).hint("merge"), "key").select(*KEY, "at", "id")
    found = found.unionByName(in_office(names, terms).withColumn("at", F.lit(len(ORDER) - 1)))
    first = found.groupBy(*KEY).agg(F.min(F.struct("at", "id")).alias("x"))
    return first.select(*KEY, F.col("x")["id"].alias("__id"), F.element_at(F.array(*map(F.lit, ORDER)), F.col("x")["at"] + 1).alias("tier"))


def facts(roster: DataFrame, terms: DataFrame) -> DataFrame:
    """``id, known_party, known_state`` of every member: of the current roster, else of the first whole term."""
    current = _current(roster).select("id", "party", "state", F.struct(F.lit(0).alias("a"), (-F.col("seq")).cast("double").alias("b")).alias("order"))
    former = _former(terms).select("id", "party", "state", F.struct(F.lit(1).alias("a"), F.col("seq").cast("double").alias("b")).alias("order"))
    x = current.unionByName(former).groupBy("id").agg(F.min_by(F.struct("party", "state"), "order").alias("x"))
    return x.select("id", F.col("x")["party"].alias("known_party"), F.col("x")["state"].alias("known_state"))


def resolve(rows: DataFrame, roster: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with blank ``id``, ``party`` and ``state`` filled, and ``tier``: 1 to 4, or null where no tier answered.

    ``rows`` holds ``id, chamber, state, last, first, date, disclosed, party`` and whatever else; ``roster`` holds
    ``id, chamber, state, last, first, nickname, party, seq`` and ``terms`` ``id, last, chamber, state, start, end,
    party, seq``, a row for each term; ``seq`` is a number.  Rows that have an ``id`` keep all they have.
    """
    asked = asked_names(rows).withColumn("__open", _text("id") == "")
    names = answers(asked.where("__open").select(*KEY).distinct(), roster, terms)
    names = names.join(facts(roster, terms).withColumnRenamed("id", "__id").hint("merge"), "__id", "left").withColumn("__open", F.lit(True))
    joined = asked.join(names.hint("merge"), [*KEY, "__open"], "left")
    filled = {
        "id": F.when(F.col("__open"), F.coalesce("__id", _text("id"))).otherwise(F.col("id")),
        "party": F.when(F.col("__id").isNotNull() & (_text("party") == ""), F.coalesce("known_party", F.lit(""))).otherwise(F.col("party")),
        "state": F.when(F.col("__id").isNotNull() & (_text("state") == ""), F.coalesce("known_state", F.lit(""))).otherwise(F.col("state")),
    }
    return joined.withColumns(filled).select(*rows.columns, "tier")
