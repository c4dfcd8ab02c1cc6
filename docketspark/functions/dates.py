"""Dates as ISO text: parsing, labels, lags and calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as three letters.
MONTHS = {
    "JAN": "01", "FEB": "02", "MAR": "03", "APR": "04", "MAY": "05", "JUN": "06",
    "JUL": "07", "AUG": "08", "SEP": "09", "OCT": "10", "NOV": "11", "DEC": "12",
}


def month_number(name: Column) -> Column:
    """Two digits of a month's three letters in any case, null for all else."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.upper(name))


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def parse_day_month_year(text: Column) -> Column:
    """``D-MON-YYYY`` in any case to ISO text, null if it is not of that form."""
    form = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"
    month = month_number(F.regexp_extract(text, form, 2))
    return F.when(text.rlike(form) & month.isNotNull(), F.concat_ws("-", F.regexp_extract(text, form, 3), month, F.lpad(F.regexp_extract(text, form, 1), 2, "0")))


def parse_day_month(text: Column, year: Column) -> Column:
    """``D-Mon`` in any case and a year of its own to ISO text, null if it is not of that form."""
    form = r"^\s*(\d{1,2})-([A-Za-z]{3})\s*$"
    month = month_number(F.regexp_extract(text, form, 2))
    made = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, F.lpad(F.regexp_extract(text, form, 1), 2, "0"))
    return F.when(text.rlike(form) & month.isNotNull() & year.isNotNull(), made)


def lookback_days(asked: Column, least: int = 1, most: int = 3650, default: int = 365) -> Column:
    """Days to look back: within bounds, and the default where none are asked for."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(default)), F.lit(least)), F.lit(most))


def parse_us(text: Column) -> Column:
    """``M/D/YYYY`` to ISO text; ISO text passes; anything else is null."""
    form = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    made = F.concat_ws("-", F.regexp_extract(text, form, 3), *[F.lpad(F.regexp_extract(text, form, k), 2, "0") for k in (1, 2)])
    return F.when(text.rlike(form), made).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)


def parse_compact(text: Column) -> Column:
    """``YYYYMMDD`` to ISO text; zeros and other forms are blank."""
    made = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(r"^\d{8}$") & (text != "00000000"), made).otherwise("")


def epoch_date(seconds: Column) -> Column:
    return iso(F.timestamp_seconds(seconds))


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(\d{4})-", 1), F.lit("")).cast("int")


def period_label(moment: Column, kind: str) -> Column:
    """Fixed-width label of a month, quarter, ISO week, day of year or year; its text order is its time order."""
    year = F.date_format(moment, "yyyy")
    if kind == "M":
        return F.concat(year, F.lit("M"), F.date_format(moment, "MM"))
    if kind == "Q":
        return F.concat(year, F.lit("Q"), F.lpad(F.quarter(moment).cast("string"), 2, "0"))
    if kind == "W":
        week_year = F.extract(F.lit("YEAROFWEEK"), moment).cast("string")
        return F.concat(week_year, F.lit("W"), F.lpad(F.weekofyear(moment).cast("string"), 2, "0"))
    if kind == "D":
        return F.concat(year, F.lit("D"), F.lpad(F.dayofyear(moment).cast("string"), 3, "0"))
    return F.concat(year, F.lit("A01"))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in ``[earlier, later)``: whole weeks have five, the rest is counted from the weekday."""
    low, high = F.least(start, end), F.greatest(start, end)
    days = F.datediff(high, low)
    first = F.weekday(low)  # Monday is 0
    rest = days % 7
    weekend = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(
        F.lit(0), F.least(first + rest, F.lit(14)) - 12
    )
    return (F.floor(days / 7) * 5 + rest - weekend).cast("int")


def span_kind(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    out = F.when(days.between(80, 100), "Q").when(days.between(175, 195), "H").when(days.between(265, 285), "9M")
    return out.when(days.between(355, 380), "FY").otherwise("other")


def corrected_date(value: Column, candidates: dict[str, Column], ahead: int = 2) -> Column:
    """A date whose year lies ``ahead`` or more years after the first plausible corroborating year gets that year.

    Returns ``value, source, corrected, basis``.
    """
    year = year_of(value)
    plausible = [F.when(y.between(1900, 2099), F.struct(y.alias("year"), F.lit(name).alias("basis"))) for name, y in candidates.items()]
    first = F.coalesce(*plausible)
    wrong = F.coalesce(year - first["year"] >= ahead, F.lit(False))
    fixed = F.concat(first["year"].cast("string"), F.substring(value, 5, 6))
    return F.struct(
        F.when(wrong, fixed).otherwise(value).alias("value"),
        F.when(wrong, value).alias("source"),
        wrong.alias("corrected"),
        F.when(wrong, first["basis"]).alias("basis"),
    )


#: Zones by name and their minutes from UTC, as feeds write them.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}


def rfc_date(text: Column) -> Column:
    """``[Tue, ]5 Nov 2024 14:30[:00] zone`` to ``2024-11-05T14:30:00Z``, null if it is not of that form.

    Zones are :data:`ZONES` or ``+hhmm``; years of two digits are of this century up to 49.
    """
    form = r"^\s*(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]{1,4}|[+-]\d{4})\s*$"
    part = lambda k: F.regexp_extract(text, form, k)
    number = lambda k: part(k).try_cast("int")
    year = F.when(F.length(part(3)) == 4, number(3)).when(number(3) < 50, number(3) + 2000).otherwise(number(3) + 1900)
    zone = F.upper(part(7))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), zone)
    signed = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    minutes = F.when(zone.startswith("+"), signed).when(zone.startswith("-"), -signed).otherwise(named)
    seconds = F.coalesce(F.nullif(part(6), F.lit("")), F.lit("0")).try_cast("int")
    local = F.try_make_timestamp_ntz(year, month_number(part(2)).try_cast("int"), number(1), number(4), number(5), seconds)
    return F.date_format(local - F.make_dt_interval(mins=minutes), "yyyy-MM-dd'T'HH:mm:ss'Z'")
