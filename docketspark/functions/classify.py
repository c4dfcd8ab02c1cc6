"""Derived classification columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, COMP, TRANSFER, UNKNOWN = "OPEN_MARKET", "EQUITY_COMP", "NON_OPEN_MARKET_TRANSFER", "INSUFFICIENT_DATA"
#: First letters of transaction codes and what they mean.
NATURES = {OPEN: ["P", "S"], COMP: ["A", "M", "I", "C", "X", "O"], TRANSFER: ["D", "F", "G", "W", "Z", "U"]}
#: Words that mark a gift.
GIFT_WORDS = r"(?i)\b(contribution|contributed|gift(?:ed|ing|s)?|donat\w*|charitab\w*)\b"
#: Dates that mean "no date" in two of the date fields, the flags, and each field's latest plausible date.
NO_DATE = ["2050-12-31", "2050-08-31"]
SENTINEL, ANOMALY = "sec_perpetual_sentinel", "anomalous_year_likely_filer_entry"
LATEST = {"transaction_date": "2027-01-01", "period_of_report": "2027-01-01", "exercise_date": "2050-01-01", "expiration_date": "2050-01-01"}


def nature(code: Column) -> Column:
    """Nature of a transaction by the part of its code before the slash."""
    first = F.upper(F.trim(F.substring_index(F.trim(code), "/", 1)))
    out = F.when(F.coalesce(F.trim(code), F.lit("")) == "", UNKNOWN)
    for name, codes in NATURES.items():
        out = out.when(first.isin(codes), name)
    return out.otherwise(UNKNOWN)


def comment_nature(comment: Column, kind: Column) -> Column:
    out = F.when(F.coalesce(comment.rlike(GIFT_WORDS), F.lit(False)), TRANSFER).when(kind.isin("buy", "sell"), OPEN)
    return out.when(kind == "exchange", TRANSFER).otherwise(UNKNOWN)


def direction(code: Column, acquired: Column) -> Column:
    """Buy or sell by the code, else by the acquired/disposed mark, else by codes that acquire."""
    out = F.when(code == "P", "buy").when(code == "S", "sell").when(acquired == "A", "buy").when(acquired == "D", "sell")
    return out.when(code.isin("A", "M", "X", "C", "I"), "buy").otherwise("sell")


def code_map(code: Column, table: dict[str, str]) -> Column:
    """Mapped value, or the code itself."""
    out = F.when(F.lit(False), code)
    for key, value in table.items():
        out = out.when(code == key, value)
    return out.otherwise(code)


def date_flags(field: str, value: Column) -> Column:
    """Flag of one date field: sentinel before anomalous year; null when clean, blank or null."""
    out = F.when(F.coalesce(value, F.lit("")) == "", None)
    if field in ("exercise_date", "expiration_date"):
        out = out.when(value.isin(NO_DATE), SENTINEL)
    return out.when((value < "1990-01-01") | (value > LATEST[field]), ANOMALY)


def source_metadata(fields: dict[str, Column]) -> Column:
    """Map of field to flags, null when no field is flagged; the fields themselves never change."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.array(date_flags(k, v)).alias("value")) for k, v in fields.items()]),
        lambda x: x["value"][0].isNotNull(),
    )
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def word_density_low(text: Column, pages: Column, least: float = 5) -> Column:
    """Whether a text has at most ``least`` words of three letters or more a page."""
    return F.regexp_count(text, F.lit("[A-Za-z]{3,}")) / F.greatest(pages, F.lit(1)) <= least


def role_flags(text: Column) -> dict[str, Column]:
    upper = F.upper(text)
    return {
        "is_director": upper.contains("DIRECTOR"),
        "is_officer": upper.contains("OFFICER"),
        "is_ten_percent": upper.contains("10") | upper.contains("TEN") | upper.contains("PERCENT"),
        "is_other": upper.contains("OTHER"),
    }


#: Exchange codes of US listings, and the one-letter tickers that are real.
US_EXCHANGES = ["US", "UN", "UQ", "UR", "UW", "UA", "UV", "UF", "UP", "UD", "UB"]
ONE_LETTER = ["V", "C", "F", "T", "S", "X", "K", "M", "O", "U", "Z"]


def bad_ticker(ticker: Column) -> Column:
    """Whether a text is no plausible equity ticker: none, with white space, ending in USD, or an unknown single letter."""
    alone = (F.length(ticker) == 1) & ~F.upper(ticker).isin(ONE_LETTER)
    return F.coalesce(ticker == "", F.lit(True)) | F.coalesce(ticker.rlike(r"\s") | F.upper(ticker).endswith("USD") | alone, F.lit(True))


def filer_type(position: Column) -> Column:
    """``cabinet`` for secretaries (one misspelling included) and attorneys general, not their deputies; blank is ``other``."""
    low = F.lower(F.coalesce(position, F.lit("")))
    heads = low.rlike(r"secret\w{0,4}ary") | low.contains("attorney general")
    below = low.rlike(r"\b(deputy|under|assistant|acting)\b")
    return F.when(heads & ~below, "cabinet").when(F.trim(low) == "", "other").otherwise("appointee")


def owner(text: Column) -> Column:
    """Who holds an asset by its text: a dependent before a spouse, else the filer."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\bdependent\b"), "dependent").when(low.rlike(r"\bspouse'?s?\b"), "spouse").otherwise("self")
