"""Numbers: lenient parsing, rounding and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def exact_sum(value: Column) -> Column:
    """Sum that does not depend on the order of the rows."""
    return F.sum(value.cast(MONEY)).cast("double")


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(value + 0.5)


def pct_change(now: Column, before: Column) -> Column:
    """Change in per cent to two places; null without a prior value."""
    return F.when(before != 0, round_half_up((now - before) / before * 10000) / 100)


def pct_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def lenient_number(text: Column) -> Column:
    """The number a text begins with, exponent included, null if there is none."""
    form = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.nullif(F.regexp_extract(text, form, 1), F.lit("")).cast("double")


def amount_range(text: Column) -> tuple[Column, Column]:
    """Least and greatest dollar amount of a range; of ``Over $x`` the greatest is unknown."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"\$(\d+)"), 1), lambda x: x.cast("double"))
    low = F.get(found, F.lit(0))
    return low, F.when(F.lower(text).startswith("over"), None).otherwise(F.coalesce(F.get(found, F.lit(1)), low))
