"""What a table covers, and what to say when a request reaches beyond it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = "1900-01-01"


@dataclass(frozen=True)
class Coverage:
    low: str | None
    high: str | None


def of(table: DataFrame, date: str) -> Coverage:
    """Smallest and largest date; the smallest is taken over plausible dates only."""
    row = table.agg(F.min(F.when(F.col(date) >= FLOOR, F.col(date))), F.max(date)).first()
    return Coverage(row[0], row[1])


def notice(
    coverage: Coverage | None,
    n: int,
    truncated: bool,
    since: list[str] | None = None,
    until: list[str] | None = None,
    known_gap: str | None = None,
    shallow: str | None = None,
) -> str | None:
    """The first that applies: a known gap, a shallow table, an empty answer, a page that ends outside the coverage.

    ``since`` and ``until`` are all window ends of the request; the widest window counts.
    """
    if known_gap or shallow:
        return known_gap or shallow
    start, end = min(since or [], default=None), max(until or [], default=None)
    if coverage is None:
        return "no rows match; coverage is unknown" if n == 0 and (start or end) else None
    if coverage.low is None or coverage.high is None:
        return "the table holds no rows" if n == 0 else None
    held = f"the table holds {coverage.low} to {coverage.high}"
    if start is None and end is None:
        return f"no rows match; {held}" if n == 0 else None
    before, after = start is not None and start < coverage.low, end is not None and end > coverage.high
    outside = (end is not None and end < coverage.low) or (start is not None and start > coverage.high)
    side = "older" if before else "newer"
    if n == 0:
        if outside:
            return f"no rows match; the window lies entirely outside: {held}"
        return f"no rows match; {held}" + (f", the window reaches to the {side} side" if before or after else "")
    if truncated and (before or after):
        return f"partial coverage on the {side} side: {held}"
    return None


def unanchored(name: str | None, *anchors: str | None) -> str | None:
    """What to say of a search by name alone, which finds a person's spellings and not the person."""
    return f"the search for '{name}' has no identifier beside the name, so an empty or short answer proves nothing" if name and not any(anchors) else None


def beyond(until: list[str] | None, loaded_through: str | None) -> str | None:
    """What to say of a window that ends after the last day that was loaded."""
    end = max(until or [], default=None)
    return f"loaded through {loaded_through} only; later days are missing" if end and loaded_through and end > loaded_through else None


def narrowed(field: str, value: object, absent: str) -> str | None:
    """What to say of a filter on a field that one kind of record never has."""
    return f"the filter on {field} leaves out {absent}, which never have it" if value else None


def joined(*notices: str | None) -> str | None:
    """All notices that apply, in order; a later one adds to the earlier ones."""
    return "; ".join(x for x in notices if x) or None
