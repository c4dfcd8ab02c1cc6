"""Report sinks of a reconciliation: a page for people, a text for a repository, and the whole lists as CSV.

The tallies are few rows (collections by years, kinds and classes) and are laid out by the driver; the lists of missing and
extra keys may be as long as the collections and are written by Spark, whole, never cut to what a page shows.
"""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.keyed_store import Files


def _tables(rows: Iterable) -> list[tuple[str, list[tuple[str, list[str], list[list[str]]]]]]:
    """Of every collection its tables: heading, columns and cells, in a fixed order."""
    by: dict[str, dict[str, dict[str, tuple[int, float | None]]]] = {}
    for r in rows:
        by.setdefault(r["collection"], {}).setdefault(r["part"], {})[r["name"]] = (r["n"], r["share"])
    out = []
    for name, parts in sorted(by.items()):
        total, years, gone = parts.get("total", {}), parts.get("source", {}), parts.get("missing", {})
        share = total.get("source", (0, None))[1]
        tables = [("Totals", ["source", "present", "missing", "extra", "coverage"], [[*[str(total.get(x, (0, None))[0]) for x in ("source", "present", "missing", "extra")], _percent(share)]])]
        tables.append(("Coverage by year", ["year", "source", "have", "missing", "coverage"], [[y, str(n), str(n - gone.get(y, (0, None))[0]), str(gone.get(y, (0, None))[0]), _percent(p)] for y, (n, p) in sorted(years.items())]))
        tables.append(("Records by kind", ["kind", "records", "state"], [[k, str(n), "present" if n else "READS ZERO"] for k, (n, _) in sorted(parts.get("kind", {}).items())]))
        if "class" in parts:
            cells = [[k, str(n)] for k, (n, _) in sorted(parts["class"].items())]
            cells += [[f"{k} (should be 0)", str(n)] for k, (n, _) in parts.get("unexplained", {}).items()]
            tables.append(("Missing by class", ["class", "keys"], cells))
        out.append((name, tables))
    return out


def _percent(share: float | None) -> str:
    return "-" if share is None else f"{share:.2f} %"


def markdown(rows: Iterable) -> str:
    """The tallies as headed tables; bars in cells are escaped."""
    cell = lambda x: x.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(map(cell, cells)) + " |"
    out = []
    for name, tables in _tables(rows):
        out += [f"# {cell(name)}", ""]
        for heading, columns, cells in tables:
            out += [f"## {heading}", "", line(columns), "|" + " --- |" * len(columns), *map(line, cells), ""]
    return "\n".join(out)


def page(rows: Iterable) -> str:
    """The tallies as a page; everything that comes from the data is escaped."""
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in cells) + "</tr>"
    out = ["<!doctype html><meta charset='utf-8'>"]
    for name, tables in _tables(rows):
        out.append(f"<h1>{html.escape(name)}</h1>")
        for heading, columns, cells in tables:
            out += [f"<h2>{heading}</h2><table>", row("th", columns), *[row("td", x) for x in cells], "</table>"]
    return "\n".join(out)


def write(tallies: DataFrame, keys: DataFrame, folder: str) -> None:
    """``report.md``, ``report.html``, and the lists ``missing`` and ``extra`` as CSV with a header, under ``folder``.

    ``tallies`` and ``keys`` are what :func:`reconcile.reconcile_all` and :func:`reconcile.states` give; a folder that holds a
    report already is refused.
    """
    rows = tallies.collect()  # collections by years, kinds and classes
    for state in ("missing", "extra"):
        listed = keys.where(F.col("state") == state).select("collection", "key", "year")
        listed.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{state}")
    files = Files(tallies.sparkSession, folder)
    files.publish(f"{folder}/report.md", markdown(rows))
    files.publish(f"{folder}/report.html", page(rows))
