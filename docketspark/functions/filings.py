"""Columns of filings: parties out of display names, footnotes that resolve or don't, kinds of derivatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import UNKNOWN
from .text import pad_key

# An identifier and a ticker behind a display name, the text of a note that is not there, asset categories
# of derivatives and the tags that say of which kind one is, in the order in which they are looked for.
CIK = r"(?i)\(CIK\s+(\d+)\)\s*$"
TICKER = r"\(([A-Z][A-Z0-9.]{0,4})\)\s*$"
NOT_FOUND = "(footnote not found)"
DERIVATIVES = ["DCO", "DCR", "DE", "DFE", "DIR", "DR"]
TAGS = {"futrDeriv": "future", "fwdDeriv": "forward", "swapDeriv": "swap", "optionSwaptionWarrantDeriv": "option", "otherDeriv": "other"}
OPTIONS = {"WAR": "warrant", "SWO": "swaption"}


def display_name(text: Column) -> Column:
    """``name, ticker, cik`` of ``NAME (TICKER) (CIK 123)``; parts that are missing are blank, the identifier has ten digits."""
    rest = F.trim(F.regexp_replace(text, CIK, ""))
    cik = F.regexp_extract(text, CIK, 1)
    name = F.trim(F.regexp_replace(rest, TICKER, ""))
    made = F.struct(name.alias("name"), F.regexp_extract(rest, TICKER, 1).alias("ticker"), F.when(cik != "", pad_key(cik)).otherwise("").alias("cik"))
    return F.when(text.isNotNull(), made)


def tender_parties(form: Column, names: Column, ciks: Column) -> Column:
    """``target`` and ``bidder`` of a tender offer, each as :func:`display_name`; null without any name.

    An issuer's own offer (``SC TO-I``) has one party in both roles; otherwise the first name is the target and the second
    the bidder, or the first again.  An identifier that a name lacks is taken from the list of identifiers.
    """
    own = form.startswith("SC TO-I")
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    asked = F.array(
        F.struct(first.alias("text"), F.get(ciks, F.lit(0)).alias("cik")),
        F.struct(F.when(own, first).otherwise(F.coalesce(second, first)).alias("text"), F.get(ciks, F.when(own, 0).otherwise(1)).alias("cik")),
    )
    read = F.transform(asked, lambda p: F.struct(display_name(p["text"]).alias("x"), p["cik"].alias("cik")))

    def whole(p: Column) -> Column:
        cik = F.when(p["x"]["cik"] != "", p["x"]["cik"]).otherwise(F.coalesce(pad_key(p["cik"]), F.lit("")))
        return F.struct(p["x"]["name"].alias("name"), p["x"]["ticker"].alias("ticker"), cik.alias("cik"))

    both = F.transform(F.array(F.transform(read, whole)), lambda x: F.struct(x[0].alias("target"), x[1].alias("bidder")))
    return F.when(first.isNotNull(), both[0])


def footnotes(refs: Column, notes: Column) -> Column:
    """``code, text`` of every reference, from a map of a filing's notes; what is not in it says so."""
    return F.transform(refs, lambda x: F.struct(x.alias("code"), F.coalesce(F.try_element_at(notes, x), F.lit(NOT_FOUND)).alias("text")))


def verification(resolved: Column) -> Column:
    """``VERIFIED`` unless a reference is unresolved; a row without references is verified."""
    return F.when(F.exists(resolved, lambda x: x["text"] == NOT_FOUND), UNKNOWN).otherwise("VERIFIED")


def is_derivative(category: Column) -> Column:
    return F.coalesce(category.isin(DERIVATIVES), F.lit(False))


def derivative_type(tags: Column, category: Column) -> Column:
    """The kind that the first known tag of an array names; options are told apart by their category, null without a tag."""
    out = F.lit(None).cast("string")
    for tag, kind in reversed(TAGS.items()):
        value = F.lit(kind)
        if kind == "option":
            value = F.coalesce(*[F.when(category == code, name) for code, name in OPTIONS.items()], F.lit(kind))
        out = F.when(F.array_contains(tags, tag), value).otherwise(out)
    return out
