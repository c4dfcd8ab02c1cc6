"""Text functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary of ASCII words only, as browsers and RE2 define it; Java's is Unicode-aware.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Suffixes of names that a generation adds.
GENERATION = r"(?i),\s*(jr|sr|ii|iii|iv|v)\.?\s*$"
#: Abbreviations in company names.
ABBREVIATIONS = {
    "CTLS": "CONTROLS", "INTL": "INTERNATIONAL", "MGMT": "MANAGEMENT", "SVCS": "SERVICES", "TECHS": "TECHNOLOGIES", "COS": "COMPANIES",
    "PHARMA": "PHARMACEUTICALS", "PHARMS": "PHARMACEUTICALS", "PHARM": "PHARMACEUTICALS", "PETE": "PETROLEUM", "PETRO": "PETROLEUM",
    "COMMS": "COMMUNICATIONS", "COMMUN": "COMMUNICATIONS", "NATL": "NATIONAL", "INDS": "INDUSTRIES", "INDUS": "INDUSTRIES",
    "AMER": "AMERICAN", "AMERN": "AMERICAN", "RES": "RESOURCES", "RESOURCS": "RESOURCES", "ENRGY": "ENERGY", "TR": "TRUST",
    "HLDG": "HOLDINGS", "ENTERPRISE": "ENTERPRISES", "TELECOMM": "TELECOMMUNICATIONS", "TELECOMS": "TELECOMMUNICATIONS",
    "ELEC": "ELECTRIC", "PWR": "POWER", "WTR": "WATER", "WKS": "WORKS", "SOUTHN": "SOUTHERN", "NORTHN": "NORTHERN", "EASTN": "EASTERN",
    "WESTN": "WESTERN", "INDL": "INDUSTRIAL", "UTILS": "UTILITIES", "UTIL": "UTILITY", "MED": "MEDICAL", "TRANS": "TRANSPORTATION",
    "MFG": "MANUFACTURING", "MIN": "MINING", "PROPS": "PROPERTIES", "PPTYS": "PROPERTIES", "PPTY": "PROPERTY", "PRODS": "PRODUCTS",
    "HLTHCARE": "HEALTHCARE", "HLTH": "HEALTH", "PHARMACEUTICAL": "PHARMACEUTICALS", "THERAPS": "THERAPEUTICS", "TECH": "TECHNOLOGY",
    "TECHNOL": "TECHNOLOGY",
}
#: Words of company names that say nothing of the company: legal forms, places of incorporation, states.
LEGAL_FORMS = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "NV", "N.V", "SA", "S.A", "LP",
    "HOLDINGS", "HOLDING", "HLDGS", "GROUP", "GRP", "TRUST", "TR",
]
JURISDICTIONS = [
    "IRELAND", "BERMUDA", "SWITZ", "SWITZERLAND", "NETHERLANDS", "CAYMAN", "JERSEY", "GUERNSEY", "GIBRALTAR", "MARSHALL", "LIBERIA",
    "SCOTLAND", "ENGLAND", "JAPAN", "KOREA", "CHINA", "GBR", "UK", "USA", "US", "DEL", "NE",
]
HINTS = ["NEW", "OLD", "PA", "MD", "NY", "CA", "MA"]
#: Block tags that part words, and the named entities that pages use.
BLOCK_TAGS = r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|h[1-6]|table|section|article|nav)[^>]*>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def safe_substring(text: Column, needle: str) -> Column:
    """Case-insensitive search; needles of up to three characters must be whole words; an empty needle fits nothing."""
    if not needle:
        return F.lit(False)
    lowered, needle = F.lower(text), needle.lower()
    found = lowered.contains(needle)
    if len(needle) <= 3:  # the plain search comes first and spares most texts the pattern
        found = found & lowered.rlike(BOUNDARY + re.escape(needle) + BOUNDARY)
    return F.coalesce(found, F.lit(False))


def any_safe_substring(values: Column, needle: str) -> Column:
    """Whether any element of an array holds the needle."""
    return F.coalesce(F.exists(values, lambda x: safe_substring(x, needle)), F.lit(False))


def pad_key(key: Column, width: int = 10) -> Column:
    """Left-pad with zeros, never cutting a longer key."""
    return F.when(F.length(key) < width, F.lpad(key, width, "0")).otherwise(key)


def strip_generation(name: Column) -> Column:
    return F.regexp_replace(name, GENERATION, "")


def concat_nonempty(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(separator, *[F.nullif(F.trim(x), F.lit("")) for x in parts])


def whole_words(words: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(x) for x in words) + r")\b"


def normalize_name(name: Column) -> Column:
    """Upper case with abbreviations written out, without article, legal forms, places, hints and punctuation, single-spaced."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    pieces = F.regexp_extract_all(F.upper(name), F.lit(r"\w+|\W+"), F.lit(0))
    out = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    out = F.regexp_replace(F.regexp_replace(out, r"^THE\s+", ""), r"[,\s]+THE\s*$", "")
    for pattern in (whole_words(LEGAL_FORMS), whole_words(JURISDICTIONS), r"\(?" + whole_words(HINTS) + r"\)?", r"/[A-Z]{2,3}/?", r"[.,'\"()\\/&-]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal names, or all longer words of one in the other; unknown names match."""
    a, b = normalize_name(a), normalize_name(b)
    words = [F.filter(F.split(x, " "), lambda w: F.length(w) >= 3) for x in (a, b)]
    subset = (F.size(F.array_except(words[0], words[1])) == 0) | (F.size(F.array_except(words[1], words[0])) == 0)
    bare = (F.size(words[0]) == 0) | (F.size(words[1]) == 0)
    near = F.when(bare, a.contains(b) | b.contains(a)).otherwise(subset)
    return F.when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin(""), True).otherwise((a == b) | near)


def paren_code(text: Column) -> Column:
    """First alphanumeric token in parentheses."""
    return F.regexp_extract(text, r"\(([A-Za-z0-9]+)", 1)


def slug(text: Column, longest: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", ""), 1, longest)


def numeric_references(text: Column) -> Column:
    """``&#8217;`` and ``&#x2019;`` as the characters they name; what names no character stays."""
    form = r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"

    def read(part: Column) -> Column:
        code = F.when(part.rlike(r"^[xX]"), F.conv(F.regexp_extract(part, form, 1), 16, 10)).otherwise(F.regexp_extract(part, form, 2))
        code = code.try_cast("long")
        valid = part.rlike(form) & (code >= 1) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(sign, F.regexp_replace(part, form, ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), read), ""))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles go, block tags part words, entities and numeric references are read, spaces squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, BLOCK_TAGS, " "), r"<[^>]*>", "")
    out = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), numeric_references(out))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")


def hash_id(*parts: Column) -> Column:
    """First twelve hex digits of the SHA-1 of the parts, joined by bars; null parts keep their place."""
    joined = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.substring(F.sha1(F.upper(joined).cast("binary")), 1, 12)


def tokens(text: Column) -> Column:
    """Non-empty parts between commas and spaces."""
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")


def after_prefix(text: Column, mark: str = "/") -> Column:
    return F.substring_index(text, mark, -1)


def escape_html(text: Column) -> Column:
    """For text and for attributes in double quotes."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escape_csv(text: Column) -> Column:
    """A cell, quoted only where it must be; null is an empty cell."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def escape_markdown(text: Column) -> Column:
    """A table's cell: bars and backslashes are escaped, line ends become spaces."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(escaped, r"[\r\n]+", " ")
