import datetime as dt

import pytest
from pyspark.sql import functions as F

from docketspark.functions import classify as C
from docketspark.functions import dates as D
from docketspark.functions import numbers as N
from docketspark.functions import text as T


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {kind(v)}" for k, v in values.items()) or "x int")
    return row.select(expression.alias("out")).first()[0]


def kind(value):
    return {bool: "boolean", int: "long", float: "double", dt.date: "date"}.get(type(value), "string")


@pytest.mark.parametrize(
    ("needle", "haystack", "found"),
    [
        ("AI", "maintaining cybersecurity", False),
        ("AI", "AI-powered", True),
        ("ML", "AI/ML compliance review", True),
        ("Bitcoin", "BitcoinETF", True),
        ("", "anything", False),
        ("EPA", "repatriation policy", False),
        ("ai", "éai x", True),
        ("c++", "C++ and more", False),
        ("a.b", "a.b", True),
        ("a.b", "axb", False),
    ],
)
def test_safe_substring(spark, needle, haystack, found):
    assert one(spark, T.safe_substring(F.col("h"), needle), h=haystack) is found


def test_safe_substring_of_null(spark):
    assert one(spark, T.safe_substring(F.col("h"), "word"), h=None) is False


@pytest.mark.parametrize(
    ("code", "nature"),
    [("P", C.OPEN), (" s/K ", C.OPEN), ("A", C.COMP), ("G", C.TRANSFER), ("", C.UNKNOWN), (None, C.UNKNOWN), ("J", C.UNKNOWN), ("/S", C.UNKNOWN)],
)
def test_nature(spark, code, nature):
    assert one(spark, C.nature(F.col("c")), c=code) == nature


@pytest.mark.parametrize(("code", "mark", "way"), [("P", "D", "buy"), ("S", "A", "sell"), ("M", "A", "buy"), ("F", "D", "sell"), ("C", None, "buy"), ("p", None, "sell")])
def test_direction(spark, code, mark, way):
    assert one(spark, C.direction(F.col("c"), F.col("m")), c=code, m=mark) == way


@pytest.mark.parametrize(
    ("field", "value", "flag"),
    [
        ("exercise_date", "2050-12-31", C.SENTINEL),
        ("expiration_date", "2050-08-31", C.SENTINEL),
        ("transaction_date", "2050-12-31", C.ANOMALY),
        ("exercise_date", "2050-06-15", C.ANOMALY),
        ("transaction_date", "0012-02-17", C.ANOMALY),
        ("transaction_date", "2027-01-01", None),
        ("transaction_date", "2027-01-02", C.ANOMALY),
        ("transaction_date", "1990-01-01", None),
        ("transaction_date", "1989-12-31", C.ANOMALY),
        ("exercise_date", "2050-01-01", None),
        ("period_of_report", "2030-08-26", C.ANOMALY),
        ("transaction_date", "", None),
        ("transaction_date", None, None),
    ],
)
def test_date_flags(spark, field, value, flag):
    found = one(spark, C.source_metadata({field: F.col("d")}), d=value)
    assert found == (None if flag is None else {field: [flag]})


def test_business_days_against_a_calendar(spark):
    start = dt.date(2024, 1, 1)
    pairs = [(start + dt.timedelta(a), start + dt.timedelta(b)) for a in range(9) for b in range(0, 40, 3)]
    rows = spark.createDataFrame(pairs, "a date, b date").select("a", "b", D.business_days(F.col("a"), F.col("b")).alias("n")).collect()
    for a, b, n in rows:
        low, high = min(a, b), max(a, b)
        assert n == sum((low + dt.timedelta(k)).weekday() < 5 for k in range((high - low).days)), (a, b)


@pytest.mark.parametrize(
    ("parse", "text", "wanted"),
    [
        (D.parse_day_month_year, "5-jan-2023", "2023-01-05"),
        (D.parse_day_month_year, "31-DEC-1999", "1999-12-31"),
        (D.parse_day_month_year, "31-XXX-1999", None),
        (D.parse_us, "3/7/2021", "2021-03-07"),
        (D.parse_us, "2021-03-07", "2021-03-07"),
        (D.parse_us, "7 March", None),
        (D.parse_compact, "20210307", "2021-03-07"),
        (D.parse_compact, "00000000", ""),
    ],
)
def test_parse_dates(spark, parse, text, wanted):
    assert one(spark, parse(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(("day", "label"), [("2027-01-01", "2026W53"), ("2026-06-05", "2026W23")])
def test_iso_week_label(spark, day, label):
    assert one(spark, D.period_label(F.to_date("d"), "W"), d=day) == label


def test_corrected_date(spark):
    fixed = D.corrected_date(F.col("v"), {"filed": F.lit(2021)})
    assert one(spark, fixed, v="2051-04-05").asDict() == {"value": "2021-04-05", "source": "2051-04-05", "corrected": True, "basis": "filed"}
    assert one(spark, fixed, v="2022-04-05")["corrected"] is False


@pytest.mark.parametrize(("value", "wanted"), [(2.5, 3), (-2.5, -2), (-2.6, -3), (0.49, 0)])
def test_round_half_up(spark, value, wanted):
    assert one(spark, N.round_half_up(F.col("v")), v=value) == wanted


@pytest.mark.parametrize(("text", "low", "high"), [("$1,001 - $15,000", 1001.0, 15000.0), ("Over $50,000,000", 50000000.0, None), ("none", None, None)])
def test_amount_range(spark, text, low, high):
    assert [one(spark, x, t=text) for x in N.amount_range(F.col("t"))] == [low, high]


@pytest.mark.parametrize(("text", "wanted"), [("12.5 units", 12.5), ("-3", -3.0), ("n/a", None), ("", None)])
def test_lenient_number(spark, text, wanted):
    assert one(spark, N.lenient_number(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(("key", "wanted"), [("77", "0000000077"), ("123456789012", "123456789012")])
def test_pad_key(spark, key, wanted):
    assert one(spark, T.pad_key(F.col("k")), k=key) == wanted


@pytest.mark.parametrize(("a", "b", "match"), [("The Acme Corp.", "ACME, INC", True), ("Acme Widgets", "Acme Widgets Global", True), ("Acme", "Zenith", False), (None, "x", True)])
def test_names_match(spark, a, b, match):
    assert one(spark, T.names_match(F.col("a"), F.col("b")), a=a, b=b) is match


def test_strip_html(spark):
    html = '<html><head><style>p{}</style></head><body><p>A &amp; B</p><script>x("</p>")</script><div>C&nbsp;<b>D</b></div></body></html>'
    assert one(spark, T.strip_html(F.col("h")), h=html) == "A & B C D"


def test_hash_id_keeps_empty_slots(spark):
    same = one(spark, T.hash_id(F.col("a"), F.lit(None).cast("string"), F.col("b")), a="x", b="y")
    assert same == one(spark, F.substring(F.sha1(F.lit("X||Y").cast("binary")), 1, 12)) != one(spark, T.hash_id(F.col("a"), F.col("b")), a="x", b="y")


@pytest.mark.parametrize(
    ("ticker", "bad"),
    [(None, True), ("", True), ("P", True), ("k", False), ("K", False), ("NCSUSD", True), ("ncsusd", True), ("RNA 09/16/22 P5", True), ("BRK-A", False), ("USDX", False)],
)
def test_bad_ticker(spark, ticker, bad):
    assert one(spark, C.bad_ticker(F.col("x").cast("string")), x=ticker) is bad


@pytest.mark.parametrize(
    ("position", "wanted"),
    [
        ("Secretary of State", "cabinet"), ("SECRETRARY", "cabinet"), ("Attorney General", "cabinet"), ("Deputy Attorney General", "appointee"),
        ("Under Secretary", "appointee"), ("Undersecretary", "cabinet"), (" ", "other"), ("", "other"), (None, "other"), ("Counsel", "appointee"),
    ],
)
def test_filer_type(spark, position, wanted):
    assert one(spark, C.filer_type(F.col("x").cast("string")), x=position) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("Spouse and dependent child", "dependent"), ("spouse's IRA", "spouse"), ("spouses", "spouse"), ("", "self"), (None, "self")])
def test_owner(spark, text, wanted):
    assert one(spark, C.owner(F.col("x").cast("string")), x=text) == wanted
