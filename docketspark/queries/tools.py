"""Twelve of the tools as specifications over the driver's tables, each asked several things in one query.

A tool's collection is a view of a table in the tool's own columns, upserted into the warehouse; the SQL states view,
predicates, order, page and verdict anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions.dates import iso
from ..operators import relational as R
from ..plans import coverage
from ..plans.spec import Parameter, Spec
from ..plans.tools import Registry, Warehouse
from ..session import fresh_folder
from .base import QUERIES, SQL, Tables

TOOLS = Registry()


def equals(column: str, kind: type = str, **more: Any) -> Parameter:
    return Parameter(lambda v: F.col(column) == v, kind, **more)


def at_least(column: str) -> Parameter:
    return Parameter(lambda v: F.col(column) >= v, float)


def at_most(column: str) -> Parameter:
    return Parameter(lambda v: F.col(column) <= v, float)


def holds(*columns: str) -> Parameter:
    """Safe substring in any of the columns."""
    return Parameter(lambda v: reduce(Column.__or__, [X.safe_substring(F.col(c), v) for c in columns]))


def any_of(column: str) -> Parameter:
    return Parameter(lambda v: F.col(column).isin(*v[:30]), list)


Request = tuple[dict[str, Any], str, str] | tuple[dict[str, Any], str, str, list[str]]


def tool(name: str, spec: Spec, view: Callable[[Tables], DataFrame], sql: str, requests: list[Request], date: str | None) -> None:
    """Register a tool and its query ``q_tool_<name>``.

    ``sql`` is the view; a request has its arguments, its predicate in SQL, its order in SQL and the notes that its verdict
    ends with.  An order of "!" marks a request that is refused, its predicate being the error's text.
    """
    TOOLS.add(name, spec)

    def run(t: Tables) -> DataFrame:
        rows = view(t)
        warehouse = Warehouse(t.spark, fresh_folder(t.spark, name))
        store = warehouse.collection(spec.table, rows.withColumn("seq", F.lit(1)).schema, [spec.key], "seq", date)
        # two batches, so that coverage is what both added up to
        half = F.pmod(F.xxhash64(spec.key), F.lit(2))
        for k in (0, 1):
            store.upsert(rows.where(half == k).withColumn("seq", F.lit(1)), k)
        answers = [TOOLS.answer(name, warehouse, asked).select(F.lit(k).alias("request"), "*") for k, (asked, *_) in enumerate(requests)]
        return reduce(DataFrame.unionByName, answers)

    parts = []
    for k, (asked, where, order, *notes) in enumerate(requests):
        if order == "!":
            parts.append(f"SELECT {k} AS request, NULL::BIGINT AS rn, NULL::VARCHAR AS key, false AS has_more, '{where}' AS verdict")
            continue
        limit = asked.get("limit", spec.default_limit)
        since, until = ([asked[x] for x in names if asked.get(x)] for names in (spec.since, spec.until))
        parts.append(_page_sql(k, where, order, limit, spec.key, min(since, default=None), max(until, default=None), date is not None, *notes))
    held = f"SELECT min({date}) FILTER (WHERE {date} >= '1900-01-01') AS low, max({date}) AS high FROM v" if date else "SELECT NULL AS low, NULL AS high"
    SQL[f"q_tool_{name}"] = f"WITH v AS ({sql}), c AS ({held}) " + " UNION ALL ".join(f"({x})" for x in parts)
    run.__doc__ = f"Pages and verdicts of {name}."
    QUERIES[f"q_tool_{name}"] = lambda spark, folder: run(Tables(spark, folder))


def _page_sql(k: int, where: str, order: str, limit: int, key: str, since: str | None, until: str | None, dated: bool, notes: list[str] = []) -> str:  # noqa: B006
    """One request's page with its verdict, the first rule of the survey's A.4 that fits."""
    before = f"'{since}' < low" if since else "false"
    after = f"'{until}' > high" if until else "false"
    outside = " OR ".join(([f"'{until}' < low"] if until else []) + ([f"'{since}' > high"] if since else [])) or "false"
    side = f"CASE WHEN {before} THEN 'older' ELSE 'newer' END"
    empty = "'no rows match; the table holds ' || low || ' to ' || high"
    if since or until:
        empty = f"""CASE WHEN {outside} THEN 'no rows match; the window lies entirely outside: the table holds ' || low || ' to ' || high
    ELSE {empty} || CASE WHEN {before} OR {after} THEN ', the window reaches to the ' || {side} || ' side' ELSE '' END END"""
    partial = f"CASE WHEN {before} OR {after} THEN 'partial coverage on the ' || {side} || ' side: the table holds ' || low || ' to ' || high END" if since or until else "NULL"
    verdict = f"CASE WHEN n = 0 THEN {empty} WHEN n >= {limit} THEN {partial} END" if dated else "NULL::VARCHAR"
    if notes:
        verdict = f"concat_ws('; ', {verdict}, {', '.join(notes)})"
    return f"""WITH p AS (SELECT row_number() OVER (ORDER BY {order}) AS rn, CAST({key} AS VARCHAR) AS key FROM v WHERE {where}),
n AS (SELECT count(*) AS n FROM p)
SELECT {k} AS request, rn, key, n > {limit} AS has_more, {verdict} AS verdict FROM n CROSS JOIN c LEFT JOIN p ON rn <= {limit}"""


# Insider transactions: the active sort field bounds the window; what is no open-market trade is left out unless a direction is asked.

tool(
    "get_insider_transactions",
    Spec(
        "insider", "id",
        {
            "ticker": equals("ticker"), "officer_name": holds("officer"), "min_value": at_least("value"),
            "transaction_type": equals("direction", choices=("buy", "sell")), "transaction_codes": any_of("code"),
            "include_non_open_market": Parameter(lambda v: F.lit(True) if v else F.col("nature").isin("OPEN_MARKET", "INSUFFICIENT_DATA"), bool),
        },
        {"disclosure_date": "disclosure_date", "transaction_date": "transaction_date", "total_value": "value"}, "disclosure_date",
        numeric_sorts=frozenset({"total_value"}), complete=lambda a: {"include_non_open_market": not a.get("transaction_type"), **a},
        notes=lambda a, held: [coverage.beyond([a[x] for x in ("until",) if a.get(x)], held.high), coverage.unanchored(a.get("officer_name"), a.get("ticker"))],
        derive=lambda df: df.withColumns({"nature": C.nature(F.col("code")), "direction": C.direction(F.col("code"), F.col("ad"))}),
    ),
    lambda t: t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"), F.col("o_orderpriority").alias("officer"),
        F.col("o_totalprice").alias("value"), iso(F.col("o_orderdate")).alias("disclosure_date"), F.when(F.col("o_orderkey") % 9 > 0, iso(F.date_sub("o_orderdate", 3))).alias("transaction_date"),
        F.element_at(F.array(*map(F.lit, ["P", "S", "A", "M", "G", "", "F/K", "X"])), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("code"),
        F.when(F.col("o_orderkey") % 3 == 0, "A").otherwise("D").alias("ad"),
    ),
    """SELECT *, CASE WHEN code = 'P' OR (code <> 'S' AND (ad = 'A' OR (ad <> 'D' AND code IN ('A', 'M', 'X', 'C', 'I')))) THEN 'buy' ELSE 'sell' END AS direction,
  CASE WHEN code IN ('P', 'S') THEN 'OPEN_MARKET' WHEN code IN ('A', 'M', 'X') THEN 'EQUITY_COMP' WHEN code IN ('G', 'F/K') THEN 'NON_OPEN_MARKET_TRANSFER' ELSE 'INSUFFICIENT_DATA' END AS nature
FROM (SELECT o_orderkey AS id, 'T' || (o_custkey % 50) AS ticker, o_orderpriority AS officer, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS disclosure_date,
  CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') END AS transaction_date, ['P', 'S', 'A', 'M', 'G', '', 'F/K', 'X'][o_orderkey % 8 + 1] AS code,
  CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'D' END AS ad FROM orders)""",
    [
        ({"ticker": "T7", "limit": 10}, "ticker = 'T7'", "disclosure_date DESC NULLS LAST, id"),
        ({"transaction_type": "buy", "since": "1990-01-01", "limit": 5}, "direction = 'buy' AND nature IN ('OPEN_MARKET', 'INSUFFICIENT_DATA') AND disclosure_date >= '1990-01-01'", "disclosure_date DESC NULLS LAST, id"),
        ({"sort_by": "transaction_date", "sort_order": "asc", "since": "1996-01-01", "until": "1996-02-01", "include_non_open_market": False}, "nature IN ('OPEN_MARKET', 'INSUFFICIENT_DATA') AND transaction_date BETWEEN '1996-01-01' AND '1996-02-01'", "transaction_date ASC NULLS LAST, id"),
        ({"officer_name": "low", "transaction_codes": ["G", "X"], "min_value": 300000.0, "limit": 20}, "regexp_matches(lower(officer), '\\blow\\b') AND code IN ('G', 'X') AND value >= 300000", "disclosure_date DESC NULLS LAST, id", ["'the search for ''low'' has no identifier beside the name, so an empty or short answer proves nothing'"]),
        ({"since": "2040-01-01", "until": "2041-01-01"}, "disclosure_date BETWEEN '2040-01-01' AND '2041-01-01'", "id", ["'loaded through ' || high || ' only; later days are missing'"]),
        ({"ticker": "none", "until": "2041-01-01"}, "ticker = 'none'", "id", ["'loaded through ' || high || ' only; later days are missing'"]),
        ({"sort_by": "total_value", "since": "1996-01-01"}, "INVALID_QUERY: a date window can''t be combined with sorting by total_value", "!"),
        ({"transaction_type": "hold"}, "INVALID_ARGUMENT: transaction_type must be one of buy, sell", "!"),
    ],
    "disclosure_date",
)

# Fund holdings by value: no dates at all.

tool(
    "get_institutional_holdings",
    Spec(
        "holdings", "id",
        {"ticker": equals("ticker"), "fund_name": holds("fund"), "position_change": equals("position_change", choices=("new", "increased", "decreased", "unchanged", "closed")), "min_value": at_least("market_value")},
        {"market_value": "market_value", "shares": "shares"}, "market_value", dated=False,
        derive=lambda df: df.withColumn("position_change", F.when(F.col("prior") == 0, "new").when(F.col("shares") > F.col("prior"), "increased").when(F.col("shares") < F.col("prior"), "decreased").otherwise("unchanged")),
    ),
    lambda t: t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("ticker"), F.concat_ws(" ", "p_name", "p_type").alias("fund"), F.col("p_retailprice").alias("market_value"),
        F.col("p_size").alias("shares"), (F.col("p_partkey") % 40).alias("prior"),
    ),
    """SELECT *, CASE WHEN prior = 0 THEN 'new' WHEN shares > prior THEN 'increased' WHEN shares < prior THEN 'decreased' ELSE 'unchanged' END AS position_change
FROM (SELECT p_partkey AS id, p_brand AS ticker, p_name || ' ' || p_type AS fund, p_retailprice AS market_value, p_size AS shares, p_partkey % 40 AS prior FROM part)""",
    [
        ({"ticker": "Brand#7", "limit": 8}, "ticker = 'Brand#7'", "market_value DESC NULLS LAST, id"),
        ({"fund_name": "econ", "position_change": "new", "sort_by": "shares", "sort_order": "asc"}, "contains(lower(fund), 'econ') AND position_change = 'new'", "shares ASC NULLS LAST, id"),
        ({"fund_name": "red", "min_value": 950.0, "limit": 3}, "regexp_matches(lower(fund), '\\bred\\b') AND market_value >= 950", "market_value DESC NULLS LAST, id"),
        ({"ticker": "nothing"}, "ticker = 'nothing'", "id"),
        ({"since": "2020-01-01"}, "UNKNOWN_PARAMETER: since", "!"),
    ],
    None,
)

# Member profiles: a point lookup, and names in order.

tool(
    "get_member_profile",
    Spec(
        "members", "bioguide_id",
        {"bioguide_id": equals("bioguide_id", point=True), "member_name": holds("full_name"), "state": equals("state"), "party": equals("party"), "chamber": equals("chamber", choices=("house", "senate"))},
        {"full_name": "full_name", "state": "state"}, "full_name", dated=False, ascending=True, max_limit=600,
    ),
    lambda t: t.customer.select(
        F.concat(F.lit("B"), F.col("c_custkey").cast("string")).alias("bioguide_id"), F.col("c_name").alias("full_name"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("state"),
        F.col("c_mktsegment").alias("party"), F.when(F.col("c_custkey") % 3 == 0, "senate").otherwise("house").alias("chamber"),
    ),
    "SELECT 'B' || c_custkey AS bioguide_id, c_name AS full_name, 'S' || c_nationkey AS state, c_mktsegment AS party, CASE WHEN c_custkey % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber FROM customer",
    [
        ({"bioguide_id": "B37", "state": "ignored"}, "bioguide_id = 'B37'", "bioguide_id"),
        ({"bioguide_id": "X"}, "bioguide_id = 'X'", "bioguide_id"),
        ({"member_name": "customer", "party": "BUILDING", "chamber": "senate", "limit": 600}, "party = 'BUILDING' AND chamber = 'senate'", "full_name ASC NULLS LAST, bioguide_id"),
        ({"state": "S3", "sort_order": "desc", "limit": 4}, "state = 'S3'", "full_name DESC NULLS LAST, bioguide_id"),
        ({"limit": 601}, "INVALID_ARGUMENT: limit must be 1 to 600", "!"),
    ],
    None,
)

# Sanctioned parties: numbers in ascending order, no dates.

tool(
    "get_ofac_sdn",
    Spec("sdn", "ent_num", {"ent_num": equals("ent_num", int, point=True), "name": holds("name"), "program": holds("program"), "remarks": holds("remarks")}, {"ent_num": "ent_num", "name": "name"}, "ent_num", dated=False, ascending=True),
    lambda t: t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("ent_num"), F.col("s_name").alias("name"), F.concat(F.lit("P"), (F.col("s_suppkey") % 9).cast("string"), F.lit(" GLOBAL")).alias("program"), F.col("n_name").alias("remarks")
    ),
    "SELECT s_suppkey AS ent_num, s_name AS name, 'P' || (s_suppkey % 9) || ' GLOBAL' AS program, n_name AS remarks FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    [
        ({"ent_num": 5}, "ent_num = 5", "ent_num"),
        ({"program": "p7", "limit": 6}, "regexp_matches(lower(program), '\\bp7\\b')", "ent_num ASC NULLS LAST"),
        ({"remarks": "nation_1", "name": "supplier", "sort_by": "name", "sort_order": "desc"}, "contains(lower(remarks), 'nation_1')", "name DESC NULLS LAST, ent_num"),
        ({"ent_num": "5"}, "INVALID_ARGUMENT: ent_num must be int", "!"),
    ],
    None,
)

# Congressional trades: the active sort field; amounts reject a window.

tool(
    "get_congressional_trades",
    Spec(
        "congress", "id",
        {"bioguide_id": equals("bioguide_id"), "member_name": holds("member"), "transaction_type": equals("transaction_type", choices=("view", "click", "purchase", "error", "signup")), "min_amount": at_least("amount_min")},
        {"disclosure_date": "disclosure_date", "transaction_date": "transaction_date", "amount_min": "amount_min"}, "disclosure_date", numeric_sorts=frozenset({"amount_min"}),
        notes=lambda a, held: [coverage.unanchored(a.get("member_name"), a.get("bioguide_id"))],
    ),
    lambda t: t.events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("bioguide_id"), F.concat(F.lit("Member "), F.col("user_id").cast("string")).alias("member"),
        F.col("event_type").alias("transaction_type"), F.col("value").alias("amount_min"), iso(F.col("ts")).alias("disclosure_date"), iso(F.date_sub("ts", 20)).alias("transaction_date"),
    ),
    """SELECT event_id AS id, 'B' || user_id AS bioguide_id, 'Member ' || user_id AS member, event_type AS transaction_type, value AS amount_min, strftime(ts, '%Y-%m-%d') AS disclosure_date,
  strftime(ts - INTERVAL 20 DAY, '%Y-%m-%d') AS transaction_date FROM events""",
    [
        ({"bioguide_id": "B8", "limit": 10}, "bioguide_id = 'B8'", "disclosure_date DESC NULLS LAST, id"),
        ({"member_name": "12", "transaction_type": "click"}, "regexp_matches(lower(member), '\\b12\\b') AND transaction_type = 'click'", "disclosure_date DESC NULLS LAST, id", ["'the search for ''12'' has no identifier beside the name, so an empty or short answer proves nothing'"]),
        ({"member_name": "member", "bioguide_id": "B9", "limit": 2}, "bioguide_id = 'B9'", "disclosure_date DESC NULLS LAST, id"),
        ({"sort_by": "amount_min", "min_amount": 20.0, "limit": 7}, "amount_min >= 20", "amount_min DESC NULLS LAST, id"),
        ({"sort_by": "transaction_date", "until": "2023-12-20", "limit": 9, "sort_order": "asc"}, "transaction_date <= '2023-12-20'", "transaction_date ASC NULLS LAST, id"),
        ({"since": "2024-01-20", "until": "2026-01-01", "limit": 12}, "disclosure_date BETWEEN '2024-01-20' AND '2026-01-01'", "disclosure_date DESC NULLS LAST, id"),
    ],
    "disclosure_date",
)

# Fails to deliver: a composite key, and a fixed date.

tool(
    "get_sec_fails_to_deliver",
    Spec(
        "fails", "id", {"id": equals("id", point=True), "ticker": equals("ticker"), "cusip": equals("cusip"), "min_quantity": at_least("quantity"), "min_value": at_least("value")},
        {"settlement_date": "settlement_date", "quantity": "quantity", "fail_value": "value"}, "settlement_date", date="settlement_date",
        derive=lambda df: df.withColumn("value", F.col("quantity") * F.col("price")),
    ),
    lambda t: t.orders.select(
        F.concat_ws("-", iso(F.col("o_orderdate")), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("T"), (F.col("o_custkey") % 30).cast("string")).alias("ticker"),
        F.lpad((F.col("o_custkey") % 30).cast("string"), 9, "0").alias("cusip"), (F.col("o_orderkey") % 1000).alias("quantity"), F.col("o_totalprice").alias("price"), iso(F.col("o_orderdate")).alias("settlement_date"),
    ),
    """SELECT *, quantity * price AS value FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS id, 'T' || (o_custkey % 30) AS ticker, lpad(CAST(o_custkey % 30 AS VARCHAR), 9, '0') AS cusip,
  o_orderkey % 1000 AS quantity, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS settlement_date FROM orders)""",
    [
        ({"id": "1998-10-03-0"}, "id = '1998-10-03-0'", "id"),
        ({"cusip": "000000007", "min_quantity": 500.0, "limit": 10}, "cusip = '000000007' AND quantity >= 500", "settlement_date DESC NULLS LAST, id"),
        ({"sort_by": "fail_value", "since": "1997-01-01", "until": "1997-03-31", "limit": 6}, "settlement_date BETWEEN '1997-01-01' AND '1997-03-31'", "value DESC NULLS LAST, id"),
        ({"ticker": "T3", "since": "1980-01-01", "until": "1985-01-01"}, "ticker = 'T3' AND settlement_date BETWEEN '1980-01-01' AND '1985-01-01'", "id"),
        ({"ticker": "T3", "min_value": 4e9, "until": "2050-01-01"}, "ticker = 'T3' AND value >= 4e9 AND settlement_date <= '2050-01-01'", "id"),
    ],
    "settlement_date",
)

# Economic indicators: a window of years, and the latest of each series.

tool(
    "get_economic_indicators",
    Spec(
        "indicators", "id",
        {
            "source": equals("source"), "series_id": equals("series_id"), "since_year": Parameter(lambda v: F.col("year") >= v, int, least=1900, most=2100), "until_year": Parameter(lambda v: F.col("year") <= v, int, least=1900, most=2100),
            "latest_only": Parameter(lambda v: F.lit(True), bool, shape=lambda df, v: R.rank_one(df, ["series_id"], [F.desc("period"), F.desc("id")]) if v else df),
        },
        {"period": "period", "value": "value"}, "period", dated=False,
    ),
    lambda t: t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("series_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"),
    ),
    "SELECT o_orderkey AS id, o_orderstatus AS source, 'S' || (o_custkey % 40) AS series_id, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) AS year, o_totalprice AS value FROM orders",
    [
        ({"latest_only": True, "limit": 100}, "id IN (SELECT last(id ORDER BY period, id) FROM v GROUP BY series_id)", "period DESC NULLS LAST, id"),
        ({"latest_only": True, "source": "F", "until_year": 1997, "sort_by": "value", "limit": 5}, "id IN (SELECT last(id ORDER BY period, id) FROM v WHERE source = 'F' AND year <= 1997 GROUP BY series_id)", "value DESC NULLS LAST, id"),
        ({"series_id": "S4", "since_year": 1996, "until_year": 1996, "latest_only": False}, "series_id = 'S4' AND year = 1996", "period DESC NULLS LAST, id"),
        ({"series_id": "none"}, "series_id = 'none'", "id"),
        ({"since_year": 12}, "INVALID_ARGUMENT: since_year is out of range", "!"),
    ],
    "period",
)

# Bills: a point key, a fixed date and a second window.

tool(
    "get_bills",
    Spec(
        "bills", "bill_id",
        {
            "bill_id": equals("bill_id", point=True), "congress": equals("congress", int), "bill_type": equals("bill_type"), "title": holds("title"),
            "introduced_since": Parameter(lambda v: F.col("introduced_date") >= v), "introduced_until": Parameter(lambda v: F.col("introduced_date") <= v),
        },
        {"latest_action_date": "latest_action_date", "introduced_date": "introduced_date"}, "latest_action_date", date="latest_action_date", since=("since", "introduced_since"), until=("until", "introduced_until"),
    ),
    lambda t: t.orders.select(
        F.concat_ws("-", (F.year("o_orderdate") % 9 + 100).cast("string"), F.lower("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("bill_id"), (F.year("o_orderdate") % 9 + 100).cast("int").alias("congress"),
        F.lower("o_orderstatus").alias("bill_type"), F.concat(F.lit("An act of "), F.col("o_orderpriority")).alias("title"), iso(F.col("o_orderdate")).alias("introduced_date"),
        iso(F.date_add("o_orderdate", (F.col("o_orderkey") % 400).cast("int"))).alias("latest_action_date"),
    ),
    """SELECT (year(o_orderdate) % 9 + 100) || '-' || lower(o_orderstatus) || '-' || o_orderkey AS bill_id, year(o_orderdate) % 9 + 100 AS congress, lower(o_orderstatus) AS bill_type, 'An act of ' || o_orderpriority AS title,
  strftime(o_orderdate, '%Y-%m-%d') AS introduced_date, strftime(o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)), '%Y-%m-%d') AS latest_action_date FROM orders""",
    [
        ({"bill_id": "100-p-0"}, "bill_id = '100-p-0'", "bill_id"),
        ({"introduced_since": "1996-05-01", "introduced_until": "1996-05-31", "since": "1997-01-01", "limit": 15}, "introduced_date BETWEEN '1996-05-01' AND '1996-05-31' AND latest_action_date >= '1997-01-01'", "latest_action_date DESC NULLS LAST, bill_id"),
        ({"title": "urgent", "bill_type": "f", "congress": 107, "sort_by": "introduced_date", "limit": 10}, "contains(lower(title), 'urgent') AND bill_type = 'f' AND congress = 107", "introduced_date DESC NULLS LAST, bill_id"),
        ({"title": "no", "since": "1800-01-01"}, "regexp_matches(lower(title), '\\bno\\b') AND latest_action_date >= '1800-01-01'", "latest_action_date DESC NULLS LAST, bill_id"),
        ({"bill_type": "f", "introduced_until": "1801-01-01"}, "introduced_date <= '1801-01-01'", "bill_id"),
    ],
    "latest_action_date",
)

# Federal Register: a fixed date, text in three columns, agencies in an array.

tool(
    "get_federal_register_documents",
    Spec(
        "register", "document_number",
        {
            "document_number": equals("document_number", point=True), "document_type": equals("document_type"), "title": holds("title"), "agency_slug": Parameter(lambda v: F.array_contains("agencies", v)),
            "agency_name": Parameter(lambda v: X.any_safe_substring(F.col("agency_names"), v)), "text": holds("title", "abstract", "topic"),
        },
        {"publication_date": "publication_date", "title": "title"}, "publication_date", date="publication_date",
    ),
    lambda t: t.events.select(
        F.concat(F.lit("2024-"), X.pad_key(F.col("event_id").cast("string"), 6)).alias("document_number"), F.col("event_type").alias("document_type"), F.concat(F.lit("Notice "), F.col("user_id").cast("string")).alias("title"),
        F.col("props").alias("abstract"), F.when(F.col("event_id") % 4 == 0, "air").alias("topic"), F.array(F.concat(F.lit("a"), (F.col("user_id") % 6).cast("string")), F.lit("all")).alias("agencies"),
        F.array(F.concat(F.lit("Agency "), (F.col("user_id") % 6).cast("string")), F.lit("Office of All")).alias("agency_names"), iso(F.col("ts")).alias("publication_date"),
    ),
    """SELECT '2024-' || lpad(CAST(event_id AS VARCHAR), greatest(6, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') AS document_number, event_type AS document_type, 'Notice ' || user_id AS title, props AS abstract,
  CASE WHEN event_id % 4 = 0 THEN 'air' ELSE '' END AS topic, user_id % 6 AS a, strftime(ts, '%Y-%m-%d') AS publication_date FROM events""",
    [
        ({"document_number": "2024-000037"}, "document_number = '2024-000037'", "document_number"),
        ({"text": "air", "document_type": "click", "limit": 8}, "topic = 'air' AND document_type = 'click'", "publication_date DESC NULLS LAST, document_number"),
        ({"agency_slug": "a3", "since": "2024-01-10", "until": "2024-01-11", "limit": 20}, "a = 3 AND publication_date BETWEEN '2024-01-10' AND '2024-01-11'", "publication_date DESC NULLS LAST, document_number"),
        ({"agency_name": "agency 5", "title": "notice 11", "sort_by": "title", "sort_order": "asc"}, "a = 5 AND contains(lower(title), 'notice 11')", "title ASC NULLS LAST, document_number"),
        ({"agency_name": "all", "since": "2023-01-01", "limit": 3}, "publication_date >= '2023-01-01'", "publication_date DESC NULLS LAST, document_number"),
        ({"agency_slug": "zz", "until": "2024-01-05"}, "false", "document_number"),
    ],
    "publication_date",
)

# Treasury auctions: a flag that may be asked as false, and bounds on numbers.

tool(
    "get_treasury_auctions",
    Spec(
        "auctions", "id", {"cusip": equals("cusip"), "security_type": equals("security_type"), "reopening": equals("reopening", bool), "min_offering_amount": at_least("offering"), "min_bid_to_cover": at_least("ratio")},
        {"auction_date": "auction_date", "offering_amount": "offering"}, "auction_date", numeric_sorts=frozenset({"offering_amount"}),
    ),
    lambda t: t.orders.select(
        F.col("o_orderkey").alias("id"), F.lpad((F.col("o_custkey") % 60).cast("string"), 9, "9").alias("cusip"), F.substring("o_orderpriority", 3, 20).alias("security_type"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5 == 1).alias("reopening"), F.col("o_totalprice").alias("offering"), (F.col("o_custkey") % 7).cast("double").alias("ratio"), iso(F.col("o_orderdate")).alias("auction_date"),
    ),
    """SELECT o_orderkey AS id, lpad(CAST(o_custkey % 60 AS VARCHAR), 9, '9') AS cusip, substr(o_orderpriority, 3, 20) AS security_type, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS reopening, o_totalprice AS offering,
  o_custkey % 7 AS ratio, strftime(o_orderdate, '%Y-%m-%d') AS auction_date FROM orders""",
    [
        ({"reopening": False, "limit": 6}, "reopening = false", "auction_date DESC NULLS LAST, id"),
        ({"reopening": "true", "min_bid_to_cover": 6.0, "cusip": "999999913"}, "reopening AND ratio >= 6 AND cusip = '999999913'", "auction_date DESC NULLS LAST, id"),
        ({"security_type": "HIGH", "sort_by": "offering_amount", "min_offering_amount": 1000.0, "limit": 9}, "security_type = 'HIGH' AND offering >= 1000", "offering DESC NULLS LAST, id"),
        ({"since": "1990-01-01", "until": "1996-01-10", "limit": 4}, "auction_date BETWEEN '1990-01-01' AND '1996-01-10'", "auction_date DESC NULLS LAST, id"),
        ({"reopening": 1}, "INVALID_ARGUMENT: reopening must be bool", "!"),
    ],
    "auction_date",
)

# Contributions: memo rows stay out unless they are asked for.

tool(
    "get_fec_contributions",
    Spec(
        "contributions", "sub_id",
        {
            "sub_id": equals("sub_id", point=True), "contributor_name": holds("name"), "contributor_state": equals("state"), "min_amount": at_least("amount"), "max_amount": at_most("amount"),
            "exclude_memos": Parameter(lambda v: F.coalesce(F.col("memo"), F.lit("")) != "X" if v else F.lit(True), bool),
        },
        {"contribution_receipt_date": "receipt_date", "amount": "amount"}, "contribution_receipt_date", date="receipt_date", complete=lambda a: {"exclude_memos": True, **a},
    ),
    lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("sub_id"), F.col("c_name").alias("name"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("state"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 6 == 0, "X").when(F.col("o_orderkey") % 6 == 1, "").alias("memo"), iso(F.col("o_orderdate")).alias("receipt_date"),
    ),
    """SELECT 'F' || o_orderkey AS sub_id, c_name AS name, 'S' || c_nationkey AS state, o_totalprice AS amount, CASE o_orderkey % 6 WHEN 0 THEN 'X' WHEN 1 THEN '' END AS memo,
  strftime(o_orderdate, '%Y-%m-%d') AS receipt_date FROM orders JOIN customer ON o_custkey = c_custkey""",
    [
        ({"sub_id": "F6"}, "sub_id = 'F6'", "sub_id"),
        ({"contributor_state": "S9", "limit": 12}, "state = 'S9' AND coalesce(memo, '') <> 'X'", "receipt_date DESC NULLS LAST, sub_id"),
        ({"contributor_state": "S9", "exclude_memos": False, "sort_by": "amount", "since": "1997-01-01", "limit": 12}, "state = 'S9' AND receipt_date >= '1997-01-01'", "amount DESC NULLS LAST, sub_id"),
        ({"min_amount": 100000.0, "max_amount": 101000.0, "contributor_name": "customer#"}, "amount BETWEEN 100000 AND 101000 AND coalesce(memo, '') <> 'X'", "receipt_date DESC NULLS LAST, sub_id"),
    ],
    "receipt_date",
)

# Complaints: prefix and substring filters, with the active sort field.

tool(
    "get_consumer_complaints",
    Spec(
        "complaints", "id",
        {"id": equals("id", int, point=True), "company": holds("company"), "product": equals("product"), "issue": holds("issue"), "state": equals("state"), "timely_response": equals("timely", bool)},
        {"date_received": "date_received", "company": "company"}, "date_received",
        notes=lambda a, held: [coverage.narrowed("timely_response", a.get("timely_response") is not None, "complaints without an answer")],
    ),
    lambda t: t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(
        F.col("event_id").alias("id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("product"), F.col("props").alias("issue"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("state"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 3 == 0).alias("timely"), iso(F.col("ts")).alias("date_received"),
    ),
    "SELECT event_id AS id, c_name AS company, c_mktsegment AS product, props AS issue, 'S' || c_nationkey AS state, CASE WHEN event_id % 7 > 0 THEN event_id % 3 = 0 END AS timely, strftime(ts, '%Y-%m-%d') AS date_received FROM events JOIN customer ON user_id = c_custkey",
    [
        ({"product": "BUILDING", "timely_response": False, "limit": 5}, "product = 'BUILDING' AND NOT timely", "date_received DESC NULLS LAST, id", ["'the filter on timely_response leaves out complaints without an answer, which never have it'"]),
        ({"company": "#000000008", "issue": "k"}, "contains(lower(company), '#000000008') AND regexp_matches(lower(issue), '\\bk\\b')", "date_received DESC NULLS LAST, id"),
        ({"state": "S2", "since": "2024-01-15", "until": "2024-01-15"}, "state = 'S2' AND date_received = '2024-01-15'", "date_received DESC NULLS LAST, id"),
        ({"id": 3}, "id = 3", "id"),
    ],
    "date_received",
)
