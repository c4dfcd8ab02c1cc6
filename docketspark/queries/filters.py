"""Scans, lookups, predicates and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions.dates import iso
from ..functions.numbers import exact_sum
from ..operators import relational as R
from ..session import fresh_folder
from ..sources import readers
from .base import Tables, query

DAY = "%Y-%m-%d"


@query("SELECT * FROM nation")
def q_scan(t: Tables) -> DataFrame:
    return t.nation


@query("SELECT o_orderkey, o_totalprice FROM orders")
def q_projection(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM lineitem")
def q_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77 LIMIT 1")
def q_point_lookup(t: Tables) -> DataFrame:
    """A key lookup ignores all other filters and returns at most one row."""
    return t.orders.where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_quantity) AS top_quantity FROM lineitem
WHERE l_orderkey || '-' || l_linenumber IN ('7-1', '32-2', '100-3') GROUP BY l_orderkey, l_linenumber""")
def q_composite_lookup(t: Tables) -> DataFrame:
    # pairs of equalities reach the scan and prune row groups, which a key made of text would not
    one = lambda order, line: (F.col("l_orderkey") == order) & (F.col("l_linenumber") == line)
    return t.lineitem.where(one(7, 1) | one(32, 2) | one(100, 3)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top_quantity"))


@query("""SELECT l.l_orderkey, count(*) AS n FROM lineitem l
WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 301 = 0) GROUP BY l.l_orderkey""")
def q_multi_get(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderkey % 301 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 5000)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500""")
def q_keyset_page(t: Tables) -> DataFrame:
    """The page after a cursor in the total order; the predicate stands for the skipped pages."""
    cursor = F.lit("1998-06-01").cast("timestamp_ntz")
    after = (F.col("o_orderdate") < cursor) | ((F.col("o_orderdate") == cursor) & (F.col("o_orderkey") < 5000))
    page = R.top(t.orders.where(after), [F.desc("o_orderdate"), F.desc("o_orderkey")], 500)
    return page.select("o_orderkey", iso(F.col("o_orderdate")).alias("day"), "rn")


@query("""WITH live AS (SELECT o_orderkey, 'live' AS source FROM orders WHERE o_orderpriority = 'none' AND o_totalprice > 400000),
cache AS (SELECT o_orderkey, 'cache' AS source FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
SELECT * FROM live UNION ALL SELECT * FROM cache WHERE NOT EXISTS (SELECT 1 FROM live)""")
def q_live_first(t: Tables) -> DataFrame:
    """The live branch, or the cached one if the live branch is empty; rows say where they come from."""
    live = t.orders.where("o_orderpriority = 'none' and o_totalprice > 400000").select("o_orderkey", F.lit("live").alias("source"))
    cache = t.orders.where("o_orderstatus = 'F' and o_totalprice > 300000").select("o_orderkey", F.lit("cache").alias("source"))
    any_live = live.limit(1).select(F.lit("cache").alias("source"))
    return live.unionByName(cache.join(F.broadcast(any_live), "source", "left_anti"))


@query("""SELECT count(*) AS total_count, least(count(*), 50) AS returned, count(*) > 50 AS has_more FROM orders WHERE o_orderstatus = 'O'""")
def q_total_count(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.orders.where("o_orderstatus = 'O'").agg(n.alias("total_count"), F.least(n, F.lit(50)).alias("returned"), (n > 50).alias("has_more"))


@query("""SELECT event_id, user_id, event_type, value FROM events""")
def q_delimited(t: Tables) -> DataFrame:
    """Rows through a pipe-delimited line and back."""
    line = F.concat_ws("|", "event_id", "user_id", "event_type", "value")
    part = F.split(line, r"\|")
    return t.events.select(
        part[0].cast("long").alias("event_id"), part[1].cast("long").alias("user_id"), part[2].alias("event_type"), part[3].cast("double").alias("value")
    )


@query("""SELECT l_orderkey || '-' || l_linenumber AS instrument, strftime(l_shipdate, '%Y-%m-%d') AS settlement_date, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice END AS price,
CASE WHEN l_partkey % 5 > 0 THEN CAST(l_quantity AS BIGINT) * l_extendedprice ELSE 0 END AS fail_value FROM lineitem""")
def q_settlements(t: Tables) -> DataFrame:
    """Lines of a settlement file, with headers, notes and prices that are no numbers, through the reader."""
    price = F.when(F.col("l_partkey") % 5 > 0, F.col("l_extendedprice").cast("string")).otherwise(".")
    line = F.concat_ws("|", F.date_format("l_shipdate", "yyyyMMdd"), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("SYM"), F.col("l_quantity").cast("long").cast("string"), F.lit("A NAME"), price)
    odd = F.when(F.col("l_linenumber") == 1, F.array(F.lit("SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE"), line, F.lit("Trailer record count 7"))).otherwise(F.array(line))
    path = fresh_folder(t.spark, "settlements")
    t.lineitem.select(F.explode(odd).alias("value")).write.text(path)
    return readers.settlements(t.spark, path).select("instrument", "settlement_date", "quantity", "price", "fail_value")


@query("""SELECT o_orderkey, 'cache' AS source, true AS warned FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 'live', false FROM customer""")
def q_live_fallback(t: Tables) -> DataFrame:
    """A live source that fails gives the cached rows and a warning; one that answers gives its own."""
    cached = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    failed, warning = readers.live_first(lambda: t.spark.read.parquet(f"{t.folder}/no-such-service.parquet").select("o_orderkey"), lambda: cached)
    fine, silence = readers.live_first(lambda: t.customer.select(F.col("c_custkey").alias("o_orderkey")), lambda: cached)
    return failed.withColumn("warned", F.lit(warning is not None)).unionByName(fine.withColumn("warned", F.lit(silence is not None)))


@query("""SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY event_type""")
def q_json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count("*").alias("n"))


@query("""SELECT doc_id, octet_length(encode(text)) > 8000 AS size_truncated,
CASE WHEN octet_length(encode(text)) > 8000 THEN substr(text, 1, 500) ELSE text END AS text FROM documents""")
def q_size_cap(t: Tables) -> DataFrame:
    big = F.octet_length("text") > 8000
    return t.documents.select("doc_id", big.alias("size_truncated"), F.when(big, F.substring("text", 1, 500)).otherwise(F.col("text")).alias("text"))


@query("SELECT doc_id, substr(text, 1, 100) AS head, length(text) > 100 AS truncated FROM documents")
def q_truncate_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 100).alias("head"), (F.length("text") > 100).alias("truncated"))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def q_filter_eq(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n"), exact_sum(F.col("o_totalprice")).alias("total"))


@query("SELECT p_partkey, p_size > 25 AS is_large FROM part WHERE (p_size > 25) = false")
def q_filter_bool(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_size") > 25).alias("is_large")).where(F.col("is_large") == F.lit(False))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
def q_filter_in(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 150000")
def q_filter_range(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice >= 100000 and o_totalprice <= 150000").select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) WHERE coalesce(bal, 0) >= 0 AND coalesce(bal, 0) <= 100""")
def q_filter_range_coalesce(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return rows.where("coalesce(bal, 0) >= 0 and coalesce(bal, 0) <= 100")


ARRAYS = """WITH a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS priorities,
list_distinct(list(o_orderstatus)) AS statuses, count(*) AS n FROM orders GROUP BY o_custkey)"""


def _arrays(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.collect_set("o_orderstatus").alias("statuses"), F.count("*").alias("n")
    )


@query(ARRAYS + " SELECT o_custkey, n FROM a WHERE list_contains(priorities, '1-URGENT')")
def q_array_contains(t: Tables) -> DataFrame:
    return _arrays(t).where(F.array_contains("priorities", "1-URGENT")).select("o_custkey", "n")


@query(ARRAYS + " SELECT o_custkey, n FROM a WHERE list_has_any(statuses, ['P', 'F'])")
def q_array_overlap(t: Tables) -> DataFrame:
    return _arrays(t).where(F.arrays_overlap("statuses", F.array(F.lit("P"), F.lit("F")))).select("o_custkey", "n")


@query(ARRAYS + " SELECT o_custkey, array_to_string(list_transform(priorities, lambda x: x || '=' || lower(x)), '; ') AS joined FROM a")
def q_array_join(t: Tables) -> DataFrame:
    joined = F.array_join(F.transform("priorities", lambda x: F.concat(x, F.lit("="), F.lower(x))), "; ")
    return _arrays(t).select("o_custkey", joined.alias("joined"))


@query("""WITH a AS (SELECT c.c_nationkey, list_distinct(flatten(list([o.o_orderstatus, o.o_orderpriority]))) AS x
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey) SELECT c_nationkey, array_to_string(list_sort(x), ',') AS codes FROM a""")
def q_array_distinct_union(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    nested = F.collect_set(F.array("o_orderstatus", "o_orderpriority"))
    return rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(nested))), ",").alias("codes"))


@query(ARRAYS + " SELECT avg(len(priorities)) AS avg_size, count(*) AS n FROM a")
def q_avg_size(t: Tables) -> DataFrame:
    return _arrays(t).agg(F.avg(F.size("priorities")).alias("avg_size"), F.count("*").alias("n"))


@query(ARRAYS + " SELECT o_custkey FROM a WHERE len(list_filter(priorities, lambda x: contains(lower(x), 'urgent'))) > 0")
def q_substring_array(t: Tables) -> DataFrame:
    return _arrays(t).where(T.any_safe_substring(F.col("priorities"), "Urgent")).select("o_custkey")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE upper(o_orderpriority) = '5-LOW' AND o_orderstatus = 'F'""")
def q_struct_array_member(t: Tables) -> DataFrame:
    """Equality on members of an array of structs, in any case."""
    nested = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderpriority", "o_orderstatus")).alias("members"))
    member = lambda x: (F.upper(x["o_orderpriority"]) == "5-LOW") & (x["o_orderstatus"] == "F")
    return nested.where(F.exists("members", member)).select("o_custkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-03-01' AND '1996-03-31'")
def q_date_window(t: Tables) -> DataFrame:
    """Inclusive window on the sort field; stated on the column itself, so the scan can prune."""
    day = F.col("o_orderdate")
    window = (day >= F.lit("1996-03-01").cast("timestamp_ntz")) & (day < F.lit("1996-04-01").cast("timestamp_ntz"))
    return t.orders.where(window).select("o_orderkey", iso(day).alias("day"))


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders
WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-12-31' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def q_date_window_fixed(t: Tables) -> DataFrame:
    """The window binds to the date whatever the sort."""
    rows = t.orders.where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return R.top(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_totalprice", "rn")


@query("""SELECT o_orderkey, max(strftime(l_shipdate, '%Y-%m-%d')) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' AND strftime(l_shipdate, '%Y-%m-%d') <= '1996-06-30' GROUP BY o_orderkey""")
def q_two_windows(t: Tables) -> DataFrame:
    rows = t.orders.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).join(
        t.lineitem.where(F.col("l_shipdate") < F.lit("1996-07-01").cast("timestamp_ntz")), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return rows.groupBy("o_orderkey").agg(F.max(iso(F.col("l_shipdate"))).alias("shipped"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def q_year_window(t: Tables) -> DataFrame:
    return t.orders.select(F.year("o_orderdate").cast("long").alias("y")).where("y between 1996 and 1998").groupBy("y").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '2031-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT o_orderkey, day FROM d WHERE day = '' OR CAST(substr(day, 1, 4) AS INTEGER) <= 2026""")
def q_future_guard(t: Tables) -> DataFrame:
    """Impossible future years are dropped, blank dates kept; the year is a parameter."""
    day = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "2031-01-01").otherwise(iso(F.col("o_orderdate")))
    rows = t.orders.select("o_orderkey", day.alias("day"))
    return rows.where((F.col("day") == "") | (F.substring("day", 1, 4).try_cast("int") <= 2026))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'econ')")
def q_substring_long(t: Tables) -> DataFrame:
    return t.part.where(T.safe_substring(F.col("p_type"), "Econ")).select("p_partkey", "p_name")


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\ble\b')""")
def q_substring_short(t: Tables) -> DataFrame:
    """Short needles are whole words between ASCII boundaries, also beside accented letters."""
    return t.documents.where(T.safe_substring(F.col("text"), "LE")).select("doc_id")


@query("""WITH o AS (SELECT o_custkey, list(o_orderpriority) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey FROM customer LEFT JOIN o ON o_custkey = c_custkey
WHERE contains(lower(c_mktsegment), 'build') OR len(list_filter(coalesce(p, []), lambda x: contains(lower(x), 'urgent'))) > 0""")
def q_substring_scalar_or_array(t: Tables) -> DataFrame:
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderpriority").alias("p"))
    found = T.safe_substring(F.col("c_mktsegment"), "build") | T.any_safe_substring(F.col("p"), "urgent")
    return t.customer.join(lists, "c_custkey", "left").where(found).select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'brand#4')""")
def q_text_search_multi(t: Tables) -> DataFrame:
    columns = {"p_name": "widget", "p_type": "promo", "p_brand": "brand#4"}
    found = F.lit(False)
    for name, needle in columns.items():
        found = found | T.safe_substring(F.col(name), needle)
    return t.part.where(found).select("p_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1-') OR starts_with(o_orderpriority, '2-')")
def q_prefix(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").startswith("1-") | F.col("o_orderpriority").startswith("2-")).select("o_orderkey", "o_orderpriority")



@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")
def q_flag_mapped(t: Tables) -> DataFrame:
    """Flags stand for predicates: ``active_only`` for a status, ``exclude_low`` for a priority."""
    flags = {"active_only": F.col("o_orderstatus") == "O", "exclude_low": F.col("o_orderpriority") != "5-LOW"}
    rows = t.orders
    for name in ("active_only", "exclude_low"):
        rows = rows.where(flags[name])
    return rows.select("o_orderkey")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS memo FROM lineitem)
SELECT count(*) AS n, sum(l_quantity) AS quantity FROM d WHERE NOT coalesce(memo, false)""")
def q_default_exclusion(t: Tables) -> DataFrame:
    """Memo rows go unless asked for; rows without the flag stay."""
    memo = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return t.lineitem.withColumn("memo", memo).where(~F.coalesce("memo", F.lit(False))).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey < 500 AND o_orderstatus = 'F' AND o_totalprice > 100000")
def q_priority_filter(t: Tables) -> DataFrame:
    """All given dimensions apply, not only the first."""
    return t.orders.where("o_custkey < 500").where("o_orderstatus = 'F'").where("o_totalprice > 100000").select("o_orderkey")


NATURE_SQL = """CASE WHEN upper(trim(split_part(trim(code), '/', 1))) IN ('P', 'S') THEN 'OPEN_MARKET'
WHEN upper(trim(split_part(trim(code), '/', 1))) IN ('A', 'M', 'I', 'C', 'X', 'O') THEN 'EQUITY_COMP'
WHEN upper(trim(split_part(trim(code), '/', 1))) IN ('D', 'F', 'G', 'W', 'Z', 'U') THEN 'NON_OPEN_MARKET_TRANSFER' ELSE 'INSUFFICIENT_DATA' END"""
CODES_SQL = """codes AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag,
CASE l_partkey % 6 WHEN 0 THEN 'P' WHEN 1 THEN 's/K' WHEN 2 THEN 'A' WHEN 3 THEN ' G ' WHEN 4 THEN '' ELSE 'J' END AS code FROM lineitem)"""


def with_code(t: Tables) -> DataFrame:
    k = F.col("l_partkey") % 6
    code = F.when(k == 0, "P").when(k == 1, "s/K").when(k == 2, "A").when(k == 3, " G ").when(k == 4, "").otherwise("J")
    return t.lineitem.withColumn("code", code)


@query(f"""WITH {CODES_SQL}, n AS (SELECT *, {NATURE_SQL} AS nature FROM codes)
SELECT l_orderkey, l_partkey, l_extendedprice, nature, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn
FROM n WHERE nature = 'EQUITY_COMP' ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 50""")
def q_post_filter(t: Tables) -> DataFrame:
    """A filter on a derived column comes before the limit."""
    rows = with_code(t).withColumn("nature", C.nature(F.col("code"))).where(F.col("nature") == C.COMP)
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return R.top(rows, order, 50).select("l_orderkey", "l_partkey", "l_extendedprice", "nature", "rn")


@query(f"""WITH {CODES_SQL}, n AS (SELECT *, {NATURE_SQL} AS nature FROM codes)
SELECT 'with_direction' AS context, count(*) AS n FROM n WHERE nature IN ('OPEN_MARKET', 'INSUFFICIENT_DATA') AND l_returnflag = 'R'
UNION ALL SELECT 'without_direction', count(*) FROM n""")
def q_context_default(t: Tables) -> DataFrame:
    """Unless asked otherwise, other natures are included only if no direction is given."""
    rows = with_code(t).withColumn("nature", C.nature(F.col("code")))

    def answer(context: str, flag: str | None, include_other: bool | None = None) -> DataFrame:
        include = include_other if include_other is not None else flag is None
        kept = rows if flag is None else rows.where(F.col("l_returnflag") == flag)
        kept = kept if include else kept.where(F.col("nature").isin(C.OPEN, C.UNKNOWN))
        return kept.agg(F.lit(context).alias("context"), F.count("*").alias("n"))

    return answer("with_direction", "R").unionByName(answer("without_direction", None))


@query(f"""WITH {CODES_SQL}, n AS (SELECT *, {NATURE_SQL} AS nature FROM codes)
SELECT count(*) AS kept, count(*) FILTER (WHERE nature = 'INSUFFICIENT_DATA') AS unknown_retained FROM n WHERE nature IN ('OPEN_MARKET', 'INSUFFICIENT_DATA')""")
def q_keep_unclassified(t: Tables) -> DataFrame:
    rows = with_code(t).withColumn("nature", C.nature(F.col("code"))).where(F.col("nature").isin(C.OPEN, C.UNKNOWN))
    return rows.agg(F.count("*").alias("kept"), F.count_if(F.col("nature") == C.UNKNOWN).alias("unknown_retained"))


@query("""WITH f AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 400000 THEN 'amount' END,
CASE WHEN year(o_orderdate) > 2000 THEN 'date' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL) AS flags FROM orders)
SELECT o_orderkey, array_to_string(flags, ',') AS flags FROM f WHERE len(flags) > 0""")
def q_sanity_flags(t: Tables) -> DataFrame:
    flags = F.array_compact(
        F.array(
            F.when(F.col("o_totalprice") > 400000, "amount"), F.when(F.year("o_orderdate") > 2000, "date"), F.when(F.col("o_orderstatus") == "P", "status")
        )
    )
    return t.orders.withColumn("flags", flags).where(F.size("flags") > 0).select("o_orderkey", F.array_join("flags", ",").alias("flags"))


# --- sorting -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def q_sort_limit(t: Tables) -> DataFrame:
    window = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))
    rows = t.orders.where(F.col("o_orderstatus") == "O").where(window)
    return R.top(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_totalprice", "rn")


@query("""SELECT o_orderstatus, least(count(*), 500) AS returned, count(*) > 500 AS has_more FROM orders GROUP BY o_orderstatus""")
def q_has_more(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.orders.groupBy("o_orderstatus").agg(F.least(n, F.lit(500)).alias("returned"), (n > 500).alias("has_more"))


def _ranked(t: Tables, key, rows: DataFrame | None = None) -> DataFrame:
    rows = t.customer if rows is None else rows
    return R.top(rows, [*key, F.asc("c_custkey")], 100).select("c_custkey", "rn")


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY bal DESC NULLS LAST, c_custkey) AS rn FROM d ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 100""")
def q_sort_nulls_last(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("bal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return _ranked(t, [F.desc_nulls_last("bal")], rows)


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS a, c_name AS b FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY coalesce(nullif(a, ''), b), c_custkey) AS rn FROM d ORDER BY coalesce(nullif(a, ''), b), c_custkey LIMIT 100""")
def q_sort_coalesce(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("a", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")))
    return _ranked(t, [F.asc(F.coalesce(F.nullif(F.col("a"), F.lit("")), F.col("c_name")))], rows)


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_mktsegment END AS a FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY coalesce(a, ''), c_custkey) AS rn FROM d ORDER BY coalesce(a, ''), c_custkey LIMIT 100""")
def q_sort_missing_empty(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("a", F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")))
    return _ranked(t, [F.asc(F.coalesce("a", F.lit("")))], rows)


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS a FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY coalesce(try_cast(a AS INTEGER), 0), c_custkey) AS rn FROM d ORDER BY coalesce(try_cast(a AS INTEGER), 0), c_custkey LIMIT 100""")
def q_sort_numeric_string(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("a", F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise((F.col("c_custkey") % 1000).cast("string")))
    return _ranked(t, [F.asc(F.coalesce(F.col("a").try_cast("int"), F.lit(0)))], rows)


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) AS rn FROM customer ORDER BY c_mktsegment, c_name, c_custkey LIMIT 100""")
def q_sort_name(t: Tables) -> DataFrame:
    return _ranked(t, [F.asc("c_mktsegment"), F.asc("c_name")])


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey) AS rn
FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 100""")
def q_sort_priority(t: Tables) -> DataFrame:
    return _ranked(t, [F.asc(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)), F.desc("c_acctbal")])
