"""Aggregations, ranking, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso
from ..functions.numbers import exact_sum
from ..operators import relational as R
from ..session import fresh_folder
from ..streaming.telemetry import Telemetry
from .base import Tables, query

MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"


@query(f"SELECT l_partkey, sum(l_quantity) AS shares, {MONEY.format('l_extendedprice')} AS value, min(l_returnflag) AS first_flag FROM lineitem GROUP BY l_partkey")
def q_group_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("shares"), exact_sum(F.col("l_extendedprice")).alias("value"), F.min("l_returnflag").alias("first_flag")
    )


@query("""WITH x AS (SELECT o_orderkey, o_totalprice, count(l_orderkey) AS n_rows, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 0) AS DOUBLE) AS total
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice)
SELECT o_orderkey, CASE WHEN n_rows = 4 AND abs(total - o_totalprice) < 50000 THEN 'VERIFIED' ELSE 'INSUFFICIENT_DATA' END AS status,
array_to_string(list_filter([CASE WHEN n_rows <> 4 THEN 'rows' END, CASE WHEN abs(total - o_totalprice) >= 50000 THEN 'value' END], lambda r: r IS NOT NULL), ',') AS reasons FROM x""")
def q_control_totals(t: Tables) -> DataFrame:
    """Computed row count and sum, before any filter, against declared ones; what differs is listed."""
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), exact_sum(F.col("l_extendedprice")).alias("total"))
    rows = t.orders.join(sums, "o_orderkey", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("n", F.lit(0)) != 4, "rows"), F.when(F.abs(F.coalesce("total", F.lit(0.0)) - F.col("o_totalprice")) >= 50000, "value")
        )
    )
    status = F.when(F.size(reasons) == 0, "VERIFIED").otherwise("INSUFFICIENT_DATA")
    return rows.select("o_orderkey", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""SELECT l_suppkey, {MONEY.format('l_extendedprice')} AS value, row_number() OVER (ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,4))) DESC, l_suppkey) AS rn
FROM lineitem GROUP BY l_suppkey ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,4))) DESC, l_suppkey LIMIT 20""")
def q_topn_after_agg(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_suppkey").agg(exact_sum(F.col("l_extendedprice")).alias("value"))
    return R.top(sums, [F.desc("value"), F.asc("l_suppkey")], 20)


COVERED = """d AS (SELECT CASE WHEN o_orderkey % 997 = 0 THEN '0012-02-17' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders),
c AS (SELECT min(day) FILTER (WHERE day >= '1900-01-01') AS low, max(day) AS high FROM d)"""


def _coverage(t: Tables) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 997 == 0, "0012-02-17").otherwise(iso(F.col("o_orderdate")))
    return t.orders.select(day.alias("day")).agg(F.min(F.when(F.col("day") >= "1900-01-01", F.col("day"))).alias("low"), F.max("day").alias("high"))


@query(f"WITH {COVERED} SELECT low, high FROM c")
def q_coverage(t: Tables) -> DataFrame:
    return _coverage(t)


@query(f"""WITH {COVERED}, r(since, until) AS (VALUES ('1990-01-01', '1991-01-01'), ('1996-01-01', '1997-01-01'), ('1990-01-01', '1996-01-01'), ('2000-01-01', '2030-01-01'), ('2040-01-01', '2041-01-01'))
SELECT since, until, CASE WHEN until < low OR since > high THEN 'outside' WHEN since < low THEN 'older' WHEN until > high THEN 'newer' ELSE 'inside' END AS verdict FROM r, c""")
def q_coverage_verdict(t: Tables) -> DataFrame:
    """Each requested window against what the table holds."""
    asked = [("1990-01-01", "1991-01-01"), ("1996-01-01", "1997-01-01"), ("1990-01-01", "1996-01-01"), ("2000-01-01", "2030-01-01"), ("2040-01-01", "2041-01-01")]
    windows = F.array(*[F.struct(F.lit(a).alias("since"), F.lit(b).alias("until")) for a, b in asked])
    rows = _coverage(t).select("low", "high", F.explode(windows).alias("w")).select("low", "high", "w.*")
    outside = (F.col("until") < F.col("low")) | (F.col("since") > F.col("high"))
    verdict = F.when(outside, "outside").when(F.col("since") < F.col("low"), "older").when(F.col("until") > F.col("high"), "newer").otherwise("inside")
    return rows.select("since", "until", verdict.alias("verdict"))


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS source FROM orders GROUP BY 1),
w AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS held FROM orders WHERE o_orderstatus <> 'P' AND NOT (year(o_orderdate) = 1996 AND month(o_orderdate) = 5) GROUP BY 1)
SELECT m, source, coalesce(held, 0) AS held, coalesce(held, 0) - source AS delta, CASE WHEN held IS NULL THEN 'missing' WHEN held < source THEN 'short' ELSE 'complete' END AS status FROM s LEFT JOIN w USING (m)""")
def q_monthly_delta(t: Tables) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    source = t.orders.groupBy(month.alias("m")).agg(F.count("*").alias("source"))
    kept = t.orders.where("o_orderstatus <> 'P'").where(~((F.year("o_orderdate") == 1996) & (F.month("o_orderdate") == 5)))
    both = source.join(kept.groupBy(month.alias("m")).agg(F.count("*").alias("held")), "m", "left")
    status = F.when(F.col("held").isNull(), "missing").when(F.col("held") < F.col("source"), "short").otherwise("complete")
    held = F.coalesce("held", F.lit(0))
    return both.select("m", "source", held.alias("held"), (held - F.col("source")).alias("delta"), status.alias("status"))


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_latest_per_key(t: Tables) -> DataFrame:
    return R.rank_one(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q_latest_two_keys(t: Tables) -> DataFrame:
    return R.rank_one(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT o_custkey, year(o_orderdate) AS y, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_latest_filing(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("y", F.year("o_orderdate").cast("long"))
    return R.rank_one(rows, ["o_custkey", "y"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "y", "o_orderkey")


@query("""SELECT DISTINCT o_custkey, last_value(o_totalprice) OVER w AS latest_value, first_value(year(o_orderdate)) OVER w AS first_year FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def q_latest_and_first(t: Tables) -> DataFrame:
    """Payload of the latest filing, year of the earliest: one aggregation over an ordered pair of keys."""
    order = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.max_by("o_totalprice", order).alias("latest_value"), F.min_by(F.year("o_orderdate").cast("long"), order).alias("first_year")
    )


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 OR o_custkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS filed, o_totalprice AS value, year(o_orderdate) - o_orderkey % 2 AS fiscal_year,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CY' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '' END AS frame FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY filed DESC, CASE WHEN filed = '' THEN seq ELSE -seq END) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY filed = '', filed, seq) AS b FROM r),
f AS (SELECT o_custkey, arg_min(frame, seq) AS frame FROM r WHERE frame <> '' GROUP BY 1)
SELECT l.o_custkey, l.seq, l.filed, l.value, e.fiscal_year, coalesce(nullif(l.frame, ''), f.frame, l.frame) AS frame
FROM (SELECT * FROM k WHERE a = 1) l JOIN (SELECT * FROM k WHERE b = 1) e ON l.o_custkey = e.o_custkey LEFT JOIN f ON f.o_custkey = l.o_custkey""")
def q_supersession(t: Tables) -> DataFrame:
    """The latest filing's row with the earliest one's year and a frame if any has one; blank dates supersede nothing."""
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_custkey", k.alias("seq"), F.when((k % 4 == 0) | (F.col("o_custkey") % 9 == 0), "").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("filed"), F.col("o_totalprice").alias("value"),
        (F.year("o_orderdate") - k % 2).alias("fiscal_year"), F.when(k % 3 == 0, F.concat(F.lit("CY"), k.cast("string"))).when(k % 3 == 1, "").alias("frame"),
    )
    return R.supersede(rows, ["o_custkey"], "filed", "seq", ["fiscal_year"], ["frame"])


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority""")
def q_dedup_first(t: Tables) -> DataFrame:
    return R.rank_one(t.orders, ["o_custkey", "o_orderpriority"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem")
def q_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs")
    )


@query("""WITH c AS (SELECT coalesce(nullif(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, ''), '(none)') AS kind, count(*) AS n FROM lineitem GROUP BY 1),
e(kind) AS (VALUES ('A'), ('R'), ('X'), ('(none)')) SELECT kind, coalesce(n, 0) AS n FROM e FULL JOIN c USING (kind)""")
def q_type_census(t: Tables) -> DataFrame:
    """Counts by type: blank is ``(none)``, expected types without rows are shown with zero."""
    kind = F.coalesce(F.nullif(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit("")), F.lit("(none)"))
    found = t.lineitem.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    expected = t.spark.createDataFrame([("A",), ("R",), ("X",), ("(none)",)], "kind string")
    return expected.join(found, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT coalesce(CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y') END, '—') AS y, count(*) AS n FROM orders GROUP BY 1""")
def q_year_tally(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy"))
    return t.orders.groupBy(F.coalesce(year, F.lit("—")).alias("y")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(*) AS source, count(o_custkey) AS present, CASE WHEN count(*) = 0 THEN 0 ELSE count(o_custkey) * 100.0::DOUBLE / count(*) END AS coverage_pct
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def q_coverage_pct(t: Tables) -> DataFrame:
    held = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("held")).distinct()
    n, present = F.count("*"), F.count("held")
    pct = F.when(n == 0, 0.0).otherwise(present * F.lit(100.0) / n)
    return t.customer.join(held, "c_custkey", "left").groupBy("c_mktsegment").agg(n.alias("source"), present.alias("present"), pct.alias("coverage_pct"))


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'recoverable' WHEN 1 THEN 'nil' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'gone' ELSE 'unclassified' END AS class FROM orders)
SELECT count(*) FILTER (WHERE class = 'recoverable') AS recoverable, count(*) FILTER (WHERE class = 'nil') AS nil, count(*) FILTER (WHERE class = 'unreadable') AS unreadable,
count(*) FILTER (WHERE class = 'gone') AS gone, count(*) FILTER (WHERE class = 'unclassified') AS unclassified, count(*) FILTER (WHERE class IN ('recoverable', 'unclassified')) AS unexplained FROM k""")
def q_class_tally(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    names = ["recoverable", "nil", "unreadable", "gone"]
    kind = F.lit("unclassified")
    for number, name in enumerate(names):
        kind = F.when(k == number, name).otherwise(kind)
    counts = [F.count_if(kind == name).alias(name) for name in [*names, "unclassified"]]
    return t.orders.agg(*counts, F.count_if(kind.isin("recoverable", "unclassified")).alias("unexplained"))


@query("""SELECT l_shipmonth AS m, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_filings, count(*) * 1.0::DOUBLE / count(DISTINCT l_orderkey) AS ratio
FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_orderkey FROM lineitem) GROUP BY 1""")
def q_compression_ratio(t: Tables) -> DataFrame:
    n, distinct = F.count("*"), F.count_distinct("l_orderkey")
    return t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(
        n.alias("n_rows"), distinct.alias("n_filings"), (n * F.lit(1.0) / distinct).alias("ratio")
    )


STATES = """s AS (SELECT event_type, date_diff('second', max(ts), TIMESTAMP '2024-01-30 12:00:00') / 3600.0 AS age FROM events GROUP BY event_type),
f AS (SELECT event_type, CASE WHEN age > CASE event_type WHEN 'view' THEN 60 ELSE 24 END THEN 'fail' WHEN age > CASE event_type WHEN 'view' THEN 36 ELSE 6 END THEN 'warn' ELSE 'ok' END AS status FROM s)"""
THRESHOLDS = {"view": (36, 60)}


def _judged(seen: DataFrame) -> DataFrame:
    """``event_type, status`` from ``event_type, last`` in seconds."""
    now = F.unix_seconds(F.lit("2024-01-30 12:00:00").cast("timestamp"))
    age, daily = (now - F.col("last")) / 3600.0, F.col("event_type").isin(list(THRESHOLDS))
    warn, fail = F.when(daily, 36).otherwise(6), F.when(daily, 60).otherwise(24)
    return seen.select("event_type", F.when(age > fail, "fail").when(age > warn, "warn").otherwise("ok").alias("status"))


def _freshness(t: Tables) -> DataFrame:
    return _judged(t.events.groupBy("event_type").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last")))


@query(f"""WITH {STATES} SELECT event_type, status FROM f UNION ALL
SELECT 'overall', CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END FROM f""")
def q_freshness(t: Tables) -> DataFrame:
    """Age of each job's last report against its thresholds at a given moment, and the worst of all.

    The jobs are the kinds of events; their reports go through the telemetry table, in two merges of different fields.
    """
    jobs = Telemetry(t.spark, fresh_folder(t.spark, "telemetry"))
    last = F.date_format(F.max(F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    jobs.merge(t.events.groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("docs_written")))
    jobs.merge(t.events.groupBy(F.col("event_type").alias("job")).agg(last.alias("last_synced_at")))
    seen = jobs.rows().where("docs_written > 0").select(F.col("job").alias("event_type"), F.unix_seconds(F.to_timestamp("last_synced_at")).alias("last"))
    rows = _judged(seen)
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return rows.unionByName(rows.agg(F.lit("overall").alias("event_type"), F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("ok").alias("status")))


@query(f"""WITH {STATES}, p AS (SELECT event_type, status, CASE WHEN event_type IN ('view', 'click') THEN 'ok' ELSE 'fail' END AS before, 30 AS hours FROM f)
SELECT event_type, status <> before OR (status = 'fail' AND hours >= 24) OR (status = 'ok' AND hours >= 168) AS notify FROM p""")
def q_notify(t: Tables) -> DataFrame:
    before, hours = F.when(F.col("event_type").isin("view", "click"), "ok").otherwise("fail"), F.lit(30)
    bad, fine = F.col("status") == "fail", F.col("status") == "ok"
    return _freshness(t).select("event_type", ((F.col("status") != before) | (bad & (hours >= 24)) | (fine & (hours >= 168))).alias("notify"))


@query(f"""WITH {STATES} SELECT event_type, status, row_number() OVER (ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 2 ELSE 3 END, event_type) AS rn FROM f""")
def q_sort_rank(t: Tables) -> DataFrame:
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 2).otherwise(3)
    return R.top(_freshness(t), [F.asc(rank), F.asc("event_type")], 100)


@query("""SELECT count(*) FILTER (WHERE year(o_orderdate) >= 2001) AS future, count(*) FILTER (WHERE year(o_orderdate) < 1996) AS ancient, count(*) FILTER (WHERE o_totalprice > 300000) AS large FROM orders""")
def q_conditional_counts(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    return t.orders.agg(F.count_if(year >= 2001).alias("future"), F.count_if(year < 1996).alias("ancient"), F.count_if(F.col("o_totalprice") > 300000).alias("large"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS d, count(*) AS n FROM lineitem GROUP BY ALL")
def q_tuple_histogram(t: Tables) -> DataFrame:
    discount = F.when(F.col("l_discount") > 0.05, "high").otherwise("low")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", discount.alias("d")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20")
def q_top_by_count(t: Tables) -> DataFrame:
    return R.top(t.events.groupBy("user_id").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("user_id")], 20)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ordinal FROM lineitem""")
def q_ordinal(t: Tables) -> DataFrame:
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    ordinal = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*columns, "l_shipdate"))
    return t.lineitem.select("l_orderkey", *columns, ordinal.cast("long").alias("ordinal"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def q_topn_per_group(t: Tables) -> DataFrame:
    return R.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rn")


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT 'customer' AS kind, c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def q_union_all(t: Tables) -> DataFrame:
    one = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    two = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return one.unionByName(two)
