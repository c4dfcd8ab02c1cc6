"""Incremental operators: streams that run to the end of what is there, and event windows in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import limiter
from ..operators import relational as R
from ..session import fresh_folder
from ..streaming import jobs
from ..streaming.keyed_store import KeyedStore
from .base import Tables, query


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks take instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _events(t: Tables) -> DataFrame:
    """The files of the events table as a stream."""
    return _timed(jobs.follow(t.spark, f"{t.folder}/events.parque[t]", t.events.schema))  # a pattern, since a table may be one file or a folder


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS seq FROM orders""")
def q_upsert(t: Tables) -> DataFrame:
    """A base and a changed part of it through the keyed store, in two batches; the later sequence stays."""
    store = KeyedStore(t.spark, fresh_folder(t.spark, "upsert"), "o_orderkey long, o_orderstatus string, seq int", ["o_orderkey"], "seq")
    store.upsert(t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("seq")), 0)
    changes = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("seq"))
    store.upsert(changes, 1)
    store.upsert(changes.withColumn("o_orderstatus", F.lit("Y")), 1)  # the batch runs again and changes nothing
    return store.read()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_stream_dedup(t: Tables) -> DataFrame:
    """Events that arrive twice count once: a stream of all files and of a part of them again, behind a watermark."""
    events = _events(t)
    again = events.where("event_id % 3 = 0")
    once = jobs.deduplicated(events.unionByName(again), "event_id", "ts")
    return jobs.appended(once, fresh_folder(t.spark, "dedup")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY user_id""")
def q_stream_replay(t: Tables) -> DataFrame:
    """What a replay of the whole stream adds up to: running sums, upserted by user into the keyed store."""
    sums = _events(t).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    folder = fresh_folder(t.spark, "replay")
    store = KeyedStore(t.spark, f"{folder}/table", "user_id long, n long, total decimal(28,4)", ["user_id"], "n")
    jobs.replay(sums, store.sink(), f"{folder}/checkpoint", "update").awaitTermination()
    return store.read().select("user_id", "n", F.col("total").cast("double").alias("total"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY event_type""")
def q_late_filter(t: Tables) -> DataFrame:
    """A window read again: once the newest event has come, those behind the watermark, two days before it, are dropped.

    The stream is stopped and resumed from its checkpoint, which keeps the watermark; late rows are dropped from the
    second batch behind it on, so the newest event comes twice before the whole table does.
    """
    folder = fresh_folder(t.spark, "late")
    newest = t.events.agg(F.max_by(F.struct("*"), "ts").alias("e")).select("e.*")
    kept = None
    for landed in (newest, newest, t.events):
        landed.write.mode("append").parquet(f"{folder}/landing")
        events = _timed(jobs.follow(t.spark, f"{folder}/landing", t.events.schema))
        kept = jobs.appended(jobs.deduplicated(events, "event_id", "ts"), folder)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def q_tumbling(t: Tables) -> DataFrame:
    grouped = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.date_format(F.col("w")["start"], "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n")


@query("""SELECT strftime(a + INTERVAL (k * 30) MINUTE, '%Y-%m-%d %H:%M') AS w, count(*) AS n
FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS a, unnest([0, 1]) AS k FROM events) GROUP BY 1""")
def q_sliding(t: Tables) -> DataFrame:
    grouped = t.events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(F.date_format(F.col("w")["start"], "yyyy-MM-dd HH:mm").alias("w"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session(t: Tables) -> DataFrame:
    grouped = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.date_format(F.col("w")["start"], "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def q_window_count(t: Tables) -> DataFrame:
    """Hits of a user in the hour before each hit, rejected or not."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    window = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    return t.events.select("event_id", "user_id", seconds.alias("s")).select("event_id", F.count("*").over(window).alias("in_window"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, true AS admitted, [s] AS kept FROM e WHERE rn = 1 UNION ALL
  SELECT user_id, event_id, rn, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, s) ELSE k END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.s - 86400000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, admitted FROM r""")
def q_rate_window(t: Tables) -> DataFrame:
    """Every event admitted or not, at most 3 of a user within a day, rejected ones not recorded; see :mod:`..operators.limiter`."""
    hits = t.events.select(F.col("user_id").alias("client"), F.col("event_id").alias("hit"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return limiter.admitted(hits, 3, 86_400_000_000).select(F.col("client").alias("user_id"), F.col("hit").alias("event_id"), "admitted")


PRUNE = """x AS (SELECT (SELECT count(*) FROM customer) AS have, (SELECT count(*) FROM customer WHERE {0}) AS got)"""


@query(f"""WITH {PRUNE.format("c_custkey % 10 < 7")} SELECT c_custkey FROM customer, x WHERE NOT c_custkey % 10 < 7 AND got >= 0.5 * have""")
def q_guarded_prune(t: Tables) -> DataFrame:
    """Keys missing from a fresh snapshot are deleted, unless the snapshot is less than half of what is held."""
    whole = t.customer.select("c_custkey")
    fresh, stunted = whole.where("c_custkey % 10 < 7"), whole.where("c_custkey % 10 < 2")
    return R.guarded_prune(whole, fresh, "c_custkey").unionByName(R.guarded_prune(whole, stunted, "c_custkey"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' AND c_custkey % 10 >= 7 THEN 'terminated' WHEN c_mktsegment = 'BUILDING' THEN 'terminated' ELSE 'active' END AS status,
CASE WHEN c_mktsegment <> 'BUILDING' AND c_custkey % 10 >= 7 THEN '2026-01-01' END AS observed FROM customer""")
def q_guarded_soft_delete(t: Tables) -> DataFrame:
    """Active rows a source no longer lists are marked, with the day this was seen; history stays."""
    held = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "terminated").otherwise("active").alias("status"))
    active = held.where("status = 'active'")
    fresh = active.where("c_custkey % 10 < 7")
    gone = R.guarded_prune(active, fresh, "c_custkey").withColumn("gone", F.lit(True))
    rows = held.join(gone, "c_custkey", "left")
    return rows.select(
        "c_custkey", F.when(F.col("gone"), "terminated").otherwise(F.col("status")).alias("status"), F.when(F.col("gone"), "2026-01-01").alias("observed")
    )
