"""Joins, enrichment, entity resolution, comparison and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions.dates import iso
from ..operators import entities as E
from ..operators import identifiers
from ..operators import relational as R
from ..plans import fanout, reconcile
from ..session import fresh_folder
from ..streaming import manifest
from .base import Tables, query


@query("""SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def q_join_inner(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""WITH c AS (SELECT l_orderkey, array_to_string(list_transform(list_sort(list(l_linenumber * 1000000 + l_partkey)), lambda x: CAST(x AS VARCHAR)), ';') AS children FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, children FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def q_join_collect(t: Tables) -> DataFrame:
    """Children of each parent as one array, in a fixed order, beside parents without any."""
    child = (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("c")
    nested = R.nest(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), child), "o_orderkey", ["c"], ["c"], "children")
    joined = F.array_join(F.transform("children", lambda x: x["c"].cast("string")), ";")
    return t.orders.join(nested, "o_orderkey", "left").select("o_orderkey", joined.alias("children"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_child_counts(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.orders.select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", zero("n"), zero("returned"))


@query("""WITH r AS (SELECT o_orderkey, unnest([o_orderkey % 2500, o_custkey % 2000]) AS ref, unnest([0, 1]) AS pos FROM orders)
SELECT o_orderkey, string_agg(coalesce(p_brand, '(unresolved)'), ';' ORDER BY pos) AS notes FROM r LEFT JOIN part ON p_partkey = ref GROUP BY o_orderkey""")
def q_ref_lookup(t: Tables) -> DataFrame:
    """Inline references, split from text, looked up with a default and collected in their order."""
    text = F.concat_ws(", ", F.col("o_orderkey") % 2500, F.col("o_custkey") % 2000)
    refs = t.orders.select("o_orderkey", F.posexplode(T.tokens(text)).alias("pos", "ref")).withColumn("p_partkey", F.col("ref").cast("long"))
    found = refs.join(t.part.select("p_partkey", "p_brand"), "p_partkey", "left")
    note = F.struct("pos", F.coalesce("p_brand", F.lit("(unresolved)")).alias("note"))
    return found.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list(note))["note"], ";").alias("notes"))


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)
SELECT r_name, string_agg(n_name || ':' || coalesce(n, 0), ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY r_name""")
def q_three_way_nest(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = t.nation.join(counts, "n_nationkey", "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct("n_name", F.coalesce("n", F.lit(0)).cast("string").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["n_name"], x["n"]))
    return rows.groupBy("r_name").agg(F.array_join(listed, ",").alias("nations"))


@query("""WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS children FROM customer LEFT JOIN k ON o_custkey = c_custkey AND rn <= 3 GROUP BY c_custkey""")
def q_parent_children(t: Tables) -> DataFrame:
    """At most three children of each parent, flagged ones first, then the latest."""
    order = [F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1), F.desc("o_orderdate"), F.asc("o_orderkey")]
    kept = R.top_per_group(t.orders, ["o_custkey"], order, 3).withColumnRenamed("o_custkey", "c_custkey")
    nested = R.nest(kept, "c_custkey", ["rn", "o_orderkey"], ["rn"], "children")
    joined = F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",")
    return t.customer.select("c_custkey").join(nested, "c_custkey", "left").select("c_custkey", joined.alias("children"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey % 2000 AS ref, o_custkey % 25 AS nat, CASE o_orderkey % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' ELSE 'NONE' END AS seg, o_orderdate AS d FROM orders),
t1 AS (SELECT c_custkey AS ref, c_nationkey AS nat, c_custkey AS id FROM customer),
t2 AS (SELECT c_nationkey AS nat, c_mktsegment AS seg, min(c_custkey) AS id FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) = 1),
t3 AS (SELECT s_suppkey AS ref, min(s_suppkey) AS id FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1),
t4 AS (SELECT n_nationkey AS nat, TIMESTAMP '1995-01-01' + INTERVAL (n_nationkey * 60) DAY AS a, TIMESTAMP '1995-01-01' + INTERVAL (n_nationkey * 60 + 400) DAY AS b, n_nationkey AS id FROM nation),
m4 AS (SELECT q.o_orderkey, min(t4.id) AS id FROM q JOIN t4 ON q.nat = t4.nat AND q.d BETWEEN t4.a AND t4.b GROUP BY 1 HAVING count(DISTINCT t4.id) = 1)
SELECT q.o_orderkey, coalesce(t1.id, t2.id, t3.id, m4.id) AS id, CASE WHEN t1.id IS NOT NULL THEN 1 WHEN t2.id IS NOT NULL THEN 2 WHEN t3.id IS NOT NULL THEN 3 WHEN m4.id IS NOT NULL THEN 4 END AS tier
FROM q LEFT JOIN t1 ON q.ref = t1.ref AND q.nat = t1.nat LEFT JOIN t2 ON q.nat = t2.nat AND q.seg = t2.seg LEFT JOIN t3 ON q.ref = t3.ref LEFT JOIN m4 ON m4.o_orderkey = q.o_orderkey""")
def q_tiered_keys(t: Tables) -> DataFrame:
    """Four ordered tiers, each a join on keys that lead to exactly one entity; the last by a term's interval."""
    seg = F.when(F.col("o_orderkey") % 4 == 0, "AUTOMOBILE").when(F.col("o_orderkey") % 4 == 1, "BUILDING").otherwise("NONE")
    asked = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 2000).alias("ref"), (F.col("o_custkey") % 25).cast("int").alias("nat"), seg.alias("seg"), F.col("o_orderdate").alias("d")
    )
    one = t.customer.select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("nat"), F.col("c_custkey").alias("id1"))
    two = R.unique_by(t.customer.select(F.col("c_nationkey").alias("nat"), F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("id2")), ["nat", "seg"], "id2")
    three = R.unique_by(t.supplier.select(F.col("s_suppkey").alias("ref"), F.col("s_suppkey").alias("id3")), ["ref"], "id3")
    start = F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("n_nationkey") * 60)
    terms = t.nation.select(F.col("n_nationkey").alias("nat"), start.alias("a"), (start + F.make_dt_interval(F.lit(400))).alias("b"), F.col("n_nationkey").cast("long").alias("id4"))
    within = asked.join(terms, "nat").where("d between a and b").select("o_orderkey", "id4")
    four = R.unique_by(within, ["o_orderkey"], "id4")
    rows = asked.join(one, ["ref", "nat"], "left").join(two, ["nat", "seg"], "left").join(three, "ref", "left").join(four, "o_orderkey", "left")
    ids = ["id1", "id2", "id3", "id4"]
    tier = F.coalesce(*[F.when(F.col(x).isNotNull(), k + 1) for k, x in enumerate(ids)])
    return rows.select("o_orderkey", F.coalesce(*ids).alias("id"), tier.alias("tier"))


def _members(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers as the current roster, parts as former members with three terms each."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Name"), (k % 400).cast("string"))
    roster = t.customer.select(
        F.concat(F.lit("B"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "senate").otherwise("house").alias("chamber"),
        F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("state"), F.when(k % 5 == 0, F.concat(F.lit("De "), name)).otherwise(name).alias("last"),
        F.concat(F.lit("F"), (k % 7).cast("string")).alias("first"), F.when(k % 4 > 0, F.concat(F.lit("N"), (k % 3).cast("string"))).alias("nickname"),
        F.substring("c_mktsegment", 1, 1).alias("party"), k.alias("seq"),
    )
    p = F.col("p_partkey")
    former = t.part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    day = lambda extra: F.date_format(F.date_add(F.lit("1993-01-01").cast("date"), (F.col("p_size") * 40 + F.col("n") * 900 + extra).cast("int")), "yyyy-MM-dd")
    terms = former.select(
        F.concat(F.lit("H"), p.cast("string")).alias("id"), F.concat(F.lit("NAME"), (p % 450).cast("string")).alias("last"),
        F.when((p + F.col("n")) % 3 == 0, "house").otherwise("senate").alias("chamber"), F.concat(F.lit("S"), ((F.col("p_size") + F.col("n")) % 25).cast("string")).alias("state"),
        day(0).alias("start"), day(700).alias("end"), F.when(p % 2 == 0, "R").alias("party"), F.col("n").alias("seq"),
    )
    return roster, terms


@query(r"""WITH roster AS (SELECT 'B' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'senate' ELSE 'house' END AS chamber, 'S' || c_nationkey AS state,
  CASE WHEN c_custkey % 5 = 0 THEN 'de ' ELSE '' END || 'name' || (c_custkey % 400) AS last, 'f' || (c_custkey % 7) AS first,
  CASE WHEN c_custkey % 4 > 0 THEN 'n' || (c_custkey % 3) ELSE '' END AS nickname, c_mktsegment[1] AS party, c_custkey AS seq FROM customer),
terms AS (SELECT 'H' || p_partkey AS id, 'name' || (p_partkey % 450) AS last, CASE WHEN (p_partkey + n) % 3 = 0 THEN 'house' ELSE 'senate' END AS chamber,
  'S' || ((p_size + n) % 25) AS state, CAST(DATE '1993-01-01' + CAST(p_size * 40 + n * 900 AS INTEGER) AS VARCHAR) AS a, CAST(DATE '1993-01-01' + CAST(p_size * 40 + n * 900 + 700 AS INTEGER) AS VARCHAR) AS b,
  CASE WHEN p_partkey % 2 = 0 THEN 'R' ELSE '' END AS party, n FROM part, range(3) r(n)),
rows AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'GIVEN' ELSE '' END AS given_id, CASE WHEN o_orderkey % 2 = 0 THEN 'senate' ELSE 'house' END AS chamber,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 's' || (o_custkey % 25) END AS state, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'NAME' || (o_custkey % 470) || CASE WHEN o_orderkey % 7 = 0 THEN ', Jr.' ELSE '' END END AS last,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'N' || (o_orderkey % 3) ELSE ' F' || (o_orderkey % 7) || ' Q.' END AS first,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN '1996-06-01' ELSE '' END AS d, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE '' END AS party FROM orders),
q AS (SELECT *, upper(state) AS st, trim(regexp_replace(lower(last), ',\s*(jr|sr|ii|iii|iv|v)\.?\s*$', '')) AS l, split_part(trim(lower(first)), ' ', 1) AS g FROM rows),
t1 AS (SELECT chamber, state, last, max_by(id, seq) AS id FROM roster GROUP BY ALL),
t2 AS (SELECT last, min(id) AS id FROM roster WHERE chamber = 'senate' GROUP BY last HAVING count(*) = 1),
t2n AS (SELECT o_orderkey, min(r.id) AS id FROM q JOIN roster r ON q.chamber = 'senate' AND r.chamber = 'senate' AND r.last = q.l AND q.g <> '' AND (r.first = q.g OR r.nickname = q.g) GROUP BY 1 HAVING count(*) = 1),
t3 AS (SELECT o_orderkey, min(r.id) AS id FROM q JOIN roster r ON r.chamber = q.chamber AND split_part(r.last, ' ', -1) = q.l AND r.last <> q.l AND (q.st = '' OR q.st = r.state) WHERE q.l <> '' GROUP BY 1 HAVING count(*) = 1),
t4 AS (SELECT o_orderkey, min(id) AS id FROM (SELECT DISTINCT o_orderkey, x.id, x.state FROM q JOIN terms x ON x.chamber = q.chamber AND x.last = q.l AND x.a <= q.d AND q.d <= x.b
  AND (x.state = q.st OR (q.st = '' AND q.chamber = 'senate')) WHERE q.l <> '' AND q.d <> '') GROUP BY 1 HAVING count(*) = 1),
found AS (SELECT q.*, CASE WHEN q.st <> '' AND q.l <> '' THEN t1.id END AS i1, CASE WHEN q.chamber = 'senate' AND q.l <> '' THEN coalesce(t2.id, t2n.id) END AS i2, t3.id AS i3, t4.id AS i4
  FROM q LEFT JOIN t1 ON t1.chamber = q.chamber AND t1.state = q.st AND t1.last = q.l LEFT JOIN t2 ON t2.last = q.l LEFT JOIN t2n USING (o_orderkey) LEFT JOIN t3 USING (o_orderkey) LEFT JOIN t4 USING (o_orderkey)),
picked AS (SELECT *, coalesce(i1, i2, i3, i4) AS hit, CASE WHEN i1 IS NOT NULL THEN 1 WHEN i2 IS NOT NULL THEN 2 WHEN i3 IS NOT NULL THEN 3 WHEN i4 IS NOT NULL THEN 4 END AS tr FROM found),
facts AS (SELECT id, max_by(party, seq) AS party, max_by(state, seq) AS state FROM roster GROUP BY id UNION ALL SELECT id, min_by(party, n), min_by(state, n) FROM terms GROUP BY id)
SELECT o_orderkey, CASE WHEN given_id <> '' THEN given_id ELSE coalesce(hit, '') END AS id, CASE WHEN given_id = '' THEN tr END AS tier,
  CASE WHEN given_id = '' AND hit IS NOT NULL AND p.party = '' THEN coalesce(f.party, '') ELSE p.party END AS party,
  CASE WHEN given_id = '' AND hit IS NOT NULL AND p.state = '' THEN coalesce(f.state, '') ELSE p.state END AS state
FROM picked p LEFT JOIN facts f ON f.id = p.hit""")
def q_tiered_resolution(t: Tables) -> DataFrame:
    """Orders that name a member, led to current and former members through four tiers; see :mod:`..operators.entities`."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    last = F.concat(F.lit("NAME"), (c % 470).cast("string"), F.when(k % 7 == 0, ", Jr.").otherwise(""))
    first = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("N"), (k % 3).cast("string"))).otherwise(F.concat(F.lit(" F"), (k % 7).cast("string"), F.lit(" Q.")))
    rows = t.orders.select(
        "o_orderkey", F.when(k % 13 == 0, "GIVEN").otherwise("").alias("id"), F.when(k % 2 == 0, "senate").otherwise("house").alias("chamber"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("s"), (c % 25).cast("string"))).alias("state"), F.when(k % 17 == 0, "").otherwise(last).alias("last"), first.alias("first"),
        F.when(k % 11 > 0, iso(F.col("o_orderdate"))).alias("date"), F.when(k % 2 == 0, "1996-06-01").alias("disclosed"), F.when(k % 4 == 0, "X").otherwise("").alias("party"),
    )
    return E.resolve(rows, *_members(t)).select("o_orderkey", "id", F.col("tier").cast("int").alias("tier"), "party", "state")


@query("""WITH p AS (SELECT s_suppkey, nullif(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END, '') AS a, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce(a, CASE WHEN s_suppkey % 3 = 0 THEN n_name END, 'unknown') AS ticker FROM p""")
def q_coalesce_chain(t: Tables) -> DataFrame:
    """First map that knows the key, else the next one, else a default."""
    first = t.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_name").alias("a"))
    second = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("b"))
    rows = t.supplier.join(first, "s_suppkey", "left").join(second, "s_nationkey", "left")
    return rows.select("s_suppkey", F.coalesce("a", F.when(F.col("s_suppkey") % 3 == 0, F.col("b")), F.lit("unknown")).alias("ticker"))


@query("""SELECT o_orderkey, CASE s_suppkey % 8 WHEN 0 THEN 'C' || s_suppkey WHEN 1 THEN 'N' || s_suppkey WHEN 2 THEN 'S' || s_suppkey WHEN 4 THEN 'N' || s_suppkey WHEN 5 THEN 'C' || s_suppkey WHEN 6 THEN 'N' || s_suppkey ELSE '' END AS ticker,
CASE s_suppkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 2 END AS step FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier)""")
def q_fallback_chain(t: Tables) -> DataFrame:
    """Holdings' tickers by instrument, by name and by search, each held against the issuer's name; see :mod:`..operators.identifiers`."""
    k, key = F.col("s_suppkey") % 8, F.col("s_suppkey").cast("string")
    letters = F.translate(key, "0123456789", "BCDFGHJKLM")  # a word of each supplier's own
    name, other = F.concat(F.lit("Firm"), letters, F.lit(" Intl Mfg")), F.concat(F.lit("Rival"), letters, F.lit(" Corp"))
    n = t.supplier.agg(F.count("*").alias("n"))  # one row
    asked = t.orders.withColumn("one", F.lit(1)).join(F.broadcast(n.withColumn("one", F.lit(1))), "one").select("o_orderkey", (F.col("o_custkey") % F.col("n")).alias("s_suppkey"))
    holdings = asked.join(t.supplier, "s_suppkey").select("o_orderkey", F.concat(F.lit("I"), key).alias("instrument"), F.when(k != 5, F.concat(name, F.lit(" Inc."))).alias("issuer"))
    mapped = F.when(k.isin(0, 5), F.concat(F.lit("The Firm"), letters, F.lit(" International Manufacturing Ltd"))).otherwise(other)
    instruments = t.supplier.where(~k.isin(4, 7)).select(F.concat(F.lit("I"), key).alias("instrument"), F.when(k != 6, F.concat(F.lit("C"), key)).otherwise(" ").alias("ticker"), mapped.alias("name"))
    listed = t.supplier.where(k.isin(1, 4, 6)).select(F.concat(F.upper(name), F.lit(", INC")).alias("name"), F.explode(F.array(F.concat(F.lit("N"), key, F.lit(".WS")), F.concat(F.lit("N"), key))).alias("ticker"))
    issuer = F.concat(name, F.lit(" Inc."))
    searched = t.supplier.where(k.isin(2, 3)).select(issuer.alias("asked"), F.concat(F.lit("S"), key).alias("ticker"), F.when(k == 2, F.concat(name, F.lit(" Holdings PLC"))).otherwise(other).alias("name"))
    return identifiers.validated(holdings, instruments, listed, searched).select("o_orderkey", "ticker", "step")


@query("""WITH c AS (SELECT c_mktsegment AS name, 'T' || c_custkey AS ticker FROM customer),
b AS (SELECT name, ticker, row_number() OVER (PARTITION BY name ORDER BY length(ticker), ticker) AS rn FROM c)
SELECT name, ticker FROM b WHERE rn = 1""")
def q_name_resolution(t: Tables) -> DataFrame:
    """A normalised name leads to its shortest identifier."""
    names = t.customer.select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"))
    keyed = R.rank_one(names.withColumn("key", T.normalize_name(F.col("name"))), ["key"], [F.length("ticker"), F.asc("ticker")]).select("key", "ticker")
    asked = names.select(F.concat(F.lower("name"), F.lit(", Inc.")).alias("asked"), "name").distinct()
    return asked.withColumn("key", T.normalize_name(F.col("asked"))).join(keyed, "key").select("name", "ticker")


@query("""WITH s AS (SELECT p_brand, p_partkey, p_type, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN contains(p_type, 'SMALL') THEN 0 ELSE 1 END, CASE WHEN p_size < 25 THEN 0 ELSE 1 END, length(p_name), p_partkey) AS rn
FROM part WHERE p_size > 5) SELECT p_brand, p_partkey FROM s WHERE rn = 1""")
def q_best_match(t: Tables) -> DataFrame:
    """Of the candidates that qualify the best by preferences, then the shortest name."""
    order = [
        F.when(F.col("p_type").contains("SMALL"), 0).otherwise(1), F.when(F.col("p_size") < 25, 0).otherwise(1), F.length("p_name"), F.asc("p_partkey")
    ]
    return R.rank_one(t.part.where("p_size > 5"), ["p_brand"], order).select("p_brand", "p_partkey")


@query("""SELECT s_suppkey, s_suppkey % 5 NOT IN (2, 4) AS matches FROM supplier""")
def q_names_match(t: Tables) -> DataFrame:
    """Variants of a name match, another name does not."""
    k, name = F.col("s_suppkey") % 5, F.regexp_replace("s_name", "[#0-9]+", " Alpha ")
    other = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" Corp."))).when(k == 1, F.concat(name, F.lit(" Gamma")))
    other = other.when(k == 3, F.concat(name, F.lit(" International Corp"))).when(k == 4, "Supplier Omega").otherwise("Omega Delta")
    name = F.when(k == 3, F.concat(name, F.lit(" Intl Ltd"))).otherwise(name)
    return t.supplier.select("s_suppkey", T.names_match(name, other).alias("matches"))


@query("""WITH w AS (SELECT user_id, min(ts) + INTERVAL 1 DAY AS a, min(ts) + INTERVAL 5 DAY AS b FROM events GROUP BY user_id)
SELECT e.user_id, count(*) AS n FROM events e JOIN w ON e.user_id = w.user_id AND e.ts BETWEEN w.a AND w.b GROUP BY e.user_id""")
def q_interval_join(t: Tables) -> DataFrame:
    first = F.min("ts")
    windows = t.events.groupBy("user_id").agg((first + F.expr("interval 1 day")).alias("a"), (first + F.expr("interval 5 day")).alias("b"))
    return t.events.join(windows, "user_id").where("ts between a and b").groupBy("user_id").agg(F.count("*").alias("n"))


HELD = """h AS (SELECT l_suppkey, p_brand, date_trunc('quarter', l_shipdate) AS q, sum(l_quantity) AS shares FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""


def _held(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("l_suppkey", "p_brand", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(F.sum("l_quantity").alias("shares"))


@query(f"""WITH {HELD}, n AS (SELECT * FROM h WHERE q = DATE '1998-04-01'), b AS (SELECT * FROM h WHERE q = DATE '1998-01-01'),
j AS (SELECT coalesce(n.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(n.p_brand, b.p_brand) AS p_brand, n.shares AS now, b.shares AS before FROM n FULL JOIN b ON n.l_suppkey = b.l_suppkey AND n.p_brand = b.p_brand)
SELECT l_suppkey, p_brand, now, before, CASE WHEN now IS NULL THEN -before WHEN coalesce(before, 0) = 0 THEN now ELSE now - before END AS change,
CASE WHEN now IS NULL THEN 'closed' WHEN coalesce(before, 0) = 0 THEN 'new' WHEN now > before THEN 'increased' WHEN now < before THEN 'decreased' ELSE 'unchanged' END AS position_change,
CASE WHEN now IS NULL THEN -100.0::DOUBLE WHEN coalesce(before, 0) > 0 THEN floor((now - before) / before * 10000 + 0.5) / 100 END AS pct FROM j""")
def q_position_change(t: Tables) -> DataFrame:
    """Full outer comparison of one quarter with the one before, with closed positions."""
    held = _held(t)
    now, before = (held.where(F.col("q") == F.lit(day).cast("date")).drop("q") for day in ("1998-04-01", "1998-01-01"))
    compared = R.full_compare(now, before, ["l_suppkey", "p_brand"], "shares")
    pct = F.floor((F.col("now") - F.col("before")) / F.col("before") * 10000 + 0.5) / 100
    return compared.withColumn("pct", F.when(F.col("now").isNull(), -100.0).when(F.coalesce("before", F.lit(0.0)) > 0, pct))


@query(f"""WITH {HELD}, n AS (SELECT *, l_suppkey % 7 <> 0 AS whole FROM h WHERE q = DATE '1998-04-01'), b AS (SELECT * FROM h WHERE q = DATE '1998-01-01' AND l_suppkey % 5 <> 0),
s AS (SELECT l_suppkey, bool_and(whole) AND l_suppkey IN (SELECT l_suppkey FROM b) AS sure FROM n GROUP BY l_suppkey),
j AS (SELECT coalesce(n.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(n.p_brand, b.p_brand) AS p_brand, n.shares AS held, coalesce(n.shares, 0) AS now, coalesce(b.shares, 0) AS before
FROM n FULL JOIN b ON n.l_suppkey = b.l_suppkey AND n.p_brand = b.p_brand)
SELECT l_suppkey, p_brand, now, CASE WHEN sure THEN now - before END AS change, CASE WHEN sure AND before > 0 THEN floor((now - before) / before * 10000 + 0.5) / 100 END AS pct,
CASE WHEN NOT sure THEN 'INSUFFICIENT_DATA' WHEN held IS NULL THEN 'closed' WHEN before = 0 THEN 'new' WHEN now > before THEN 'increased' WHEN now < before THEN 'decreased' ELSE 'unchanged' END AS position_change
FROM j JOIN s USING (l_suppkey) WHERE held IS NOT NULL OR (sure AND before <> 0)""")
def q_position_states(t: Tables) -> DataFrame:
    """Position changes where some suppliers' quarters are incomplete and others have no quarter before."""
    held = _held(t)
    now, before = (held.where(F.col("q") == F.lit(day).cast("date")).drop("q") for day in ("1998-04-01", "1998-01-01"))
    whole = now.withColumn("whole", F.col("l_suppkey") % 7 != 0)
    return R.position_changes(whole, before.where("l_suppkey % 5 <> 0"), "l_suppkey", "p_brand", "shares", "whole")


@query("""WITH c AS (SELECT p_brand, p_type, p_size % 2 = 0 AS known, CASE p_partkey % 5 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 'P' WHEN 2 THEN 'A' || p_partkey || 'usd' WHEN 3 THEN 'X 09/16' ELSE 'k' END AS ticker,
CASE p_size % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'UW' ELSE 'LN' END AS exchange FROM part),
s AS (SELECT p_brand, ticker, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN contains(lower(p_type), 'steel') THEN 0 ELSE 1 END, CASE WHEN known THEN 0 ELSE 1 END, length(ticker), ticker) AS rn
FROM c WHERE exchange <> 'LN' AND ticker NOT IN ('P', 'X 09/16') AND NOT contains(ticker, 'usd')) SELECT p_brand, ticker FROM s WHERE rn = 1""")
def q_identifier_choice(t: Tables) -> DataFrame:
    """Of a key's candidates those on US exchanges with a plausible ticker, common stock and known ones first, then the shortest."""
    k, number = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    ticker = F.when(k == 0, F.concat(F.lit("T"), number)).when(k == 1, "P").when(k == 2, F.concat(F.lit("A"), number, F.lit("usd"))).when(k == 3, "X 09/16").otherwise("k")
    exchange = F.when(F.col("p_size") % 3 == 0, "us").when(F.col("p_size") % 3 == 1, "UW").otherwise("LN")
    rows = t.part.select("p_brand", F.lower("p_type").contains("steel").alias("common"), (F.col("p_size") % 2 == 0).alias("known"), ticker.alias("ticker"), exchange.alias("exchange"))
    good = rows.where(F.upper("exchange").isin(C.US_EXCHANGES) & ~C.bad_ticker(F.col("ticker")))
    return R.rank_one(good, ["p_brand"], [F.desc("common"), F.desc("known"), F.length("ticker"), F.asc("ticker")]).select("p_brand", "ticker")


@query(f"""WITH {HELD}, s AS (SELECT l_suppkey, q, sum(shares) AS shares FROM h GROUP BY 1, 2)
SELECT a.l_suppkey, strftime(a.q, '%Y-%m-%d') AS quarter, a.shares, b.shares AS prior_shares FROM s a LEFT JOIN s b ON a.l_suppkey = b.l_suppkey AND b.q = a.q - INTERVAL 3 MONTH""")
def q_prior_period(t: Tables) -> DataFrame:
    """The value of the calendar quarter before, which may be missing; a join on the computed key, not a lag."""
    sums = t.lineitem.groupBy("l_suppkey", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(F.sum("l_quantity").alias("shares"))
    prior = sums.select("l_suppkey", F.add_months("q", 3).alias("q"), F.col("shares").alias("prior_shares"))
    return sums.join(prior, ["l_suppkey", "q"], "left").select("l_suppkey", iso(F.col("q")).alias("quarter"), "shares", "prior_shares")


def _keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("k"))


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0)")
def q_missing(t: Tables) -> DataFrame:
    return R.missing(*_keys(t), "k")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def q_extra(t: Tables) -> DataFrame:
    return R.missing(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT count(DISTINCT c_custkey) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0)")
def q_present(t: Tables) -> DataFrame:
    source, held = _keys(t)
    return source.distinct().join(held, "k", "left_semi").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AND o_orderstatus <> 'F')
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS backlog FROM b ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def q_backlog(t: Tables) -> DataFrame:
    """What is not loaded and has no terminal marker, oldest first, capped, with the total."""
    loaded = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("unit"), F.lit("completed").alias("state")).distinct()
    final = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit"), F.lit("terminal").alias("state"))
    states = R.rank_one(loaded.unionByName(final), ["unit"], [F.asc("state")]).withColumn("attempts", F.lit(1))
    rows = manifest.backlog(t.orders, states, [F.asc("o_orderdate"), F.asc("o_orderkey")], 100, "o_orderkey")
    return rows.select("o_orderkey", "rn", "backlog")


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'failed' WHEN 3 THEN 'not_published' WHEN 4 THEN 'terminal' END AS state, o_orderkey % 4 AS attempts FROM orders)
SELECT strftime(o_orderdate, '%Y') || 'q' || quarter(o_orderdate) AS quarter, coalesce(state, 'untried') AS state, count(*) AS n, sum(CASE WHEN state IS NULL THEN 0 ELSE attempts END)::BIGINT AS attempts
FROM orders JOIN s USING (o_orderkey) WHERE state IS NULL OR state NOT IN ('completed', 'terminal') GROUP BY ALL""")
def q_due_units(t: Tables) -> DataFrame:
    """Units of every quarter that a resumed run has to load, by state, from a manifest kept in a keyed store."""
    k = F.col("o_orderkey")
    state = F.when(k % 7 == 0, "completed").when(k % 7 == 1, "in_progress").when(k % 7 == 2, "failed").when(k % 7 == 3, "not_published").when(k % 7 == 4, "terminal")
    held = t.orders.select(k.cast("string").alias("unit"), state.alias("state"), (k % 4).cast("int").alias("attempts")).where("state is not null")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("rows", "bigint"), ("error", "string"), ("started_at", "string"), ("ended_at", "string"))]
    kept = manifest.Manifest(t.spark, fresh_folder(t.spark, "manifest"))
    kept.store.upsert(held.select("unit", "state", "attempts", *none, F.lit(1).cast("bigint").alias("seq")))
    quarter = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    rows = manifest.due(t.orders.select(k.cast("string").alias("unit"), quarter.alias("quarter")), kept.states())
    return rows.groupBy("quarter", F.coalesce("state", F.lit("untried")).alias("state")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 10 < 7), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 10 > 2)
SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def q_set_diff_report(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderkey % 10 < 7").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("a")).distinct()
    b = t.lineitem.where("l_orderkey % 10 > 2").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("b")).distinct()
    side = F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both")
    return a.join(b, "k", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0")
def q_except(t: Tables) -> DataFrame:
    source, held = _keys(t)
    return source.subtract(held)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0")
def q_intersect(t: Tables) -> DataFrame:
    source, held = _keys(t)
    return source.intersect(held)


@query("""SELECT 'trade' AS part, o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_custkey < 40 UNION ALL
SELECT 'baseline', c_custkey, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey < 40)""")
def q_baseline(t: Tables) -> DataFrame:
    """Rows with the matching baselines beside them, tagged."""
    trades = t.orders.where("o_custkey < 40").select(F.lit("trade").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    owners = trades.select(F.col("owner").alias("c_custkey"))
    base = t.customer.join(owners, "c_custkey", "left_semi").select(F.lit("baseline").alias("part"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("owner"))
    return trades.unionByName(base)


def sources(t: Tables) -> list[fanout.Source]:
    """Five tables that answer for a customer, a nation, or a part."""

    def by(column: str, name: str):
        return lambda ids: F.col(column) == ids[name] if name in ids else None

    one = lambda name, table, bind, order, key: fanout.Source(name, lambda: getattr(t, table), bind, order, F.to_json(F.struct("*")), F.col(key))
    return [
        one("orders", "orders", by("o_custkey", "customer"), (F.desc("o_orderdate"), F.asc("o_orderkey")), "o_orderkey"),
        one("customers", "customer", by("c_nationkey", "nation"), (F.desc("c_acctbal"), F.asc("c_custkey")), "c_custkey"),
        one("suppliers", "supplier", by("s_nationkey", "nation"), (F.desc("s_acctbal"), F.asc("s_suppkey")), "s_suppkey"),
        one("events", "events", by("user_id", "customer"), (F.desc("ts"), F.asc("event_id")), "event_id"),
        one("parts", "part", by("p_size", "size"), (F.desc("p_retailprice"), F.asc("p_partkey")), "p_partkey"),
    ]


IDENTIFIERS = {"customer": 37, "nation": 7}
FANOUT_SQL = """f AS (
SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS key, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_custkey = 37 UNION ALL
SELECT 'customers', CAST(c_custkey AS VARCHAR), row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) FROM customer WHERE c_nationkey = 7 UNION ALL
SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) FROM supplier WHERE s_nationkey = 7 UNION ALL
SELECT 'events', CAST(event_id AS VARCHAR), row_number() OVER (ORDER BY ts DESC, event_id) FROM events WHERE user_id = 37)"""


@query(f"WITH {FANOUT_SQL} SELECT source, rank, key FROM f WHERE rank <= 6")
def q_fanout(t: Tables) -> DataFrame:
    return fanout.fan_out(sources(t), IDENTIFIERS, 5).select("source", "rank", "key")


@query(f"""WITH {FANOUT_SQL} SELECT source, count(*) FILTER (WHERE rank <= 5) AS n, max(rank) > 5 AS has_more,
array_to_string(list_sort(list(key) FILTER (WHERE rank <= 5)), ',') AS keys FROM f WHERE rank <= 6 GROUP BY source""")
def q_fanout_summary(t: Tables) -> DataFrame:
    return fanout.summary(fanout.fan_out(sources(t), IDENTIFIERS, 5), 5)


@query("""WITH src AS (
  SELECT 'filings' AS collection, CAST(o_orderkey AS VARCHAR) AS key, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%Y-%m-%d') AS seq FROM orders
  UNION ALL SELECT 'filings', CAST(o_orderkey AS VARCHAR), CAST(year(o_orderdate) + 1 AS VARCHAR), strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-%d') FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'owners', CAST(c_custkey AS VARCHAR), '-', lpad(CAST(c_custkey AS VARCHAR), 12, '0') FROM customer
  UNION ALL SELECT 'items', CAST(p_partkey AS VARCHAR), CAST(1990 + p_size AS VARCHAR), lpad(CAST(p_partkey AS VARCHAR), 12, '0') FROM part),
held AS (SELECT 'filings' AS collection, CAST(l_orderkey AS VARCHAR) AS key, l_returnflag AS kind FROM lineitem
  UNION ALL SELECT 'owners', CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END FROM orders
  UNION ALL SELECT 'items', CAST(p_partkey + 7 AS VARCHAR), p_type FROM part),
s AS (SELECT collection, key, min_by(year, seq || year) AS year, min(seq) AS seq FROM src GROUP BY ALL),
h AS (SELECT DISTINCT collection, key FROM held),
k AS (SELECT coalesce(s.collection, h.collection) AS collection, coalesce(s.key, h.key) AS key, year, seq, CASE WHEN s.key IS NULL THEN 'extra' WHEN h.key IS NULL THEN 'missing' ELSE 'present' END AS state
  FROM s FULL JOIN h ON s.collection = h.collection AND s.key = h.key),
t AS (SELECT collection, count(*) FILTER (WHERE state <> 'extra') AS source, count(*) FILTER (WHERE state = 'present') AS present, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'extra') AS extra FROM k GROUP BY 1),
m AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY seq, key) AS rn FROM k WHERE state = 'missing' AND collection <> 'owners'),
cl AS (SELECT collection, CASE WHEN rn > 500 THEN 'unclassified' WHEN CAST(key AS BIGINT) % 5 = 0 THEN 'recoverable' WHEN CAST(key AS BIGINT) % 5 = 1 THEN 'nil' WHEN CAST(key AS BIGINT) % 5 = 2 THEN 'gone' ELSE 'unclassified' END AS class FROM m),
cc AS (SELECT a.collection, b.class, count(cl.class) AS n FROM (VALUES ('filings'), ('items')) a(collection) CROSS JOIN (VALUES ('recoverable'), ('nil'), ('unreadable'), ('gone'), ('unclassified')) b(class)
  LEFT JOIN cl ON cl.collection = a.collection AND cl.class = b.class GROUP BY ALL),
x(collection, kind) AS (VALUES ('filings', 'A'), ('filings', 'Z'), ('owners', 'F')),
kinds AS (SELECT collection, coalesce(nullif(kind, ''), '(none)') AS kind, count(*) AS n FROM held GROUP BY ALL)
SELECT collection, 'total' AS part, 'source' AS name, source AS n, present * 100.0::DOUBLE / source AS share FROM t UNION ALL SELECT collection, 'total', 'present', present, NULL FROM t
UNION ALL SELECT collection, 'total', 'missing', missing, NULL FROM t UNION ALL SELECT collection, 'total', 'extra', extra, NULL FROM t
UNION ALL SELECT collection, 'source', year, count(*), count(*) FILTER (WHERE state = 'present') * 100.0::DOUBLE / count(*) FROM k WHERE state <> 'extra' GROUP BY ALL
UNION ALL SELECT collection, 'missing', year, count(*), NULL FROM k WHERE state = 'missing' GROUP BY ALL
UNION ALL SELECT coalesce(x.collection, kinds.collection), 'kind', coalesce(x.kind, kinds.kind), coalesce(n, 0), NULL FROM x FULL JOIN kinds ON x.collection = kinds.collection AND x.kind = kinds.kind
UNION ALL SELECT collection, 'class', class, n, NULL FROM cc
UNION ALL SELECT cc.collection, 'unexplained', 'unexplained', sum(n), NULL FROM cc JOIN t USING (collection) WHERE t.missing <= 500 AND class IN ('recoverable', 'unclassified') GROUP BY ALL""")
def q_reconcile_all(t: Tables) -> DataFrame:
    """Three collections against their sources in one plan, with tallies by year, kind and class."""
    day, filed = iso(F.col("o_orderdate")), F.year("o_orderdate")
    twice = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("key"), (filed + 1).alias("year"), iso(F.add_months("o_orderdate", 12)).alias("seq"))
    padded = lambda name: F.lpad(F.col(name).cast("string"), 12, "0").alias("seq")
    k = F.col("key").cast("long")
    kind = F.when(k % 5 == 0, "recoverable").when(k % 5 == 1, "nil").when(k % 5 == 2, "gone").when(k % 5 == 3, "what?")
    return reconcile.reconcile_all(
        [
            reconcile.Adapter("filings", t.orders.select(F.col("o_orderkey").alias("key"), filed.alias("year"), day.alias("seq")).unionByName(twice), t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("kind")), ("A", "Z"), lambda: kind),
            reconcile.Adapter("owners", t.customer.select(F.col("c_custkey").alias("key"), F.lit(None).alias("year"), padded("c_custkey")), t.orders.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("kind")), ("F",)),
            reconcile.Adapter("items", t.part.select(F.col("p_partkey").alias("key"), (1990 + F.col("p_size")).alias("year"), padded("p_partkey")), t.part.select((F.col("p_partkey") + 7).alias("key"), F.col("p_type").alias("kind")), (), lambda: kind),
        ],
        first=500,
    )
