"""Derived columns: classification, dates, numbers and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates as D
from ..functions import filings as L
from ..functions import numbers as N
from ..functions import text as T
from .base import Tables, query
from .filters import CODES_SQL, NATURE_SQL, with_code


@query(f"WITH {CODES_SQL}, n AS (SELECT {NATURE_SQL} AS nature FROM codes) SELECT nature, count(*) AS n FROM n GROUP BY nature")
def q_nature(t: Tables) -> DataFrame:
    return with_code(t).select(C.nature(F.col("code")).alias("nature")).groupBy("nature").agg(F.count("*").alias("n"))


@query(r"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'charitable gift' WHEN 1 THEN 'Donated shares' WHEN 2 THEN 'gifted horse' WHEN 3 THEN 'giftware' END AS c,
CASE o_orderkey % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'exchange' ELSE 'other' END AS k FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(regexp_matches(c, '(?i)\b(contribution|contributed|gift(?:ed|ing|s)?|donat\w*|charitab\w*)\b'), false) THEN 'NON_OPEN_MARKET_TRANSFER'
WHEN k IN ('buy', 'sell') THEN 'OPEN_MARKET' WHEN k = 'exchange' THEN 'NON_OPEN_MARKET_TRANSFER' ELSE 'INSUFFICIENT_DATA' END AS nature FROM d""")
def q_comment_nature(t: Tables) -> DataFrame:
    k, j = F.col("o_orderkey") % 5, F.col("o_orderkey") % 4
    comment = F.when(k == 0, "charitable gift").when(k == 1, "Donated shares").when(k == 2, "gifted horse").when(k == 3, "giftware")
    kind = F.when(j == 0, "buy").when(j == 1, "sell").when(j == 2, "exchange").otherwise("other")
    return t.orders.select("o_orderkey", C.comment_nature(comment, kind).alias("nature"))


@query(f"""WITH {CODES_SQL} SELECT CASE WHEN code = 'P' THEN 'buy' WHEN code = 'S' THEN 'sell' WHEN l_returnflag = 'A' THEN 'buy' WHEN l_returnflag = 'D' THEN 'sell'
WHEN code IN ('A', 'M', 'X', 'C', 'I') THEN 'buy' ELSE 'sell' END AS direction, count(*) AS n FROM codes GROUP BY 1""")
def q_direction(t: Tables) -> DataFrame:
    return with_code(t).groupBy(C.direction(F.col("code"), F.col("l_returnflag")).alias("direction")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'FORM4' WHEN 1 THEN 'FORM4' WHEN 2 THEN 'FORM5' ELSE CAST(p_size % 5 AS VARCHAR) || '/X' END AS form FROM part""")
def q_code_map(t: Tables) -> DataFrame:
    k = F.col("p_size") % 5
    code = F.when(k == 0, "4").when(k == 1, "4/A").when(k == 2, "5").otherwise(F.concat(k.cast("string"), F.lit("/X")))
    return t.part.select("p_partkey", C.code_map(code, {"4": "FORM4", "4/A": "FORM4", "5": "FORM5", "5/A": "FORM5"}).alias("form"))


@query("SELECT CASE WHEN year(o_orderdate) >= 1998 THEN '1998_plus' ELSE 'pre_1998' END AS era, count(*) AS n FROM orders GROUP BY 1")
def q_era_tag(t: Tables) -> DataFrame:
    era = F.when(F.year("o_orderdate") >= 1998, "1998_plus").otherwise("pre_1998")
    return t.orders.groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS covered_year FROM orders")
def q_year_guess(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", year).otherwise(year - 1).cast("long").alias("covered_year"))


def _shipped(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    return t.orders.select("o_orderkey", "o_orderdate").join(first, "o_orderkey")


SHIPPED = """s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(min(l_shipdate) AS DATE) AS b
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)"""


@query(f"WITH {SHIPPED} SELECT o_orderkey, date_diff('day', a, b) AS lag_days FROM s")
def q_lag_days(t: Tables) -> DataFrame:
    return _shipped(t).select("o_orderkey", F.datediff("shipped", "o_orderdate").cast("long").alias("lag_days"))


@query(f"""WITH {SHIPPED} SELECT o_orderkey, (SELECT count(*) FROM range(0, abs(date_diff('day', a, b))) r(i)
WHERE isodow(least(a, b) + CAST(i AS INTEGER)) < 6) AS business_days FROM s""")
def q_business_days(t: Tables) -> DataFrame:
    return _shipped(t).select("o_orderkey", D.business_days(F.to_date("o_orderdate"), F.to_date("shipped")).cast("long").alias("business_days"))


@query(f"""WITH {SHIPPED}, d AS (SELECT date_diff('day', a, b) AS n FROM s)
SELECT CASE WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 175 AND 195 THEN 'H' WHEN n BETWEEN 265 AND 285 THEN '9M' WHEN n BETWEEN 355 AND 380 THEN 'FY' ELSE 'other' END AS span,
count(*) AS n FROM d GROUP BY 1""")
def q_span_bucket(t: Tables) -> DataFrame:
    return _shipped(t).groupBy(D.span_kind(F.col("o_orderdate"), F.col("shipped")).alias("span")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size * 10.0::DOUBLE END) AS total FROM part""")
def q_value_fallback(t: Tables) -> DataFrame:
    stored = F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice"))
    product = F.when(F.col("p_partkey") % 2 != 0, F.col("p_size")) * F.lit(10.0)
    return t.part.select("p_partkey", F.coalesce(stored, product).alias("total"))


@query("""SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS net FROM lineitem GROUP BY l_suppkey""")
def q_net_columns(t: Tables) -> DataFrame:
    side = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    return t.lineitem.groupBy("l_suppkey").agg((side("A") - side("R")).alias("net"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END * p_retailprice, 0) AS fail_value FROM part""")
def q_product_column(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")) * F.col("p_retailprice"), F.lit(0.0)).alias("fail_value"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE floor((p_size - p_size % 7) / (p_size % 7) * 10000.0 + 0.5) / 100 END AS pct FROM part""")
def q_pct_change(t: Tables) -> DataFrame:
    now, before = F.col("p_size").cast("double"), (F.col("p_size") % 7).cast("double")
    return t.part.select("p_partkey", F.when(before != 0, F.floor((now - before) / before * 10000.0 + 0.5) / 100).alias("pct"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 1.0::DOUBLE / (p_size % 5) * 100 END AS pct FROM part""")
def q_pct_of(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", N.pct_of(F.lit(1.0), F.col("p_size") % 5).alias("pct"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 2 + 0.5) AS BIGINT) AS rounded FROM customer")
def q_round_half_up(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", N.round_half_up(F.col("c_acctbal") / 2).alias("rounded"))


@query("""SELECT o_orderkey AS transaction_id, o_custkey AS owner_id, o_orderstatus AS row_type, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS transaction_type,
o_totalprice AS total_value, strftime(o_orderdate, '%Y-%m-%d') AS transaction_date FROM orders""")
def q_compat_projection(t: Tables) -> DataFrame:
    """Older names for the columns; the redefined type keeps the original beside it."""
    return t.orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderstatus").alias("row_type"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("transaction_type"),
        F.col("o_totalprice").alias("total_value"),
        D.iso(F.col("o_orderdate")).alias("transaction_date"),
    )


@query("""SELECT c_custkey, 'https://example.org/data/' || c_custkey || '/' || replace(lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '-26-' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0'), '-', '') AS url FROM customer""")
def q_url_build(t: Tables) -> DataFrame:
    """Unpadded id and dashless number in a path."""
    number = F.concat_ws("-", T.pad_key(F.col("c_custkey").cast("string")), F.lit("26"), T.pad_key(F.col("c_nationkey").cast("string"), 6))
    url = F.concat(F.lit("https://example.org/data/"), F.col("c_custkey").cast("string"), F.lit("/"), F.regexp_replace(number, "-", ""))
    return t.customer.select("c_custkey", url.alias("url"))


@query("""SELECT c_custkey, CASE WHEN length(k) < 10 THEN lpad(k, 10, '0') ELSE k END AS padded FROM
(SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN '123456789012' ELSE CAST(c_custkey AS VARCHAR) END AS k FROM customer)""")
def q_pad_key(t: Tables) -> DataFrame:
    key = F.when(F.col("c_custkey") % 100 == 0, "123456789012").otherwise(F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", T.pad_key(key).alias("padded"))


@query("""SELECT c_custkey, array_to_string(list_filter([nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END), ''), nullif(c_mktsegment, 'BUILDING')], lambda x: x IS NOT NULL), ' ') AS full_name FROM customer""")
def q_concat_nonempty(t: Tables) -> DataFrame:
    first = F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", T.concat_nonempty(" ", first, F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("full_name"))


@query(r"""SELECT p_partkey, regexp_extract(p_name || ' (' || p_size || ' x)', '\(([A-Za-z0-9]+)', 1) AS code FROM part""")
def q_paren_code(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" x)"))
    return t.part.select("p_partkey", T.paren_code(text).alias("code"))


DISPLAY = "s_name || '  (S' || s_suppkey || ', B)  (CIK ' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || ')'"


@query(rf"""SELECT s_suppkey, trim(regexp_extract({DISPLAY}, '^([^(]*)', 1)) AS name, regexp_extract({DISPLAY}, '\(([A-Z0-9]+),', 1) AS ticker,
regexp_extract({DISPLAY}, 'CIK (\d{{10}})', 1) AS cik FROM supplier""")
def q_display_name(t: Tables) -> DataFrame:
    """Name, first ticker and padded id out of one display text."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat("s_name", F.lit("  (S"), key, F.lit(", B)  (CIK "), F.lpad(key, 10, "0"), F.lit(")"))
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    return t.supplier.select("s_suppkey", F.trim(part(r"^([^(]*)")).alias("name"), part(r"\(([A-Z0-9]+),").alias("ticker"), part(r"CIK (\d{10})").alias("cik"))


@query("SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 200) AS slug FROM pages")
def q_slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT s_suppkey, substr(sha1(upper(s_name || '|' || '' || '|' || s_nationkey)), 1, 12) AS id FROM supplier")
def q_hash_id(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", T.hash_id(F.col("s_name"), F.lit(None).cast("string"), F.col("s_nationkey")).alias("id"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part")
def q_nullify(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, "-0-").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", F.when(raw == "-0-", "").otherwise(raw).alias("brand"))


@query("SELECT c_custkey, c_mktsegment AS symbol FROM customer")
def q_prefix_strip(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.after_prefix(F.concat(F.lit("NYSE/"), F.col("c_mktsegment"))).alias("symbol"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def q_suffix_strip(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    suffix = F.when(k == 0, ", Jr.").when(k == 1, ",  III").when(k == 2, ", sr ").otherwise("")
    return t.supplier.select("s_suppkey", T.strip_generation(F.concat("s_name", suffix)).alias("name"))


@query("""SELECT s_suppkey, upper(s_name) || CASE s_suppkey % 7 WHEN 2 THEN ' INTERNATIONAL MANAGEMENT' WHEN 3 THEN ' PHARMACEUTICALS'
WHEN 4 THEN ' SOUTHERN POWER' WHEN 6 THEN ' TECHNOLOGY CORPORAL NEWER' ELSE '' END AS name FROM supplier""")
def q_normalize_name(t: Tables) -> DataFrame:
    """Names with articles, abbreviations, legal forms, places and hints; only whole words count."""
    tails = [", Inc.", " Holdings & Co /DE", " Intl Mgmt Corp (New)", " Pharm N.V. Netherlands", " Southn Pwr Co, The", " S.A. Switz /PA/", " Tech Corporal Newer"]
    k, name = F.col("s_suppkey") % 7, F.col("s_name")
    full = F.concat(F.when(k == 0, "The ").otherwise(""), name, F.element_at(F.array(*map(F.lit, tails)), k.cast("int") + 1))
    return t.supplier.select("s_suppkey", T.normalize_name(full).alias("name"))


@query("SELECT p_partkey, p_name AS name FROM part")
def q_ctrl_strip(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.strip_controls(F.concat(F.lit("\x02"), F.col("p_name"), F.lit("\x1f"))).alias("name"))


ODD_DATES = """d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '0012-02-17' WHEN o_orderkey % 17 = 0 THEN '2031-01-29' WHEN o_orderkey % 19 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS tx,
CASE WHEN o_orderkey % 23 = 0 THEN '2050-12-31' WHEN o_orderkey % 29 = 0 THEN '2050-06-15' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ex FROM orders)"""


def _odd_dates(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), D.iso(F.col("o_orderdate"))
    tx = F.when(k % 13 == 0, "0012-02-17").when(k % 17 == 0, "2031-01-29").when(k % 19 == 0, "").otherwise(day)
    ex = F.when(k % 23 == 0, "2050-12-31").when(k % 29 == 0, "2050-06-15").otherwise(day)
    return t.orders.select("o_orderkey", "o_orderdate", tx.alias("tx"), ex.alias("ex"))


@query(f"""WITH {ODD_DATES}, f AS (SELECT o_orderkey, CASE WHEN tx <> '' AND (tx < '1990-01-01' OR tx > '2027-01-01') THEN 'anomalous_year_likely_filer_entry' END AS tx_flag,
CASE WHEN ex IN ('2050-12-31', '2050-08-31') THEN 'sec_perpetual_sentinel' WHEN ex <> '' AND (ex < '1990-01-01' OR ex > '2050-01-01') THEN 'anomalous_year_likely_filer_entry' END AS ex_flag FROM d)
SELECT * FROM f WHERE tx_flag IS NOT NULL OR ex_flag IS NOT NULL""")
def q_source_metadata(t: Tables) -> DataFrame:
    rows = _odd_dates(t).withColumn("meta", C.source_metadata({"transaction_date": F.col("tx"), "exercise_date": F.col("ex")})).where("meta is not null")
    flag = lambda field: F.try_element_at("meta", F.lit(field))[0]
    return rows.select("o_orderkey", flag("transaction_date").alias("tx_flag"), flag("exercise_date").alias("ex_flag"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN CAST(year(o_orderdate) + 30 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v,
year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN bad THEN CAST(y AS VARCHAR) || substr(v, 5, 6) ELSE v END AS value, CASE WHEN bad THEN v END AS source, bad AS corrected, CASE WHEN bad THEN 'filed' END AS basis
FROM (SELECT *, CAST(substr(v, 1, 4) AS INTEGER) - y >= 2 AS bad FROM d)""")
def q_date_correction(t: Tables) -> DataFrame:
    day, year = D.iso(F.col("o_orderdate")), F.year("o_orderdate")
    value = F.when(F.col("o_orderkey") % 10 == 0, F.concat((year + 30).cast("string"), F.substring(day, 5, 6))).otherwise(day)
    return t.orders.select("o_orderkey", D.corrected_date(value, {"cycle": F.lit(None).cast("int"), "filed": year}).alias("x")).select("o_orderkey", "x.*")


@query("""SELECT p_partkey, contains(upper(p_type), 'SMALL') AS is_director, contains(upper(p_type), 'PROMO') AS is_officer, contains(upper(p_brand), '10') AS is_ten_percent FROM part""")
def q_role_flags(t: Tables) -> DataFrame:
    text = F.concat(F.regexp_replace(F.regexp_replace(F.upper("p_type"), "SMALL", "Director"), "PROMO", "an officer"), F.col("p_brand"))
    flags = C.role_flags(text)
    return t.part.select("p_partkey", *[flags[x].alias(x) for x in ("is_director", "is_officer", "is_ten_percent")])


@query(r"""SELECT p_partkey, CASE WHEN p_type = '' THEN 'other' WHEN regexp_matches(p_type, '(?i)^(small|medium)') THEN 'low' WHEN regexp_matches(p_type, '(?i)(large|economy)') THEN 'high' ELSE 'other' END AS grade FROM part""")
def q_regex_ladder(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    grade = F.when(kind == "", "other").when(kind.rlike("(?i)^(small|medium)"), "low").when(kind.rlike("(?i)(large|economy)"), "high").otherwise("other")
    return t.part.select("p_partkey", grade.alias("grade"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'cabinet' WHEN 2 THEN 'cabinet' WHEN 3 THEN 'other' WHEN 4 THEN 'cabinet' ELSE 'appointee' END AS filer_type,
CASE p_partkey % 4 WHEN 0 THEN 'spouse' WHEN 1 THEN 'dependent' ELSE 'self' END AS owner FROM part""")
def q_filer_type(t: Tables) -> DataFrame:
    """Filer types of positions, and owners of assets, by their words."""
    k, j, name = F.col("p_partkey") % 6, F.col("p_partkey") % 4, F.col("p_name")
    position = F.when(k == 0, F.concat(F.lit("Secretary of "), name)).when(k == 1, F.concat(F.lit("Acting Secretary of "), name)).when(k == 2, "Attorney General")
    position = position.when(k == 3, "  ").when(k == 4, "Secretrary of Defense").otherwise(F.concat(name, F.lit(" Counsel")))
    asset = F.when(j == 0, F.concat(name, F.lit(" (Spouse's trust)"))).when(j == 1, F.concat(name, F.lit(", spouse and Dependent child"))).when(j == 2, F.concat(name, F.lit(" dependents")))
    return t.part.select("p_partkey", C.filer_type(position).alias("filer_type"), C.owner(asset).alias("owner"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{3,}')) / greatest(len(string_split(text, chr(10))), 1) <= 5 AS needs_ocr FROM documents""")
def q_word_density(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.word_density_low(F.col("text"), F.size(F.split("text", "\n"))).alias("needs_ocr"))


@query("""SELECT o_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'INSUFFICIENT_DATA' ELSE 'VERIFIED' END AS status
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q_any_member(t: Tables) -> DataFrame:
    """Any unresolved member makes the parent insufficient."""
    notes = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_returnflag").alias("notes"))
    status = F.when(F.exists("notes", lambda x: x == "R"), C.UNKNOWN).otherwise("VERIFIED")
    return t.orders.join(notes, "o_orderkey").select("o_orderkey", status.alias("status"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 6 AS a, l_suppkey % 9 AS b, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity < 10 THEN 'VERIFIED' WHEN a > l_orderkey % 8 OR b > l_orderkey % 8 THEN 'INSUFFICIENT_DATA' ELSE 'VERIFIED' END AS status FROM r""")
def q_verification(t: Tables) -> DataFrame:
    """Rows whose references all lead to a note of their filing are verified; those with a dangling one are not."""
    codes = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 8).cast("int")), lambda x: F.concat(F.lit("F"), x.cast("string")))
    notes = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.map_from_arrays(codes, F.transform(codes, lambda x: F.concat(F.lit("note "), x))).alias("notes"))
    text = F.when(F.col("l_quantity") >= 10, F.concat(F.lit("F"), (F.col("l_partkey") % 6).cast("string"), F.lit(", F"), (F.col("l_suppkey") % 9).cast("string"))).otherwise("")
    rows = t.lineitem.join(notes, "l_orderkey", "left").withColumn("resolved", L.footnotes(T.tokens(text), F.col("notes")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", L.verification(F.col("resolved")).alias("status"))


@query("""SELECT p_partkey, p_size % 8 IN (0, 1, 2) AS is_derivative, CASE p_partkey % 7 WHEN 0 THEN 'future' WHEN 1 THEN 'forward' WHEN 2 THEN 'swap'
WHEN 3 THEN CASE p_size % 4 WHEN 0 THEN 'warrant' WHEN 1 THEN 'swaption' ELSE 'option' END WHEN 4 THEN 'other' WHEN 5 THEN 'swap' END AS kind FROM part""")
def q_derivative_type(t: Tables) -> DataFrame:
    """Whether an asset category is a derivative's, and of which kind its tags say it is."""
    k, n = F.col("p_partkey") % 7, F.col("p_size")
    asset = F.element_at(F.array(*map(F.lit, ["DE", "DFE", "DR", "REPO", "RP", "EC", "", "de"])), n % 8 + 1)
    tags = [["futrDeriv"], ["fwdDeriv"], ["swapDeriv"], ["optionSwaptionWarrantDeriv"], ["otherDeriv"], ["otherDeriv", "swapDeriv"], []]
    held = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in tags]), (k + 1).cast("int"))
    sub = F.when(n % 4 == 0, "WAR").when(n % 4 == 1, "SWO").when(n % 4 == 2, "OPT")
    return t.part.select("p_partkey", L.is_derivative(asset).alias("is_derivative"), L.derivative_type(held, sub).alias("kind"))


@query("""WITH f AS (SELECT s_suppkey AS id, s_suppkey % 6 AS k, s_name AS name, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(s_suppkey + 1 AS VARCHAR), 10, '0') AS next_cik FROM supplier)
SELECT id, CASE WHEN k < 5 THEN name END AS target, CASE WHEN k < 5 THEN CASE WHEN k = 3 THEN '' ELSE 'A.B' END END AS target_ticker, CASE WHEN k < 5 THEN cik END AS target_cik,
CASE WHEN k IN (0, 1, 4) THEN name WHEN k < 5 THEN 'Bidder (CA) Co' END AS bidder, CASE WHEN k IN (0, 1, 4) THEN 'A.B' WHEN k < 5 THEN '' END AS bidder_ticker,
CASE k WHEN 0 THEN cik WHEN 1 THEN cik WHEN 2 THEN next_cik WHEN 3 THEN next_cik WHEN 4 THEN cik END AS bidder_cik FROM f""")
def q_tender_parties(t: Tables) -> DataFrame:
    """Target and bidder of tender offers, an issuer's own and third parties', out of display names and identifiers."""
    k, key = F.col("s_suppkey") % 6, F.col("s_suppkey")
    own = F.concat("s_name", F.when(k == 3, "").otherwise(" (A.B)"), F.when(k == 1, "").otherwise(F.concat(F.lit("  (CIK "), key.cast("string"), F.lit(")"))))
    second = F.concat(F.lit("Bidder (CA) Co"), F.when(k == 2, F.concat(F.lit(" (cik "), (key + 1).cast("string"), F.lit(") "))).otherwise(""))
    names = F.when(k == 5, F.array().cast("array<string>")).when(k.isin(0, 4), F.array(own)).otherwise(F.array(own, second))
    ciks = F.array(key.cast("string"), (key + 1).cast("string"))
    form = F.when(k.isin(0, 1), "SC TO-I/A").otherwise("SC TO-T")
    x = F.col("x")
    rows = t.supplier.select(key.alias("id"), L.tender_parties(form, names, ciks).alias("x"))
    return rows.select("id", *[x[role][part].alias(role if part == "name" else f"{role}_{part}") for role in ("target", "bidder") for part in ("name", "ticker", "cik")])


@query(r"""WITH h AS (SELECT page_id, html || ' it&#8217;s &#x41;&#' || (33 + page_id % 90) || ';&#99999999; &#x1F600; end' AS html FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
'(?i)</?(p|div|br|li|ul|ol|tr|td|th|h[1-6]|table|section|article|nav)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&#') AS parts FROM h),
n AS (SELECT page_id, parts[1] || array_to_string(list_transform(parts[2:], lambda x: CASE
  WHEN regexp_matches(x, '^[xX][0-9a-fA-F]{1,6};') THEN chr(CAST('0x' || regexp_extract(x, '^[xX]([0-9a-fA-F]+);', 1) AS INTEGER)) || regexp_replace(x, '^[^;]*;', '')
  WHEN regexp_matches(x, '^[0-9]{1,7};') THEN chr(CAST(regexp_extract(x, '^([0-9]+);', 1) AS INTEGER)) || regexp_replace(x, '^[^;]*;', '')
  ELSE '&#' || x END), '') AS html FROM p),
s AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS x FROM n)
SELECT page_id, length(x) AS n, md5(x) AS digest FROM s""")
def q_strip_html(t: Tables) -> DataFrame:
    number = (F.col("page_id") % 90 + 33).cast("string")
    text = T.strip_html(F.concat("html", F.lit(" it&#8217;s &#x41;&#"), number, F.lit(";&#99999999; &#x1F600; end")))
    return t.pages.select("page_id", text.alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS c FROM orders""")
def q_parse_dates(t: Tables) -> DataFrame:
    """Three source formats read back to ISO text; letters that are no month give null."""
    day = F.col("o_orderdate")
    a = D.parse_day_month_year(F.when(F.col("o_orderkey") % 7 == 0, "05-ANF-2020").otherwise(F.upper(F.date_format(day, "d-MMM-yyyy"))))
    b = D.parse_us(F.date_format(day, "M/d/yyyy"))
    c = D.parse_compact(F.when(F.col("o_orderkey") % 5 == 0, "00000000").otherwise(F.date_format(day, "yyyyMMdd")))
    return t.orders.select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def q_day_month(t: Tables) -> DataFrame:
    """A day and month without a year, and the year from elsewhere."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "5-Anf").otherwise(F.date_format("o_orderdate", "d-MMM"))
    return t.orders.select("o_orderkey", D.parse_day_month(text, F.year("o_orderdate")).alias("day"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 365 WHEN (c_custkey - 100) * 10 < 1 THEN 1
WHEN (c_custkey - 100) * 10 > 3650 THEN 3650 ELSE (c_custkey - 100) * 10 END AS days FROM customer""")
def q_lookback(t: Tables) -> DataFrame:
    """Days to look back, clamped, with a default."""
    asked = F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") - 100) * 10)
    return t.customer.select("c_custkey", D.lookback_days(asked).cast("long").alias("days"))


@query("SELECT event_id, strftime(CAST(to_timestamp(1700000000 + event_id * 997) AS TIMESTAMP), '%Y-%m-%d') AS day FROM events")
def q_epoch_date(t: Tables) -> DataFrame:
    return t.events.select("event_id", D.epoch_date(F.lit(1700000000) + F.col("event_id") * 997).alias("day"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS moment FROM events")
def q_ts_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "^([^ ]*) ", "$1T").alias("moment"))


@query("""SELECT DISTINCT strftime(o_orderdate, '%YM%m') AS m, year(o_orderdate) || 'Q0' || quarter(o_orderdate) AS q, isoyear(o_orderdate) || 'W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS w,
year(o_orderdate) || 'D' || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') AS d, year(o_orderdate) || 'A01' AS a FROM orders""")
def q_period_labels(t: Tables) -> DataFrame:
    kinds = {"m": "M", "q": "Q", "w": "W", "d": "D", "a": "A"}
    return t.orders.select(*[D.period_label(F.col("o_orderdate"), kind).alias(name) for name, kind in kinds.items()]).distinct()


@query("""WITH m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS a)
SELECT strftime(a, '%Y-%m-%d') AS month_start, strftime(last_day(a), '%Y-%m-%d') AS month_end, count(o_orderkey) AS n
FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate) = a GROUP BY a""")
def q_calendar_series(t: Tables) -> DataFrame:
    """A generated calendar keeps months without rows."""
    months = t.spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))).alias("a"))
    counted = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("a")).agg(F.count("*").alias("n"))
    return months.join(counted, "a", "left").select(
        D.iso(F.col("a")).alias("month_start"), D.iso(F.last_day("a")).alias("month_end"), F.coalesce("n", F.lit(0)).alias("n")
    )


@query(f"WITH {ODD_DATES} SELECT try_cast(nullif(regexp_extract(tx, '^(\\d{{4}})-', 1), '') AS INTEGER) AS y, count(*) AS n FROM d GROUP BY 1")
def q_year_extract(t: Tables) -> DataFrame:
    return _odd_dates(t).groupBy(D.year_of(F.col("tx")).alias("y")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 50000000.0 ELSE floor(o_totalprice) END AS low, CASE WHEN o_orderkey % 6 <> 0 THEN floor(o_totalprice) * 2 END AS high FROM orders""")
def q_amount_range(t: Tables) -> DataFrame:
    low = F.floor("o_totalprice")
    text = F.when(F.col("o_orderkey") % 6 == 0, "Over $50,000,000").otherwise(
        F.concat(F.lit("$"), F.format_number(low.cast("double"), 0), F.lit(" - $"), F.format_number((low * 2).cast("double"), 0))
    )
    a, b = N.amount_range(text)
    return t.orders.select("o_orderkey", a.alias("low"), b.alias("high"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN p_size + 0.5 WHEN 2 THEN -CAST(p_size AS DOUBLE)
WHEN 3 THEN p_size * 100.0 WHEN 4 THEN 0.5 ELSE CAST(p_size AS DOUBLE) END AS value FROM part""")
def q_lenient_numeric(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = F.when(k == 0, "n/a").when(k == 1, F.concat(size, F.lit(".5 units"))).when(k == 2, F.concat(F.lit("-"), size))
    text = text.when(k == 3, F.concat(size, F.lit("e2"))).when(k == 4, ".5 of it").otherwise(F.concat(F.lit(" "), size, F.lit("x")))
    return t.part.select("p_partkey", N.lenient_number(text).alias("value"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[,\s]+'), lambda x: x <> '')) AS n_tokens FROM documents""")
def q_split_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS published FROM events""")
def q_rfc_date(t: Tables) -> DataFrame:
    """Dates as feeds write them, in several zones, back to instants in UTC."""
    k = F.col("event_id") % 4
    zone = F.when(k == 0, "GMT").when(k == 1, "EDT").when(k == 2, "+0530").otherwise("-0800")
    minutes = F.when(k == 0, 0).when(k == 1, -240).when(k == 2, 330).otherwise(-480)
    local = F.col("ts") + F.make_dt_interval(mins=minutes)
    written = F.concat(F.when(k < 2, F.date_format(local, "EEE, ")).otherwise(""), F.date_format(local, "d MMM yyyy HH:mm:ss "), zone)
    odd = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("on "), written)).otherwise(written)
    return t.events.select("event_id", D.rfc_date(odd).alias("published"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html,
md5(CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS csv,
md5(regexp_replace(replace(replace(text, '\', '\\'), '|', '\|'), '[\r\n]+', ' ', 'g')) AS markdown FROM documents""")
def q_escape(t: Tables) -> DataFrame:
    """Texts as a page, a cell of a CSV file and a cell of a table would hold them."""
    text = F.col("text")
    return t.documents.select("doc_id", F.md5(T.escape_html(text)).alias("html"), F.md5(T.escape_csv(text)).alias("csv"), F.md5(T.escape_markdown(text)).alias("markdown"))
