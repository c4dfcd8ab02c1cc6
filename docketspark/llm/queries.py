"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fill_in_middle, imatch, line_dedup, minhash_dedup, packing, quality, resampling, secret_scan, sentencepiece_numpy, substring_dedup, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of one label with a cosine of at least 0.93; see :func:`embedding_dedup.near_duplicates`."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), least=0.93)


@query
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """I-Match fingerprints of all texts and of their edited texts; see :func:`imatch.compare_edits`."""
    return imatch.compare_edits(table(spark, folder, "documents"))


def _imatch_sql() -> str:
    """The same in DuckDB SQL, from the same band and sub-lexicons."""

    def part(prefix: str) -> str:
        digits = f"translate(substr(md5(x), 1, 4), '{imatch.HEX}', '{imatch.BASE4}')"
        terms = f"list_filter(terms, lambda x: starts_with({digits}, '{prefix}'))" if prefix else "terms"
        return f"CASE WHEN len({terms}) > 0 THEN substr(md5(array_to_string({terms}, ' ')), 1, 8) ELSE '' END"

    hashes = ",\n  ".join(part(x) for x in imatch.SUBSETS)
    like = """CASE WHEN len(list_filter(list_zip(a.hashes, {0}.hashes), lambda p: p[1] <> '' OR p[2] <> '')) = 0 THEN 1.0
    ELSE len(list_filter(list_zip(a.hashes, {0}.hashes), lambda p: (p[1] <> '' OR p[2] <> '') AND p[1] = p[2])) * 1.0
      / len(list_filter(list_zip(a.hashes, {0}.hashes), lambda p: p[1] <> '' OR p[2] <> '')) END"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
edits AS (SELECT n.doc_id, n.next_id, length(n.text) AS n_chars,
  left(n.text, length(n.text) - length(n.text) // 3) || left(x.text, length(n.text) // 3) AS edited
  FROM nexts n JOIN d x ON x.doc_id = n.next_id),
texts AS (SELECT doc_id, 0 AS kind, text FROM d UNION ALL SELECT doc_id, 1, edited FROM edits),
bag AS (SELECT doc_id, kind, list_distinct(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS bag FROM texts),
lexicon AS (SELECT term FROM (SELECT unnest(bag) AS term FROM bag WHERE kind = 0) GROUP BY term
  HAVING count(*) >= {imatch.AT_LEAST} AND count(*) >= {imatch.LEAST} * (SELECT count(*) FROM d) AND count(*) <= {imatch.MOST} * (SELECT count(*) FROM d)),
kept AS (SELECT doc_id, kind, list(term) AS kept FROM (SELECT doc_id, kind, unnest(bag) AS term FROM bag) JOIN lexicon USING (term) GROUP BY doc_id, kind),
chosen AS (SELECT b.doc_id, b.kind, list_sort(coalesce(k.kept, b.bag)) AS terms FROM bag b LEFT JOIN kept k ON b.doc_id = k.doc_id AND b.kind = k.kind),
prints AS (SELECT doc_id, kind, [{hashes}] AS hashes FROM chosen)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.hashes, '-') AS fingerprint,
  array_to_string(b.hashes, '-') AS edited_fingerprint, {like.format('b')} AS near_edited, {like.format('c')} AS near_next
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN prints c ON c.doc_id = e.next_id AND c.kind = 0
"""


SQL["op2_document_fingerprints"] = _imatch_sql()


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's ids and what they decode to, as digests; see :mod:`sentencepiece_numpy`."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = sentencepiece_numpy.decode(sentencepiece_numpy.encode(table(spark, folder, "documents"), model), model)
    return both.select(
        "doc_id", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents on 4-word shingles; see :func:`minhash_dedup.near_duplicates`."""
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


#: Host, path and verdict of the rules; the longest that fits wins.
RULES: list[url_filter.Rule] = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url; see :func:`url_filter.judge`."""
    return url_filter.judge(table(spark, folder, "pages"), RULES, default="allow")


SQL["op5_url_filter"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0
    THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document; see :func:`toxicity.grade`."""
    docs = table(spark, folder, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document; see :func:`quality.classify`."""
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, folder, "labels")), least=0.3)


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shared by three documents or more go; see :class:`line_dedup.LineIndex`."""
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.line, l.pos, r.key IS NOT NULL AND l.doc_id <> r.last_doc AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that smaller documents hold too; see :mod:`substring_dedup`."""
    kept = substring_dedup.dedup_passages(table(spark, folder, "documents"), least=50, shingle=5, similarity=0.8)
    return kept.select(
        "doc_id", "n_words", "n_repeated", "others", (F.col("n_repeated") > 0).alias("repeated"), F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token pieces in sequences of at most 1024; see :func:`packing.pack`."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the patterns and of the assignment-aware lexer in every text; see :mod:`secret_scan`."""
    found = secret_scan.scan(table(spark, folder, "documents"))
    counts = [secret_scan.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("spans"), base=True), 256).alias("base_sha256"), secret_scan.listed(F.col("spans"), base=False).alias("spans"))


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every text transformed over compressed frames and rebuilt, as digests; see :mod:`fill_in_middle`."""
    rates = fill_in_middle.Rates(seed=42, transformed=50, suffix_first=80)
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(fill_in_middle.store(table(spark, folder, "documents")), rates))


SQL["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
form AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM form)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn by how much likelier their n-grams are in ``benchmark``; see :mod:`resampling`."""
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 from its table, a byte at a time; only distinct n-grams are hashed.
SQL["op13_importance_resampling"] = r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
words AS (SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
grams AS (SELECT src, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM words, range(1, 4) r(k)),
counted AS (SELECT src, id, gram, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)),
parsed AS (SELECT gram, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM hexed),
buckets AS (SELECT gram, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM parsed, steps),
placed AS (SELECT src, id, bucket, n FROM counted JOIN buckets USING (gram)),
sums AS (SELECT r.i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS all_s, sum(coalesce(t, 0)) OVER () AS all_t
  FROM range(10000) r(i) LEFT JOIN (SELECT bucket, sum(n) FILTER (WHERE src = 0) AS s, sum(n) FILTER (WHERE src = 1) AS t FROM placed GROUP BY bucket) p ON p.bucket = r.i),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (bucket) WHERE src = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE src = 0),
ranked AS (SELECT doc_id, rank() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
