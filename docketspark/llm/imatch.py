"""I-Match document fingerprints, in native Spark columns only.

A corpus pass counts in how many documents each word occurs.  The lexicon keeps the words whose inverse document
frequency lies in a band: those in at least ``least`` and at most ``most`` of all documents.  Since a document
holds D different words on average, no more than D / ``least`` words can pass, whatever the size of the corpus, so
the lexicon may ride along as a constant of the plan.  A document's fingerprint takes its distinct lexicon words
in sorted order and hashes them once whole and once for each of 52 random sub-lexicons, which hold a quarter, a
sixteenth, a 64th or a 256th of the words (by digits of the word's MD5).  Small edits leave some of the
sub-lexicons' hashes alone, so the share of equal hashes is a likeness.

Results for odd input: a null text counts as empty; a text without lexicon words is fingerprinted by all its
words, one without words by empty hashes (like only to another such text); a null ``doc_id`` comes after all
others in the order of documents; rows that repeat a ``doc_id`` are ordered by their text; other columns are left
alone; an empty table gives an empty result; a single document is its own next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band of the document frequency, as shares of the documents, and the least number of documents.
LEAST, MOST, AT_LEAST = 0.005, 0.2, 2
#: A sub-lexicon holds the words whose MD5, read in digits 0-3, begins so: all, a quarter, 1/16, 1/64 or 1/256 of them.
QUARTERS = [str(k) for k in range(4)]
SIXTEENTHS = [a + b for a in QUARTERS for b in QUARTERS]
SUBSETS = ["", *QUARTERS, *SIXTEENTHS, *(x + "0" for x in SIXTEENTHS), *(x + "00" for x in SIXTEENTHS)]
HEX, BASE4 = "0123456789abcdef", "0000111122223333"
WHITE = r"[\x20\x09-\x0D]+"
#: Buckets of the lexicon constant, and at most so many ranges of documents when they are put in order.
LEXICON_BUCKETS, COARSE, FINE, PER_RANGE = 4096, 128, 512, 2000


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.filter(F.split(F.lower(text), WHITE), lambda x: x != "")


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """``term, n_docs`` of the words in the band, counted over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n_docs"))
    return counted.where((F.col("n_docs") >= AT_LEAST) & (F.col("n_docs") >= least * n) & (F.col("n_docs") <= most * n))


def slot(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(LEXICON_BUCKETS))


def constant(terms: DataFrame) -> Column:
    """The lexicon as a constant array of buckets; its size is bounded by the band, not by the corpus."""
    rows = terms.groupBy(slot(F.col("term")).alias("slot")).agg(F.array_sort(F.collect_list("term")).alias("terms")).collect()
    table: list[list[str]] = [[] for _ in range(LEXICON_BUCKETS)]
    for row in rows:
        table[row.slot] = row.terms
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "array<array<string>>")


def in_lexicon(terms: Column, lexical: Column) -> Column:
    return F.filter(terms, lambda x: F.array_contains(F.element_at(lexical, slot(x) + 1), x))


def digit_is(n: int, digit: str):
    return lambda x: x[f"q{n}"] == digit


def with_fingerprint(df: DataFrame, kept: str, own: str, name: str) -> DataFrame:
    """Add the array of a text's hashes, one for each sub-lexicon, empty where it holds no word of it.

    ``kept`` are the text's lexicon words and ``own`` all its words.  Each sub-lexicon is sifted from the next
    larger one, column by column, so a word is looked at about nine times for all of them.
    """
    columns = df.columns
    df = df.withColumn("__chosen", F.array_sort(F.array_distinct(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(own)))))
    digits = lambda x: F.translate(F.substring(F.md5(x.cast("binary")), 1, 4), HEX, BASE4)
    df = df.withColumn("__marked", F.transform("__chosen", lambda x: F.struct(x.alias("term"), digits(x).alias("q"))))
    df = df.withColumn(
        "__", F.transform("__marked", lambda x: F.struct(x["term"].alias("term"), *[F.substring(x["q"], k, 1).alias(f"q{k}") for k in (1, 2, 3, 4)]))
    )
    depth = {n: [x for x in SUBSETS if len(x) == n] for n in (1, 2, 3, 4)}
    for n, prefixes in depth.items():
        df = df.withColumns({f"__{x}": F.filter(f"__{x[:-1]}", digit_is(n, x[-1])) for x in prefixes})

    def hashed(x: str) -> Column:
        part = F.col(f"__{x}")
        return F.when(F.size(part) > 0, F.substring(F.md5(F.array_join(part["term"], " ").cast("binary")), 1, 8)).otherwise("")

    return df.withColumn(name, F.array(*[hashed(x) for x in SUBSETS])).select(*columns, name)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that are not empty on both sides; of two empty fingerprints 1."""
    pairs = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != "") | (p["y"] != ""))
    equal = F.filter(pairs, lambda p: p["x"] == p["y"])
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(equal) / F.size(pairs))


def with_next(docs: DataFrame, mark: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``mark(docs)`` with ``next_<column>`` of the next document in descending ``doc_id``, after the last that of the first.

    Documents are dealt into ranges of their ids (quantiles, evenly split further); each range also gets a copy of
    the first document of the following one, so every neighbour is found inside its range.  ``mark`` runs once on each
    document and on those copies, one for each range.
    """
    n = docs.count()
    cuts = docs.agg(F.percentile_approx("doc_id", [k / COARSE for k in range(COARSE + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    fine = max(1, min(FINE, -(-n // (COARSE * PER_RANGE))))
    lows, highs = F.array(*map(F.lit, cuts)), F.array(*[F.lit(x) for x in [*cuts[1:], cuts[-1] + 1]])
    coarse = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(lows, coarse).cast("double"), F.element_at(highs, coarse).cast("double")
    part = F.least(F.greatest(F.floor((F.col("doc_id") - low) / (high - low) * fine), F.lit(0)), F.lit(fine - 1))
    ranged = docs.withColumn("range", F.coalesce(coarse * fine + part, F.lit(-1)).cast("int"))
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))  # at most COARSE * FINE + 1 rows
    order = Window.orderBy(F.desc("range"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.col("range").alias("own"), F.coalesce(F.lag("range").over(order), F.min("range").over(every)).alias("range"))
    copies = ranged.withColumnRenamed("range", "own").join(F.broadcast(heads), "own").where(F.col("doc_id").eqNullSafe(F.col("head")))
    both = mark(ranged.withColumn("copy", F.lit(False)).unionByName(copies.drop("own", "head").withColumn("copy", F.lit(True))))
    window = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    for name in columns:
        both = both.withColumn(f"next_{name}", F.lead(name).over(window))
    return both.where(~F.col("copy")).drop("copy", "range")


def compare_edits(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness; a row for each row of ``docs``.

    The edited text has its last third replaced by as much of the beginning of the next document.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lexical = constant(lexicon(plain, least, most))

    def mark(docs: DataFrame) -> DataFrame:
        docs = docs.withColumn("own", words(F.col("text"))).withColumn("kept", F.array_distinct(in_lexicon(F.col("own"), lexical)))
        return with_fingerprint(docs, "kept", "own", "hashes").drop("own")

    near = with_next(plain, mark, ["text", "kept", "hashes"]).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    near = near.withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut)).withColumn(
        "tail", F.substring(F.col("next_text"), F.lit(1), cut)
    )
    # whole words of either part are words of their own text; only the word across the cut and the last one may be new
    near = near.withColumn("a", F.split(F.lower("head"), WHITE)).withColumn("b", F.split(F.lower("tail"), WHITE))
    across = F.concat(F.element_at("a", -1), F.element_at("b", 1))
    edited = F.concat(F.slice("a", 1, F.size("a") - 1), F.slice("edges", 1, 1), F.slice("b", 2, F.size("b")))
    near = near.withColumn("edges", F.array(across, F.element_at("b", -1))).withColumn("own", F.filter(edited, lambda x: x != ""))
    known = F.concat("kept", "next_kept", in_lexicon(F.col("edges"), lexical))
    near = near.withColumn("edited_kept", F.array_intersect("own", known)).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        "hashes", "next_hashes", "edited_kept", "own",
    )
    near = with_fingerprint(near, "edited_kept", "own", "edited_hashes")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("hashes", "-").alias("fingerprint"),
        F.array_join("edited_hashes", "-").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
