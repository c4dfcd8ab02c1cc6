"""Rows that repeat an id with different contents, joins bounded by bytes, and passages among common phrases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docketspark.llm import embedding_dedup, minhash_dedup, shared, substring_dedup


def words(rng, n):
    return ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n)]


def repeated_texts(spark):
    rng = random.Random(3)
    one, two = " ".join(words(rng, 120)), " ".join(words(rng, 120))
    rows = [(3, one, "x"), (5, one, "y"), (5, two, "z"), (6, None, "n"), (6, "", "e")]
    return one, two, spark.createDataFrame(rows, "doc_id long, text string, tag string")


def test_minhash_keeps_every_text_that_nothing_duplicates(spark):
    one, two, df = repeated_texts(spark)
    kept = minhash_dedup.keep_one(df).collect()
    assert sorted((r.doc_id, r.tag) for r in kept) == [(3, "x"), (5, "z"), (6, "e"), (6, "n")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (6, 6, True), (6, 6, True)]


def test_passages_of_one_id_with_two_texts(spark):
    one, two, df = repeated_texts(spark)
    got = {(r.doc_id, r.tag): r.text for r in substring_dedup.clean_passages(df).collect()}
    assert got == {(3, "x"): one, (5, "y"): "", (5, "z"): two, (6, "n"): None, (6, "e"): ""}


def test_vectors_of_one_id_have_their_own_links(spark):
    big, small = [1e200, 0.0], [1e-200, 0.0]
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0)]
    rows += [(10, big, 1), (11, [1e200, 1e200], 1), (12, small, 2), (13, [1e-200, 1e-200], 2), (14, [2e-200, 1e-202], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, 0.93).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 2), (3, 2, 2), (4, 2, 2), (10, 0, 10), (11, 0, 11), (12, 1, 12), (13, 0, 13), (14, 1, 12)]


def test_few_rows_of_huge_arrays_are_no_small_side(spark):
    df = spark.range(3).select("id", F.sequence(F.lit(1), F.lit(2_000_000)).alias("x"))
    assert not shared.small(df) and shared.small(df.select("id"))


def test_hot_keys_are_dealt_out_without_changing_the_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = spark.range(200).select((F.col("id") % 40 * (F.col("id") % 2)).alias("k"), "id")
    keyed = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = shared.join_spread(rows, keyed, "k", F.col("id"), how).select("k", "id", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows.join(keyed, "k", how).select("k", "id", "v").collect()), key=str)


def test_labelled_sample_bounds_documents(spark):
    docs = spark.range(500).select(F.lit(2).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert shared.labelled_sample(docs, labels, "quality", 10).count() == 1


def test_passages_among_common_phrases_against_brute_force(spark, monkeypatch):
    """Two documents that share a passage are found though smaller ones lead all their groups with a common phrase."""
    monkeypatch.setattr(substring_dedup, "COMMON", 4)
    rng, docs = random.Random(5), {}
    phrase = words(rng, 14)
    for k in range(60):
        docs[k] = [*words(rng, rng.randint(5, 60)), *phrase, *words(rng, rng.randint(60, 120))]
    for k in range(20):  # passages of 55 words around the phrase, in two documents each
        passage = [*words(rng, 20), *phrase, *words(rng, 21)]
        docs[100 + 2 * k] = [*words(rng, 80), *passage, *words(rng, 30)]
        docs[101 + 2 * k] = [*words(rng, 40), *passage, *words(rng, 70)]
    wanted = {}
    for doc, own in docs.items():
        smaller = {tuple(x[k : k + 50]) for other, x in docs.items() if other < doc for k in range(len(x) - 49)}
        starts = [k for k in range(len(own) - 49) if tuple(own[k : k + 50]) in smaller]
        wanted[doc] = len({k + j for k in starts for j in range(50)})
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_repeated for r in substring_dedup.dedup_passages(rows).collect()} == wanted


def test_windows_of_one_group_meet_wherever_they_lie(spark, monkeypatch):
    """Documents whose groups are all led by an unrelated one are compared in one call, far apart as the passages are."""
    monkeypatch.setattr(substring_dedup, "CALL", 1)
    rng, docs = random.Random(8), {}
    for k in range(40):
        passage = words(rng, 55)
        for part in range(0, 55, 45):  # two documents that hold most of the passage's shingles, and too few to repeat it
            docs[10 * k + part // 45] = [*words(rng, 60), *passage[part : part + 45], *words(rng, 60)]
        docs[10 * k + 2] = [*words(rng, 55), *passage[4:49], *words(rng, 60)]
        docs[10 * k + 3] = [*words(rng, 20), *passage, *words(rng, 60)]
        docs[10 * k + 4] = [*words(rng, 900 + 260 * (k % 3)), *passage, *words(rng, 60)]
    wanted = {}
    for doc, own in docs.items():
        smaller = {tuple(x[k : k + 50]) for other, x in docs.items() if other < doc for k in range(len(x) - 49)}
        starts = [k for k in range(len(own) - 49) if tuple(own[k : k + 50]) in smaller]
        wanted[doc] = len({k + j for k in starts for j in range(50)})
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_repeated for r in substring_dedup.dedup_passages(rows).collect()} == wanted


def test_calls_of_passages_stay_bounded(spark, monkeypatch):
    """The largest call is no larger for a group of four times the windows, and every pair of a group meets in a call."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 16)
    largest = []
    for n in (100, 200, 400):
        at = F.expr("shiftleft(id * 300, 32)")
        windows = [spark.range(n).select(F.lit(1).cast("long").alias("pair"), "id", at.alias("at"))]
        windows.append(spark.range(60).select((F.col("id") % 20 + 2).alias("pair"), "id", at.alias("at")))
        members = windows[0].union(windows[1]).select("pair", F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tag"), "at", (F.col("id") % 2 == 0).alias("open"))
        window, node = F.struct("doc_id", "tag", "at"), F.struct("doc_id", "tag")
        left = members.groupBy("pair").agg(
            F.count("*").alias("count"), F.sum(F.col("open").cast("long")).alias("n_open"), F.min(window).alias("x"), F.max(F.when(F.col("open"), node)).alias("y")
        )
        dealt = substring_dedup.dealt_to_calls(members, left, 46).collect()
        sides: dict[int, list] = {}
        for r in dealt:
            if r.pair == 1:
                sides.setdefault(r.unit, []).append(r)
        met = {(a.doc_id, b.doc_id) for call in sides.values() for a in call if a.asks for b in call if not b.asks}
        last = max(k for k in range(n) if k % 2 == 0)
        assert met == {(a, b) for a in range(0, n, 2) for b in range(last + 1)}
        largest.append(max(len(call) for call in sides.values()))
        together: dict[int, set] = {}
        for r in dealt:
            if r.pair > 1:
                together.setdefault(r.pair, set()).add(r.unit)
        assert all(len(x) == 1 for x in together.values())
    assert max(largest) <= 2 * 2 * 16


def test_calls_of_vectors_stay_bounded(spark, monkeypatch):
    """The largest call is no larger for a bucket of four times the vectors."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    for n in (100, 200, 400):
        hot = spark.range(n).select(F.col("id").alias("node"), F.lit("1").alias("label"), F.lit(1).cast("long").alias("count"), F.array(F.lit(1.0)).alias("vector"), F.array(F.lit(7), F.col("id").cast("int") + 8).alias("keys"))
        dealt = embedding_dedup.dealt_to_calls(hot).where("key = 7").collect()
        calls: dict[int, list] = {}
        for r in dealt:
            calls.setdefault(r.unit, []).append(r)
        assert max(len(x) for x in calls.values()) <= 2 * 2 * 16
        met = {(a.node, b.node) for call in calls.values() for a in call if a.own == a.first for b in call if b.own == b.second}
        assert all((a, b) in met or (b, a) in met for a in range(n) for b in range(a))


def test_calls_of_many_small_groups_stay_bounded(spark, monkeypatch):
    """Groups whose smallest windows lie at one place are dealt to several calls, each group to one of them."""
    monkeypatch.setattr(substring_dedup, "CALL", 64)
    for n in (100, 400):
        both = F.explode(F.array(F.lit(1), F.lit(2)))
        members = spark.range(n).select(F.col("id").alias("pair"), both.alias("k")).select(
            "pair", F.when(F.col("k") == 1, 0).otherwise(F.col("pair") + 1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"),
            F.expr("shiftleft(1000L, 32)").alias("at"), (F.col("k") == 2).alias("open"),
        )
        left = members.groupBy("pair").agg(
            F.count("*").alias("count"), F.sum(F.col("open").cast("long")).alias("n_open"), F.min(F.struct("doc_id", "tag", "at")).alias("x"),
            F.max(F.when(F.col("open"), F.struct("doc_id", "tag"))).alias("y"),
        )
        dealt = substring_dedup.dealt_to_calls(members, left, 46).groupBy("unit").agg(F.count("*").alias("n"), F.collect_set("pair").alias("pairs")).collect()
        assert sum(r.n for r in dealt) == 3 * n and max(r.n for r in dealt) <= 6 * 64
        assert sorted(p for r in dealt for p in r.pairs) == list(range(n))
