"""Fingerprints, SentencePiece, URL filter, toxicity, quality, substring dedup and packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2
from tokenizers import Tokenizer

import corpus_pipeline
from differential import SMALL, agree
from docketspark.llm import imatch, packing, quality, queries, sentencepiece_numpy, substring_dedup, toxicity, url_filter
from docketspark.llm import words as W

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "words without an id"), (5, "wörd " * 3000), (6, "x" * 30_000), (7, "<|endoftext|> it's 12  \n\n ok")]


def odd(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, lang string, bucket int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.SQL[name])


def test_vectorised_words_equal_split():
    texts = ["", None, "One  two\nTHREE", "x" * 3000 + " y", " a ", "é É"] * 3
    hashes, bounds = W.word_hashes(texts, limit=64)
    known = {}
    for k, text in enumerate(texts):
        own = (text or "").encode().lower().split()
        got = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert len(got) == len(own)
        for word, value in zip(own, got, strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_imatch_of_odd_rows(spark):
    got = imatch.compare_edits(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert imatch.compare_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert imatch.compare_edits(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first().n_chars == 5


def test_imatch_tells_edits_from_other_texts(spark):
    got = imatch.compare_edits(spark.read.parquet(f"{SMALL}/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.1 and got[1] < 0.05


def test_next_document_crosses_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "COARSE", 8)
    monkeypatch.setattr(imatch, "PER_RANGE", 3)
    ids = random.Random(1).sample(range(10_000), 200) + [10**15]
    rows = imatch.with_next(spark.createDataFrame([(x, str(x)) for x in ids], "doc_id long, text string"), lambda x: x, ["text"]).collect()
    order = sorted(ids, reverse=True)
    assert {r.doc_id: int(r.next_text) for r in rows} == dict(zip(order, [*order[1:], order[0]], strict=True))


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def strange_texts():
    rng = random.Random(2)
    made = ["".join(rng.choice("abcd eé\n▁<0x1>日☃ ") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    return [*made, "", " ", "  a  b ", "x" * 2000, "ab" * 400 + " " + "é☃" * 200, "<0x41> <s>", "𝔘𝔫𝔦 日本語", "line\n\nline"]


def test_sentencepiece_merges_equal_the_library():
    made, library = sentencepiece_numpy.Encoder(sentencepiece_numpy.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = strange_texts()
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert made.decode(ids.tolist()) == library.decode(ids.tolist())


def test_sentencepiece_viterbi_equals_the_library():
    model = model_pb2.ModelProto()
    model.ParseFromString(sentencepiece_numpy.load(MODEL))
    model.trainer_spec.model_type = sentencepiece_numpy.UNIGRAM
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)
    data = model.SerializeToString()
    made, library = sentencepiece_numpy.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [x for x in strange_texts() if len(x) < 500]
    assert [x.tolist() for x in made.encode(texts)] == library.encode(texts)


def test_sentencepiece_round_trip(spark):
    both = sentencepiece_numpy.decode(sentencepiece_numpy.encode(odd(spark), MODEL), MODEL).collect()
    assert sorted(str((r.doc_id, r.text)) for r in both) == sorted(str((d, t or "")) for d, t in ODD)
    assert sentencepiece_numpy.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert sentencepiece_numpy.decode(null, MODEL).first().text == ""


URLS = [
    (1, "http://a.NET/x?q", "net/", "block"),
    (2, "https://m.example.net/en/25#t", "example.net/en/", "allow"),
    (3, "http://a.net", None, "allow"),
    (4, "http://notnet/x", None, "allow"),
    (5, "ftp://x.org/fr/://y", "org/fr/", "allow"),
    (6, "no scheme", None, "allow"),
    (7, None, None, "allow"),
    (None, "x://example.com/de/", "example.com/de/", "block"),
    (8, "http://example.com?/de/", None, "allow"),
    (8, "http://net/", "net/", "block"),
]


def test_url_filter(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u, _, _ in URLS], "page_id long, url string, rule string")
    got = url_filter.judge(df, queries.RULES).collect()
    assert sorted(str((r.page_id, r.rule, r.verdict)) for r in got) == sorted(str((k, rule, verdict)) for k, _, rule, verdict in URLS)
    assert {r.verdict for r in url_filter.judge(df, [], default="block").collect()} == {"block"}
    assert url_filter.judge(df.where("false"), queries.RULES).count() == 0
    with pytest.raises(ValueError, match="two verdicts"):
        url_filter.judge(df, [("a", "/", "block"), ("a", "/", "allow")])


def test_digest_array_settles_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    path = str(tmp_path / "digests.bin")
    url_filter.DigestArray.write(path, {"ab": 4, "cd": 5, "efg": 6})
    assert url_filter.DigestArray(path).find([b"cd", b"ab", b"xy", b"efg", b""]).tolist() == [5, 4, -1, 6, -1]


def scored(spark, run):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    return run(docs, labels).where("held_out").join(labels.withColumnsRenamed({"toxic": "y", "quality": "q"}), "doc_id").toPandas()


def test_quality_on_the_held_out_fold(spark):
    got = scored(spark, lambda docs, labels: quality.classify(docs, quality.train(docs, labels)))
    assert (got.predicted == got.q).mean() > 0.95
    assert got.held_out.all() and {zlib.crc32(str(x).encode()) % 5 for x in got.doc_id} == {0}


def test_toxicity_on_the_held_out_fold(spark):
    got = scored(spark, lambda docs, labels: toxicity.grade(docs, toxicity.train(docs, labels)))
    assert got[got.y == 1].severity.mean() > got[got.y == 0].severity.mean() + 0.5
    assert got[got.y == 0].toxic.mean() < 0.1 and got[got.y == 1].toxic.mean() > 0.6
    assert np.allclose(got.severity, got.p_toxic + got.p_severe) and (got.p_toxic >= got.p_severe).all()


def test_classifiers_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for bad in (labels, labels.where("false")):
        one = quality.classify(odd(spark), quality.train(odd(spark), bad)).collect()
        two = toxicity.grade(odd(spark), toxicity.train(odd(spark), bad)).collect()
        assert len(one) == len(two) == len(ODD) and all(0 <= r.score <= 1 for r in one) and all(0 <= r.severity <= 2 for r in two)
    assert quality.classify(odd(spark).where("false"), quality.train(odd(spark), labels)).count() == 0
    assert toxicity.grade(odd(spark).where("false"), toxicity.train(odd(spark), labels)).count() == 0


def test_flat_trees_learn_a_step():
    x = np.random.default_rng(0).uniform(size=(400, 3))
    y = (x[:, 1] > 0.5).astype(float)
    assert ((quality.fit(x, y, rounds=20).score(x) > 0.5) == y).mean() > 0.97


def passages_fixture():
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n)]
    shared, near = text(60), text(80)
    changed = list(near)
    changed[40] = "other"
    rows = [
        (1, [*text(80), *shared, *text(70)]),
        (2, [*text(10), *shared]),
        (3, [*shared, *text(200)]),
        (4, [*text(50), *near, *text(20)]),
        (5, [*text(30), *changed, *text(90)]),
        (6, text(300)),
        (7, [*text(100), *shared[:30], *text(60)]),
    ]
    return shared, changed, rows


def test_passages_are_found_and_nothing_else(spark):
    shared, changed, rows = passages_fixture()
    made = [(d, " ".join(t)) for d, t in rows]
    made += [(8, made[5][1]), (9, "two words"), (10, "Two words")]
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[2].text == " ".join(rows[1][1][:10]) + " " and got[2].others == [1]
    assert got[3].text == " ".join(rows[2][1][60:]) and got[3].n_repeated == 60
    assert got[5].n_repeated == 80 and " ".join(changed) not in got[5].text and got[5].others == [4]
    assert got[8].text == "" and got[8].others == [6]
    for doc in (1, 4, 6, 7, 9, 10):
        assert got[doc].n_repeated == 0 and got[doc].text == dict(made)[doc]


def test_overlapping_excerpts_against_brute_force(spark):
    """A window that the smallest document explains is still a partner for a document that shares more of it."""
    rng, docs, at = random.Random(11), {}, 0
    text = lambda n: ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n)]
    for _ in range(25):
        source = [*text(70), *text(40)]
        docs |= {at: [*text(300), *source[:60], *text(300)], at + 1: source, at + 2: [*text(300), *source[15:70], *text(300)]}
        at += 3
    wanted = {}
    for doc, own in docs.items():
        smaller = {tuple(x[k : k + 50]) for other, x in docs.items() if other < doc for k in range(len(x) - 49)}
        starts = [k for k in range(len(own) - 49) if tuple(own[k : k + 50]) in smaller]
        wanted[doc] = len({k + j for k in starts for j in range(50)})
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_repeated for r in substring_dedup.dedup_passages(rows).collect()} == wanted


def test_compact_windows_against_brute_force():
    runs = W.mix(np.random.default_rng(4).integers(0, 60, 400).astype(np.uint64))
    bounds = np.array([0, 150, 150, 160, 400])
    width = 12
    doc, key, left, centre, right = substring_dedup.windows(runs, bounds, width, 0)
    value = W.mix(runs * (W.numbers(20, 1)[0] | W.U(1)) + W.U(1)) >> W.U(24)
    found = {(d, c): (a, b) for d, a, c, b in zip(doc, left, centre, right, strict=True)}
    for d in range(4):
        own = value[bounds[d] : bounds[d + 1]].tolist()
        wanted = {}
        for c, v in enumerate(own):
            a = max([k + 1 for k in range(c) if own[k] <= v], default=0)
            b = min([k - 1 for k in range(c + 1, len(own)) if own[k] < v], default=len(own) - 1)
            if b - a + 1 >= width:
                wanted[d, c] = (a, b)
        assert {k: v for k, v in found.items() if k[0] == d} == wanted


def test_texts_longer_than_places_reach(monkeypatch):
    """A text with more shingles than a packed place can name is searched in stretches, with the same windows."""
    runs, bounds = W.mix(np.arange(5000).astype(np.uint64)), np.array([0, 4000, 5000])
    whole = substring_dedup.windows(runs, bounds, 46, 0)
    monkeypatch.setattr(substring_dedup, "PLACE_BITS", 8)
    parts = substring_dedup.windows(runs, bounds, 46, 0)
    for k in (0, 2, 3, 4):
        assert np.array_equal(whole[k], parts[k])


def test_passages_of_odd_rows(spark):
    got = substring_dedup.dedup_passages(odd(spark)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((d, t or "")) for d, t in ODD)
    assert substring_dedup.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, capacity):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, TOKENIZER, capacity).collect()
    n = check_packing(rows, texts, capacity)
    assert n <= 1.02 * sum(r.length for r in rows) / capacity + 1


def test_packing_of_odd_rows(spark):
    rows = [(k, t) for k, (d, t) in enumerate(ODD)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    check_packing(got, dict(rows), 1024)
    assert packing.pack(odd(spark), TOKENIZER).where("doc_id = 4").count() == 2
    assert packing.pack(odd(spark).where("false"), TOKENIZER).count() == 0


def test_best_pattern_is_the_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 5)).astype(np.int64)
        prices, most = rng.uniform(0, 1, len(lengths)), rng.integers(1, 4, len(lengths))
        best = max(
            (np.array(x) @ prices for x in np.ndindex(*(most + 1)) if np.array(x) @ lengths <= 40), default=0.0
        )
        pattern = packing.best_pattern(prices, lengths, 40, most)
        assert pattern @ lengths <= 40 and (pattern <= most).all() and abs(pattern @ prices - best) < 1e-9


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(1024, rng.lognormal(5.5, 1, 5000).astype(int) + 1), return_counts=True)
    made = packing.plan(lengths.astype(np.int64), counts.astype(np.int64))
    assert made.sequences <= 1.01 * (lengths @ counts) / 1024 + 1
    for length, count in zip(lengths, counts, strict=True):
        own = made.length == length
        assert sorted(zip(made.first[own], made.last[own], strict=True))[0][0] == 0
        assert (made.last[own] - made.first[own]).sum() == count


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 97 != 5, F.col("text")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    check_packing(packed.collect(), {r.doc_id: r.text for r in docs.collect()}, 1024)
