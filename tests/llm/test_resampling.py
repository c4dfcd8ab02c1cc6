"""The interning table, checksums and hashes against libraries, and the draw against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from differential import SMALL
from docketspark.llm import queries, resampling, xxh64

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(1)
TEXTS = ["".join(RNG.choice("ab cdE.é☃ 1") for _ in range(RNG.randint(0, 300))) for _ in range(60)]
TEXTS += ["", None, "x" * 700 + " y " + "z" * 600 + " x y", " a ", "ab " * 500, "wörd " * 90, "ONE two\nThree", "É é"]


def features(text: str | None) -> tuple[list[str], list[str]]:
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("limit", [7, 64, 1 << 18])
def test_buckets_equal_zlib(limit):
    total, n_words, n_features = np.zeros(1000, int), [0] * len(TEXTS), [0] * len(TEXTS)
    for group in resampling.stretches([None if t is None else t.encode() for t in TEXTS], limit):
        grams = resampling.Grams([x[1:] for x in group], 1000)
        total += np.bincount(grams.bucket[grams.used], grams.count[grams.used], 1000).astype(int)
        for (k, _, _), w, f in zip(group, grams.n_words, grams.n_features, strict=True):
            n_words[k] += w
            n_features[k] += f
    wanted = np.zeros(1000, int)
    for text in TEXTS:
        for x in features(text)[1]:
            wanted[zlib.crc32(x.encode()) % 1000] += 1
    assert (total == wanted).all()
    assert n_words == [len(features(t)[0]) for t in TEXTS]
    assert n_features == [len(features(t)[1]) for t in TEXTS]


def test_hashes_equal_the_library():
    data = np.frombuffer(bytes(RNG.randrange(256) for _ in range(3000)), np.uint8)
    starts, lengths = np.array([RNG.randrange(2000) for _ in range(600)]), np.array([RNG.randrange(0, 700) for _ in range(600)])
    got = xxh64.xxh64_spans(data, xxh64.at_every_byte(data), starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def test_colliding_keys_stay_apart(monkeypatch):
    wanted = resampling.Grams([(b"a b c a b d", 0), (b"a b", 0)], 1000)
    monkeypatch.setattr(resampling, "xxh64_spans", lambda data, numbers, starts, lengths: np.full(len(starts), 5, np.uint64))
    got = resampling.Grams([(b"a b c a b d", 0), (b"a b", 0)], 1000)
    assert len(got.used) == len(wanted.used) == 12
    assert sorted(zip(got.bucket[got.used], got.count[got.used], strict=True)) == sorted(zip(wanted.bucket[wanted.used], wanted.count[wanted.used], strict=True))


def plain(docs: list, target: list, buckets: int, percent: int, least: int) -> dict:
    """Every row's features, weight, score and rank, from the contract's formulas."""
    counts = []
    for texts in ([t for _, t in docs], target):
        n = [0] * buckets
        for text in texts:
            for x in features(text)[1]:
                n[zlib.crc32(x.encode()) % buckets] += 1
        counts.append(n)
    s, t = map(sum, counts)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(*counts, strict=True)]
    rows = []
    for doc_id, text in docs:
        words, grams = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in grams)
        rows.append((doc_id, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = [(-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= least]
    drawn = percent * len(fit) // 100
    out = []
    for r in rows:
        rank = 1 + sum(x < (-r[4], r[0] is None, r[0] or 0) for x in fit)
        out.append((r[0], *r[2:], rank if r[1] >= least and rank <= drawn else None))
    return sorted(out, key=str)


def test_draw_equals_plain_python(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([tuple(r) for r in rows], target, 10_000, 5, 20)


@pytest.mark.parametrize("per_range", [1, 7, 1000])
def test_ranges_repeats_and_odd_rows(spark, monkeypatch, per_range):
    monkeypatch.setattr(resampling, "PER_RANGE", per_range)
    monkeypatch.setattr(resampling, "GROUP_BYTES", 256)
    docs = [(k % 50, t) for k, t in enumerate(TEXTS)] + [(7, "same text again " * 9)] * 6 + [(None, "no id " * 30)] * 3
    table = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], "doc_id long, text string, rank string, score int, id int")
    got = resampling.resample(table, spark.createDataFrame([("same text",), (None,)], "text string"), buckets=100, percent=60, least_words=3).drop("n_words").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, ["same text", None], 100, 60, 3)


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r["rank"] for r in resampling.resample(few, none).collect()} == {None}
