"""The classifiers and the whole pipeline against plain Python, columns with the operators' own names, empty stages."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketspark.llm import imatch, line_dedup, minhash_dedup, packing, quality, sentencepiece_numpy, substring_dedup, toxicity
from test_near_duplicates import kept_lines, shingle_set, union, words
from test_texts import ODD, TOKENIZER, check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def walk(model, row):
    total = model.base
    for root in model.roots.tolist():
        at = root
        while model.left[at] != at:
            at = int(model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at])
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk_from_node_to_node():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)).round(1)  # rounded, so that many values lie on a threshold
    y = (x[:, 0] * x[:, 3] + rng.normal(size=600) * 0.3 > 0).astype(float)
    model = quality.fit(x, y, rounds=30)
    assert np.allclose(model.score(x), [walk(model, row) for row in x], rtol=0, atol=1e-12)
    losses = []
    for rounds in (0, 1, 10, 30, 120):  # more trees, less loss on the rows they were fitted to
        p = quality.fit(x, y, rounds=rounds).score(x)
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]


def test_quality_query_equals_a_walk_over_whole_texts(spark):
    rng = random.Random(8)
    good = [(k, ". ".join(" ".join(words(rng, 9)) for _ in range(12))) for k in range(40)]
    bad = [(k, "$$ || ## !! " * rng.randint(3, 40)) for k in range(40, 80)]
    docs = spark.createDataFrame([*good, *bad, (80, None), (81, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    for row in quality.classify(docs, model).collect():
        text = dict([*good, *bad]).get(row.doc_id)
        assert abs(row.score - walk(model, quality.statistics([text])[0])) < 1e-12
        assert row.predicted == int(row.score >= 0.3) and (row.doc_id >= 80 or row.predicted == int(row.doc_id < 40))


def ordinal_sample():
    rng = np.random.default_rng(2)
    terms, cells = np.arange(10, 22, dtype=np.int64), {}
    toxic = (np.arange(300) % 3 == 0).astype(int)
    for k in range(300):
        for slot in rng.choice(terms[4:], 3):
            cells[k, slot] = cells.get((k, slot), 0) + 1
        if toxic[k] and rng.random() < 0.8 or rng.random() < 0.1:
            for slot in rng.choice(terms[:4], rng.integers(1, 5)):
                cells[k, slot] = cells.get((k, slot), 0) + 1
    keys = sorted(cells)
    return terms, toxic, np.array([k for k, _ in keys]), np.array([s for _, s in keys], np.int64), np.array([cells[k] for k in keys], float)


def test_ordinal_fit_is_the_least_of_the_plain_likelihood():
    """Neither a step along a weight or threshold nor random steps improve on the fit, likelihood row by row."""
    terms, toxic, row, slot, count = ordinal_sample()
    marks, penalty = terms[:4], 1e-4
    model = toxicity.fit(row, slot, count, toxic, terms, marks, steps=3000, penalty=penalty)
    own = [{} for _ in toxic]
    for r, s, c in zip(row, slot, count, strict=True):
        own[r][int(s)] = c
    uses = [sum(c for s, c in x.items() if s in marks.tolist()) for x in own]
    middle = np.median([u for u, t in zip(uses, toxic, strict=True) if t])
    grades = [int(t) + int(t and u >= 2 * middle) for t, u in zip(toxic, uses, strict=True)]
    n = Counter(toxic.tolist())

    def loss(weights, low, high):
        total = penalty * sum(abs(w) for w in weights.values())
        for x, t, g in zip(own, toxic, grades, strict=True):
            score = sum(weights.get(s, 0.0) * np.log1p(c) for s, c in x.items())
            above = [1.0, 1 / (1 + np.exp(low - score)), 1 / (1 + np.exp(high - score)), 0.0]
            total -= 0.5 / n[int(t)] * np.log(above[g] - above[g + 1])
        return total

    found = dict(zip(model.terms.tolist(), model.weights.tolist(), strict=True))
    low, high = model.thresholds
    best = loss(found, low, high)
    rng = np.random.default_rng(0)
    for term in terms.tolist():
        for step in (-0.1, 0.1):
            assert loss({**found, term: found.get(term, 0.0) + step}, low, high) > best - 1e-5
    assert all(loss(found, low + a, high + b) > best - 1e-5 for a, b in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1)))
    for _ in range(10):
        moved = {t: found.get(t, 0.0) + 0.05 * rng.normal() for t in terms.tolist()}
        assert loss(moved, low, high) > best - 1e-5


def test_severity_equals_a_sum_over_the_words(spark):
    texts = ["bad word bad", "fine", "", None, "Bad WORSE bad bad " * 50]
    _, slots, _ = toxicity.sparse(texts)
    terms = np.unique(slots)
    model = toxicity.Ordinal(terms, np.linspace(-1, 1, len(terms)), np.array([0.2, 0.9]))
    rows = toxicity.grade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for row in rows:
        _, own, counts = toxicity.sparse([texts[row.doc_id]])
        score = sum(model.weights[int(np.flatnonzero(terms == s)[0])] * np.log1p(c) for s, c in zip(own, counts, strict=True))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert np.isclose(row.p_toxic, above[0]) and np.isclose(row.p_severe, above[1]) and np.isclose(row.severity, sum(above))


CLASH = "kept ids label score spans part rank node tag hint c0 k1 k2 key bucket fingerprint sequence_id others n_words line x".split()


def clashing(df):
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASH])


def settled(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["imatch", "pieces", "minhash", "lines", "passages", "quality", "toxicity"])
def test_columns_with_an_operators_own_names_change_nothing(spark, odd_docs, labels, name):
    tree, ordinal = quality.train(odd_docs, labels), toxicity.train(odd_docs, labels)
    model = public_tokenizers.path("piece_bpe_32k.model") if name == "pieces" else None
    run = {
        "imatch": imatch.compare_edits,
        "pieces": lambda docs: sentencepiece_numpy.encode(docs, model),
        "minhash": minhash_dedup.near_duplicates,
        "lines": line_dedup.dedup_lines,
        "passages": substring_dedup.dedup_passages,
        "quality": lambda docs: quality.classify(docs, tree),
        "toxicity": lambda docs: toxicity.grade(docs, ordinal),
    }[name]
    assert settled(run(clashing(odd_docs))) == settled(run(odd_docs))


def test_packing_with_columns_of_its_own_names(odd_docs):
    rows = [sorted((r.doc_id or 0, r.piece, r.length, r.ids_crc32) for r in packing.pack(df, TOKENIZER).collect()) for df in (odd_docs, clashing(odd_docs))]
    assert rows[0] == rows[1]


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, odd_docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(odd_docs)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert none.columns == out.columns == docs.columns, name
            assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH), name


def without_repeats(texts):
    """Texts without the runs of 50 words that a smaller document holds too, a run going with the space behind it."""
    split, seen, out = {d: [m.span() for m in WORD.finditer(t)] for d, t in texts.items()}, set(), {}
    for doc in sorted(texts):
        text, places = texts[doc], split[doc]
        own = [text[a:b].lower() for a, b in places]
        runs = [tuple(own[k : k + 50]) for k in range(len(own) - 49)]
        gone = {k + j for k, run in enumerate(runs) if run in seen for j in range(50)}
        seen.update(runs)
        ends = [*[a for a, _ in places[1:]], len(text)]
        out[doc] = text[: places[0][0] if places else None] + "".join(text[a:b] for k, ((a, _), b) in enumerate(zip(places, ends, strict=True)) if k not in gone)
    return out


def pipeline_documents():
    rng, texts = random.Random(21), {}
    body = lambda n: "\n".join(" ".join(words(rng, 8)) for _ in range(n))
    for k in range(60):
        texts[k] = body(rng.randint(4, 30))
    line, passage = " ".join(words(rng, 9)), " ".join(words(rng, 70))
    for k in (3, 9, 27, 41):
        texts[k] += f"\n {line.upper()}\t\n" + body(2)
    for k in (5, 15, 25):
        texts[k] = f"{body(6)} {passage} {body(5)}"
    texts |= {100: texts[7], 101: texts[8] + " tail", 102: texts[11].replace(" ", "  "), 103: body(400)}
    texts |= {200 + k: "$$ || ## !! " * (20 + k) for k in range(30)}
    return texts


def test_pipeline_against_plain_python(spark, tmp_path):
    """The scores are taken as given; all that follows is done again by hand, and the packed ids must be those texts'."""
    texts = pipeline_documents()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 200)) for d in texts], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, given = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in quality.classify(docs, quality.train(docs, given)).collect()}
    kept = {d: t for d, t in texts.items() if scores[d] >= 0.3}
    assert set(kept) == {d for d in texts if d < 200}
    kept = {d: t for d, _, _, t in kept_lines(list(kept.items()))}
    sets = [(d, shingle_set(t, 5)) for d, t in sorted(kept.items())]
    pairs = [(a, b) for k, (a, s) in enumerate(sets) for b, o in sets[:k] if s and o and 100 * len(s & o) >= 80 * len(s | o)]
    first = union(pairs, set(kept))
    kept = without_repeats({d: t for d, t in kept.items() if first[d] == d})
    assert not {100, 101, 102} & set(kept) and 103 in kept
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_packing(rows, kept, 1024)
