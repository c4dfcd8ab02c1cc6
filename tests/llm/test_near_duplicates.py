"""Embedding, MinHash and line dedup against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from docketspark.llm import embedding_dedup, line_dedup, minhash_dedup, substring_dedup
from docketspark.llm import words as W
from docketspark.llm.graph import components
from docketspark.llm.line_dedup import CuckooFilter, LineIndex


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union(links, {x for p in links for x in p})


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def near_texts(seed=1):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([3, 8, 40, 120]))
        rows.append((at, " ".join(base)))
        at += 1
        for _ in range(rng.choice([0, 1, 6])):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                other[rng.randrange(len(other))] = rng.choice(["new", "É", base[0]])
            rows.append((at, rng.choice([" ", "\n", " \t "]).join(w.upper() if rng.random() < 0.1 else w for w in other)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n "), (at + 3, "one"), (at + 4, "ONE"), (at + 4, "one"), (None, "one"), (at + 5, "x" * 50_000)]
    return rows


def shingle_set(text, width):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[k : k + width]) for k in range(len(own) - width + 1)) or (frozenset([tuple(own)]) if own else frozenset())


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_against_brute_force(spark, width):
    rows = near_texts(width)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, bucket int")
    got = minhash_dedup.near_duplicates(docs, shingle=width, percent=80).collect()
    assert len(got) == len(rows)
    sets = [(d, shingle_set(t, width)) for d, t in rows if d is not None]
    pairs = [
        (a, b) for k, (a, s) in enumerate(sets) for b, o in sets[:k] if s and o and 100 * len(s & o) >= 80 * len(s | o)
    ]
    wanted = union(pairs, {d for d, _ in sets})
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.component_id == wanted[row.doc_id] and row.kept == (row.doc_id == row.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t, width)) for _, t in rows)


def test_minhash_settles_a_group_without_one_centre(spark):
    """A chain of texts, each near the next but not the rest, is still one component."""
    rng = random.Random(5)
    text, rows = words(rng, 200), []
    for k in range(30):
        rows.append((k, " ".join(text)))
        text = [*text[5:], *words(rng, 5)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_of_an_empty_table(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(3)
    minima = rng.integers(0, 2**63, (1, 96)).astype(np.uint64)
    for changed in (0, 5, 10, 20):
        other = minima.copy()
        other[0, :changed] += np.uint64(1)
        a, b = (minhash_dedup.sketches(x, 512) for x in (minima, other))
        apart = np.array([int(np.unpackbits(a ^ b).sum())])
        assert abs(minhash_dedup.likeness(apart, 512, 96)[0] - (1 - changed / 96)) < 0.05


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(150):
        base = rng.normal(size=24)
        rows.append((3 * k, base, k % 3))
        for j in (1, 2):
            side = rng.normal(size=24)
            side -= side @ base / (base @ base) * base
            cosine = rng.uniform(0.90, 1.0)
            rows.append((3 * k + j, cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side), k % 3))
    rows += [(1000 + k, np.ones(24), 1) for k in range(40)] + [(1100, np.ones(24), 2)]
    plain = [(i, [float(x) for x in v], int(label)) for i, v, label in rows]
    odd = [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] + [0.0] * 23, 1), (2004, [1.0] * 24, None), (2005, [], 1), (2006, [1.0] * 5, 1), (2007, [None] * 24, 1)]
    return plain + odd


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, bucket string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    sound = {
        i: (np.array(v, np.float32).astype(float), label)
        for i, v, label in rows
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    pairs = []
    keys = sorted(sound)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            (x, p), (y, q) = sound[a], sound[b]
            if p == q and len(x) == len(y) and x @ y >= 0.93 * (np.linalg.norm(x) * np.linalg.norm(y)):
                pairs.append((a, b))
    degree = {i: sum(i in p for p in pairs) for i, _, _ in rows}
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found >= 0.99 * 2 * len(pairs)
    assert all(got[i].n_links <= degree[i] for i in got)
    wanted = union(pairs, {i for i, _, _ in rows})
    assert sum(got[i].component_id != wanted[i] for i in got) <= 2
    assert got[1100].n_links == 0 and got[1020].n_links == 39 and got[1020].component_id == 1000


@pytest.mark.parametrize("seed", range(3))
def test_embedding_pairs_count_once_whatever_the_row_order(spark, monkeypatch, seed):
    """Every pair that shares a bucket counts once, where probes are swapped and buckets have several blocks too."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(12, 16))
    made = np.repeat(bases, 12, axis=0) + rng.normal(size=(144, 16)) * 0.15
    order = rng.permutation(len(made))
    rows = [(int(k), [float(x) for x in made[k]], 1) for k in order]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    keys = embedding_dedup.buckets(made / np.sqrt((made * made).sum(axis=1))[:, None], embedding_dedup.TABLES, embedding_dedup.HASHES, embedding_dedup.PROBES)
    norms, pairs = np.sqrt((made * made).sum(axis=1)), []
    for a in range(len(made)):
        for b in range(a):
            if made[a] @ made[b] >= 0.93 * norms[a] * norms[b] and set(keys[a].tolist()) & set(keys[b].tolist()):
                pairs.append((a, b))
    assert {k: got[k].n_links for k in got} == {k: sum(k in p for p in pairs) for k in range(len(made))}
    assert {k: got[k].component_id for k in got} == union(pairs, range(len(made)))


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cuckoo_filter_inserts_finds_and_deletes():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    made = CuckooFilter.holding(keys)
    assert made.contains(keys).all()
    assert made.contains(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 50_000)).mean() < 0.001
    made = CuckooFilter.load(made.dump())
    made.delete(keys[:10_000])
    assert made.contains(keys[10_000:]).all() and made.contains(keys[:10_000]).mean() < 0.01
    assert not CuckooFilter.holding(np.zeros(0, np.int64)).contains(keys[:5]).any()


LINES = [
    (1, "Shared line of more than twenty\nown one\nshort"),
    (2, " shared LINE of more than twenty \t\nshort\nrepeat of one document only\nrepeat of one document only"),
    (3, "x\nShared line of more than twenty\nshort"),
    (4, None),
    (5, ""),
    (6, "é" * 20),
    (7, "É" * 20 + "\n" + "é" * 20),
    (8, "é" * 20 + "\r"),
    (None, "Shared line of more than twenty"),
]


def kept_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(line_dedup.WHITE))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or gone.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_lines_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in LINES], "doc_id long, text string, gone string")
    assert line_rows(line_dedup.dedup_lines(df)) == kept_lines(LINES)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_index_is_reversible(spark):
    schema = "doc_id long, text string"
    whole = spark.createDataFrame(LINES, schema)
    first, rest = (spark.createDataFrame([r for r in LINES if (r[0] or 0) % 2 == k], schema) for k in (1, 0))
    index = LineIndex.over(first).insert(rest)
    assert line_rows(index.apply(whole)) == kept_lines(LINES)
    assert index.insert(rest).postings.count() == index.postings.count()
    less = index.delete(spark.createDataFrame([(3,), (8,)], "doc_id long"))
    left = [r for r in LINES if r[0] not in (3, 8)]
    assert line_rows(less.apply(spark.createDataFrame(left, schema))) == kept_lines(left)
    again = less.insert(spark.createDataFrame([r for r in LINES if r[0] in (3, 8)], schema))
    assert line_rows(again.apply(whole)) == kept_lines(LINES)


def test_clean_lines_keeps_columns(spark):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in LINES], "doc_id long, text string, lang string, source string, n_chars long")
    out = line_dedup.clean_lines(df)
    assert out.columns == df.columns and out.where("doc_id = 1").first().text == "own one\nshort"
    assert out.where("doc_id = 1").first().n_chars == len("own one\nshort")
    assert hashlib.sha256(out.where("doc_id = 3").first().text.encode()).hexdigest() == hashlib.sha256(LINES[2][1].encode()).hexdigest()


def thue_morse(n: int, a: str, b: str) -> list[str]:
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_structured_texts_stay_apart(spark):
    """Words, and sequences of words, whose polynomials agree modulo 2**64 for every base."""
    letters = ["".join(thue_morse(n, *ab)) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    hashes, bounds = W.word_hashes(letters)
    assert len(set(hashes.tolist())) == 6
    sequences = [" ".join(thue_morse(1024, *ab)) for ab in (("one", "two"), ("two", "one"))]
    keys = W.sequence_keys(*W.word_hashes(sequences))
    assert keys[0][0] != keys[0][1] and keys[1][0] != keys[1][1]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string"), shingle=4, percent=80).collect()}
    assert got == {k: k for k in range(6)}


def test_no_structured_text_is_cut_for_another(spark):
    def text(a, b):
        return " ".join("".join(thue_morse(1024, a, b)) + str(k) for k in range(60))

    docs = spark.createDataFrame([(1, text("a", "b")), (2, text("b", "a"))], "doc_id long, text string")
    assert {r.n_repeated for r in substring_dedup.dedup_passages(docs, least=50, shingle=5, similarity=0.8).collect()} == {0}


@pytest.mark.parametrize("texts", [["a"], ["a", "b"], ["a b", None, "c"], [""]])
def test_tables_of_fewer_words_than_a_shingle(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in minhash_dedup.near_duplicates(rows, shingle=4, percent=80).collect()} == set(range(len(texts)))


def test_windows_are_found_once(spark, monkeypatch):
    found, real = spark.sparkContext.accumulator(0), substring_dedup.all_windows

    def counted(docs, *sizes):
        rows = real(docs, *sizes)

        def count(batches):
            for batch in batches:
                found.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    passage = " ".join(f"p{k}" for k in range(80))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(150)) + " " + passage) for k in range(6)], "doc_id long, text string")
    n = real(docs.selectExpr("doc_id", "text", "0L as tag"), 5, 46, 4).count()
    monkeypatch.setattr(substring_dedup, "all_windows", counted)
    got = {r.doc_id: r.n_repeated for r in substring_dedup.dedup_passages(docs, least=50, shingle=5, similarity=0.8).collect()}
    assert got == {k: 80 if k else 0 for k in range(6)}
    assert found.value == n


@pytest.mark.parametrize("seed", range(20))
def test_nearest_smaller_values_against_plain_python(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    key, doc = rng.integers(0, 8, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
    before, behind = substring_dedup.nearest_smaller(key, doc)
    for i in range(n):
        assert before[i] == max((j for j in range(i) if doc[j] == doc[i] and key[j] <= key[i]), default=-1)
        assert behind[i] == min((j for j in range(i + 1, n) if doc[j] == doc[i] and key[j] < key[i]), default=n)


def test_tables_of_windows_are_neither_sorted_nor_left(spark, monkeypatch):
    plans, tables, cut, written = {}, {}, substring_dedup.cut, substring_dedup.written

    def planned(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df)

    def kept(df):
        tables.setdefault(tuple(df.columns[:1]), []).append(out := written(df))
        plans[("written", *df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        out.folders = {x.removeprefix("file://").rpartition("/")[0] for x in out.inputFiles()}
        return out

    monkeypatch.setattr(substring_dedup, "cut", planned)
    monkeypatch.setattr(substring_dedup, "written", kept)
    passage = " ".join(f"p{k}" for k in range(80))
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(150)) + " " + passage) for k in range(6)], "doc_id long, text string")
    assert {r.doc_id: r.n_repeated for r in substring_dedup.dedup_passages(docs).collect()} == {k: 80 if k else 0 for k in range(6)}
    assert "HashAggregate" in plans["pair", "count", "y"] and "SortAggregate" not in plans["pair", "count", "y"]
    for first in (tables[("key",)][0], tables[("pair",)][0]):  # all windows, and all pairs of them
        assert first.folders and not any(Path(x).exists() for x in first.folders)


def test_groups_that_ask(spark):
    rows = [("smallest open", 1, 0, True), ("smallest open", 2, 0, False), ("largest open", 1, 0, False), ("largest open", 2, 0, True), ("largest open", 3, 0, False)]
    rows += [("alone", 1, 0, True), ("alone", 1, 0, True), ("closed", 1, 0, False), ("closed", 2, 0, False), ("two texts", 4, 7, True), ("two texts", 4, 9, True)]
    found = substring_dedup.asking_groups(spark.createDataFrame(rows, "key string, doc_id long, tag long, open boolean"), "key").collect()
    assert {r.key: (r["count"], r.y) for r in found} == {"largest open": (3, 2), "two texts": (2, 4)}


def test_open_pairs_of_windows_against_plain_python(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(400)) for k in range(3)]
    spans = [None, [], [(200, 210), (20, 320), (30, 40)]]
    docs = spark.createDataFrame([(k, 0, texts[k], list(range(0, 400, 5)), spans[k]) for k in range(3)], f"doc_id long, tag long, text string, places array<long>, spans {substring_dedup.SPAN}")
    got = substring_dedup.pairs_of_windows(docs.coalesce(1), 5, 46, 4, np.zeros(0, np.uint64)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and {r.open for r in got if r.doc_id == 2} == {True, False}
    for r in got:
        centre = int(substring_dedup.unpacked(np.array([r["at"]]))[2][0])
        assert r.open == (not any(a <= centre < b for a, b in spans[r.doc_id] or []))


def test_keys_of_whole_texts_and_common_hashes(spark):
    texts = ["One two\x0b three", " one\tTWO  three\n", "one two three four", "onetwo three", "É a", "é a", None, ""]
    keys = substring_dedup.text_keys(spark.createDataFrame([(k, 0, x) for k, x in enumerate(texts)], "doc_id long, tag long, text string")).collect()
    hashes, bounds = W.word_hashes(texts)
    assert [r.n_words for r in sorted(keys)] == np.diff(bounds).tolist()
    wanted = list(zip(*W.sequence_keys(hashes, bounds), strict=True))
    assert [[(a.k1, a.k2) == (b.k1, b.k2) for b in sorted(keys)] for a in sorted(keys)] == [[a == b for b in wanted] for a in wanted]
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        common, values = np.unique(rng.integers(0, 1 << 63, n, np.uint64)), rng.integers(0, 1 << 63, 9000, np.uint64)
        values[:n] = common[: len(values[:n])] if n else values[:0]
        assert (substring_dedup.among(values, common, substring_dedup.marked(common)) == np.isin(values, common)).all()


def test_stretches_with_too_few_matches_hold_no_passage():
    one = np.arange(100, dtype=np.uint64)
    pieces = [one[k : k + 20] for k in (80, 40, 0, 60, 20)]
    assert substring_dedup.passages(one, np.concatenate(pieces), 0.8, 46) == [(0, 100)]  # the whole holds the same set
    apart = [np.concatenate((x, np.arange(1000 + x[0], 1030 + x[0], dtype=np.uint64))) for x in pieces]
    assert substring_dedup.passages(one, np.concatenate(apart), 0.8, 46) == []
    assert substring_dedup.passages(one, one[::2].copy(), 0.8, 46) == []
