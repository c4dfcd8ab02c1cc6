"""MinHash near-dedup: banded MinHash finds candidates, odd sketches sift them, full sets confirm them.

Documents with the same word sequence form a class and only its smallest ``doc_id`` takes part in the search,
so thousands of exact copies cost one row.  Each class has ``bands * rows`` MinHash samples.  A band's samples
make its bucket key; the samples are also folded into an odd sketch, a bitmap in which every sample flips one
bit, so the population count of two sketches' XOR estimates their Jaccard similarity, precisely so where it is
high.  Pairs whose estimate is far below the threshold are set aside; all others are confirmed on the full
shingle sets.

A bucket never yields all its pairs.  It links its members to one centre, the confirmed links are contracted to
components, and only buckets that still hold several components go on: all pairs of members of different
components are compared on their full sets in blocks of bounded size, each of which returns no more links than it
joins components.  Every bucket so ends either in one component or with all
pairs between its components checked, which gives the components of all links in it.

Shingles and classes are told apart by 64-bit and 128-bit hashes: of n different ones two are alike with a chance
of about n**2 / 2**65 and n**2 / 2**129, in one pair of documents of 100,000 shingles each 1e-9.

Results for odd input: a null or blank text has an empty set and is linked with nothing; a null ``doc_id`` is
linked with nothing, has a null ``component_id`` and is kept; rows that repeat a ``doc_id`` with one text are one
document, with different texts each is a document of its own with its own links; other columns are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components, named
from .shared import by_batch, cut, join_checked, join_spread, node, numbered, plain_texts, ship

#: With 24 bands of 4 a pair of similarity 0.8 is missed three times in a million.
BANDS, ROWS, SKETCH_BITS = 24, 4, 512
#: Standard errors below the threshold at which a sketch's estimate sets a pair aside.
SLACK = 5.0
#: Orders that pick the buckets' centres: a group that meets in every bucket gets so many centres.
CENTRES = 4
#: Documents and bytes of sets that one block holds at most on each side (one larger set is a block of its own).
BLOCK, BLOCK_BYTES = 800, 32 << 20


def samples(runs: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """MinHash samples, one row for each text; texts without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    multipliers, adders = W.numbers(11, n) | W.U(1), W.numbers(12, n)
    at = 0
    while at < len(full):  # groups of texts that fit in the processor's cache
        end = max(at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[at]] + 32_768, "right")))
        first, last = bounds[full[at]], bounds[full[end - 1] + 1]
        starts, values = bounds[full[at:end]] - first, runs[first:last]
        for k in range(n):
            out[full[at:end], k] = np.minimum.reduceat(values * multipliers[k] + adders[k], starts)
        at = end
    return out


def sketches(minima: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches: each sample, with its number, flips one bit."""
    place = W.mix(minima + W.numbers(13, minima.shape[1])) % W.U(bits)
    flips = np.zeros((len(minima), bits), np.uint8)
    np.add.at(flips, (np.repeat(np.arange(len(minima)), minima.shape[1]), place.ravel().astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1)


def likeness(different_bits: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Jaccard similarity that an odd sketch of ``n`` samples estimates from the bits in which two sketches differ."""
    left = np.maximum(1 - 2 * different_bits / bits, 1 / bits)
    return 1 + bits / (4 * n) * np.log(left)


def features(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``doc_id, node, k1, k2`` (the word sequence), ``n_shingles, bands, sketch`` of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = W.word_hashes(batch.column("text").to_pylist())
        k1, k2 = W.sequence_keys(hashes, bounds)
        runs, ends = W.shingles(hashes, bounds, shingle)
        sizes = [len(np.unique(runs[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        minima = samples(runs, ends, bands * rows)
        keys = np.zeros((len(minima), bands), np.uint64)
        for b in range(bands):
            part = minima[:, b * rows : (b + 1) * rows]
            keys[:, b] = W.mix((part * (W.numbers(14, rows) | W.U(1))).sum(axis=1, dtype=W.U) + W.U(b + 1))
        odd = sketches(minima, bits)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("node"),
                pa.array(W.signed(k1)),
                pa.array(W.signed(k2)),
                pa.array(np.array(sizes, np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(W.signed(keys).ravel())),
                pa.array([x.tobytes() for x in odd], pa.binary()),
            ],
            ["doc_id", "node", "k1", "k2", "n_shingles", "bands", "sketch"],
        )

    return by_batch(docs, work, "doc_id long, node long, k1 long, k2 long, n_shingles long, bands array<long>, sketch binary")


def sift(pairs: DataFrame, marks: DataFrame, bits: int, n: int, percent: int) -> DataFrame:
    """Pairs (member, centre) whose odd sketches don't rule out the threshold."""
    least = percent / 100
    floor = least - SLACK * (least * (1 - least) / n) ** 0.5
    most = max(d for d in range(bits) if likeness(np.array([d]), bits, n)[0] >= floor)
    longs = [f"conv(hex(substring(sketch, {8 * k + 1}, 8)), 16, -10)" for k in range(bits // 64)]
    marks = marks.select("node", F.array(*[F.expr(f"cast({x} as bigint)") for x in longs]).alias("sketch"))
    joined = pairs.join(marks.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    joined = join_spread(joined, marks.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b", F.col("a"), counts=pairs.groupBy("b").count())
    apart = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(bits // 64)), F.lit(0))
    return joined.where(apart <= most).select("a", "b")


def packed_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, items``: the full shingle sets of the wanted documents."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = W.word_hashes(batch.column("text").to_pylist())
        runs, ends = W.shingles(hashes, bounds, shingle)
        packed = [W.pack(runs[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "items"])

    return by_batch(join_checked(docs.select("node", "text"), wanted, "node", "left_semi"), sets, "node long, items binary")


def confirm(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full shingle sets have ``100 * intersection >= percent * union``.

    ``b`` is a centre, which may have very many partners; its set is then copied to several tasks.
    """

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            one, two = W.unpack(x), W.unpack(y)
            both = len(np.intersect1d(one, two, assume_unique=True))
            good.append(100 * both >= percent * (len(one) + len(two) - both))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    items = packed_sets(docs, cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), shingle)
    items = items.dropDuplicates(["node"])  # rows that repeat a document
    one = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = join_spread(one, items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b", F.col("a"), counts=pairs.groupBy("b").count())
    return by_batch(both.select("a", "b", "x", "y"), compare, "a long, b long").distinct()


def units(open_rows: DataFrame) -> DataFrame:
    """``unit, node, component, n_shingles``: what is still to be compared, with no pair lost and few met twice.

    Open buckets that have their smallest component in common make one unit, so a group that meets in every band is
    compared once.  A component is in at most ``bands`` buckets for each of its documents, which bounds a unit.
    """
    low = open_rows.groupBy("bucket").agg(F.min("component").alias("unit"), F.count("*").alias("count"))
    met = join_spread(open_rows, low.drop("count"), "bucket", F.col("node"), counts=low)
    return met.select("unit", "node", "component", "n_shingles").distinct()


def settle(docs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the components of each unit, from all pairs of different components.

    ``members (unit, node, component, n_shingles)``: those outside a unit's largest component are compared with all,
    on full sets, in blocks of bounded size; a block returns a spanning set of its links.
    """
    held = F.sum(F.col("n_shingles") * 8)
    sizes = members.groupBy("unit", "component").agg(F.count("*").alias("m"), held.alias("bytes"))
    total = sizes.groupBy("unit").agg(
        F.max(F.struct("m", "bytes", "component")).alias("top"), F.sum("m").alias("count"), F.sum("bytes").alias("bytes")
    )
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_BYTES)).cast("int")
    sizes = cut(
        total.select(
            "unit",
            "count",
            F.col("top.component").alias("main"),
            blocks(F.col("count"), F.col("bytes")).alias("n_members"),
            blocks(F.col("count") - F.col("top.m"), F.col("bytes") - F.col("top.bytes")).alias("n_others"),
        )
    )
    known = cut(join_spread(members, sizes.drop("count"), "unit", F.col("node"), counts=sizes))
    spot = F.xxhash64("node")
    everyone = known.select(
        "unit", "node", "component", F.lit(False).alias("other"), F.pmod(spot, F.col("n_members")).cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.col("n_others") - 1)).alias("column"),
    )
    others = known.where("component <> main").select(
        "unit", "node", "component", F.lit(True).alias("other"), F.explode(F.sequence(F.lit(0), F.col("n_members") - 1)).alias("row"),
        F.pmod(spot, F.col("n_others")).cast("int").alias("column"),
    )
    items = packed_sets(docs, cut(known.select("node").distinct()), shingle).dropDuplicates(["node"])
    ship(docs.sparkSession)
    dealt = everyone.unionByName(others).join(items, "node")

    def work(key, rows):
        other = rows.column("other").to_numpy(zero_copy_only=False)
        ids, parts = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        sets = [W.unpack(x) for x in rows.column("items").to_pylist()]
        left, right = np.flatnonzero(~other), np.flatnonzero(other)
        edges = []
        if len(left) and len(right):
            a, b = np.concatenate([sets[k] for k in left]), np.concatenate([sets[k] for k in right])
            a_doc, b_doc = (np.repeat(np.arange(len(x)), [len(sets[k]) for k in x]) for x in (left, right))
            shared = np.intersect1d(a, b)
            both = np.zeros((len(left), len(right)), np.float32)
            a_at, b_at = np.searchsorted(shared, a), np.searchsorted(shared, b)
            a_in, b_in = (np.append(shared, 0)[at] == x if len(shared) else np.zeros(len(x), bool) for at, x in ((a_at, a), (b_at, b)))
            a_at, a_doc, b_at, b_doc = a_at[a_in], a_doc[a_in], b_at[b_in], b_doc[b_in]
            for low in range(0, len(shared), 4096):
                x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
                here = (a_at >= low) & (a_at < low + 4096)
                x[a_doc[here], a_at[here] - low] = 1
                here = (b_at >= low) & (b_at < low + 4096)
                y[b_doc[here], b_at[here] - low] = 1
                both += x @ y.T
            n = np.array([len(x) for x in sets])
            linked = 100 * both.astype(np.int64) >= percent * (n[left][:, None] + n[right][None, :] - both.astype(np.int64))
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            i, j = np.nonzero(linked & (parts[left][:, None] != parts[right][None, :]))
            names, at = np.unique(parts, return_inverse=True)
            _, first = np.unique(at[left[i]] * len(names) + at[right[j]], return_index=True)  # one link for two components
            for i, j in zip(left[i[first]], right[j[first]], strict=True):
                p, q = root(int(parts[i])), root(int(parts[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return dealt.groupBy("unit", "row", "column").applyInArrow(work, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, node, stays``, a row for each row of ``docs (doc_id, text)``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``shingle``-word runs;
    ``component_id`` is the smallest ``doc_id`` that links reach.  ``node`` is the ``doc_id``, but a hash
    where a ``doc_id`` has several texts; ``stays`` marks the one text of each component that stays.
    """
    n = bands * rows
    plain = plain_texts(docs).withColumn("node", node("doc_id"))
    marks = cut(features(plain, shingle, bands, rows, bits))
    classes = (
        marks.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "node", "n_shingles", "bands", "sketch")).alias("one"), F.count("*").alias("count"))
        .select("k1", "k2", "one.*", "count")
    )
    classes = cut(classes)
    buckets = classes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    sizes = cut(buckets.groupBy("bucket").count().where("count > 1"))
    buckets = cut(join_spread(buckets, sizes.select("bucket"), "bucket", F.col("node"), "left_semi", sizes))
    order = F.xxhash64("node", F.pmod(F.col("band"), F.lit(CENTRES)))
    centres = buckets.groupBy("bucket").agg(F.min_by("node", F.struct(order, "node")).alias("centre"))
    pairs = join_spread(buckets, centres, "bucket", F.col("node"), counts=sizes).where("node <> centre")
    pairs = pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = cut(confirm(plain, cut(sift(pairs, classes.select("node", "sketch"), bits, n, percent)), shingle, percent))
    found = cut(components(links))
    open_rows = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = open_rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    open_rows = cut(join_spread(open_rows, several.select("bucket"), "bucket", F.col("node"), "left_semi", sizes))
    if not open_rows.isEmpty():
        links = cut(links.union(settle(plain, cut(units(open_rows)), shingle, percent)))
    heads = named(classes.select("k1", "k2", "count", "node", F.col("doc_id").alias("id")), links)
    met = join_spread(marks, heads.select("k1", "k2", "first"), ["k1", "k2"], F.col("doc_id"), "left", heads)
    own = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("doc_id"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return met.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        (F.col("doc_id").isNull() | (own == F.col("doc_id"))).alias("kept"),
        "node",
        (alone | (F.col("first.node") == F.col("node"))).alias("stays"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those linked to a smaller document, with all their columns.

    Of rows with one ``doc_id`` and different texts, only those whose own text is linked to another go.
    """
    gone = cut(near_duplicates(docs, shingle, percent).where("not stays").select("node").distinct())
    left = join_checked(numbered(docs).withColumn("node", node("doc_id")), gone, "node", "left_anti")
    return left.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)
