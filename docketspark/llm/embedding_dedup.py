"""Embedding near-dedup by cross-polytope hashing with multiprobe buckets and verified pairs.

Vectors that are equal in every component, with equal labels, form a class whose smallest ``vec_id`` stands for
all, so copies cost one row.  Each class vector is turned by pseudo-random rotations (sign flips and a fast
Hadamard transform, three times over); its hash is the coordinate of largest magnitude with its sign.  A table's
bucket joins ``hashes`` such values, and every vector also enters the buckets of its next most likely values
(multiprobe).  Vectors of one label that share a bucket are candidates; a large bucket is worked on in blocks of
bounded size, each a call of its own, every block meeting every other once, and a pair only counts in one bucket that both share, the one
with the smallest key.

A block verifies its pairs by cosine in double precision, on vectors scaled by their largest component, and returns,
not the pairs, but what is needed of them: for every vector the number of vectors linked to it (classes counted in
full) and a spanning forest of its links.  So neither a bucket's pairs nor a group's copies are ever written out.
Vectors move once: each is dealt to its buckets' blocks, in the precision in which the table holds it.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label or id, are linked with nothing (``component_id`` is their own ``vec_id``); vectors of different
lengths are never compared; very large and very small components are compared like others; rows that repeat a
``vec_id`` count as vectors of their own, with their own links; other columns are left alone; an empty table gives an
empty result.  Classes are told apart by 96 bits of hashes: of n different vectors two are taken as equal with a
chance of about n**2 / 2**97.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .graph import lowest, named
from .shared import by_batch, cut, join_checked, join_spread, node, ship, tagged

#: Tables, hash values joined in a bucket, and buckets a vector enters in each table.
TABLES, HASHES, PROBES = 6, 2, 3
#: Vectors that one block holds at most on each side, candidate pairs of small buckets and shared keys worked on at once.
BLOCK, CHUNK = 1024, 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, half = x.shape[1], 1
    while half < width:
        y = x.reshape(len(x), -1, 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket keys of 32 bits, ``tables * probes`` for each vector; a table's probes are adjacent."""
    width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    base = np.zeros((len(vectors), width))
    base[:, : vectors.shape[1]] = vectors
    out = np.zeros((len(vectors), tables, probes), np.uint64)
    rows = np.arange(len(vectors))
    for t in range(tables):
        firsts, seconds, gaps = [], [], []
        for h in range(hashes):
            x = base
            for turn in range(3):
                signs = W.numbers(1000 + (t * hashes + h) * 3 + turn, width) >> W.U(63)
                x = hadamard(x * np.where(signs == 1, 1.0, -1.0))
            order = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            top = np.take_along_axis(np.abs(x), order, 1)
            order = np.where((top[:, :1] >= top[:, 1:]), order, order[:, ::-1])
            value = 2 * order + (np.take_along_axis(x, order, 1) < 0)
            firsts.append(value[:, 0].astype(np.uint64))
            seconds.append(value[:, 1].astype(np.uint64))
            gaps.append(np.abs(top[:, 0] - top[:, 1]))

        def key(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            total = np.full(len(vectors), t + 1, np.uint64)
            for part in parts:
                total = W.mix(total * W.U(0x9E3779B97F4A7C15) + part)
            return total

        out[:, t, 0] = key(firsts)
        nearest = np.argsort(np.stack(gaps, axis=1), axis=1)  # the hash whose runner-up comes closest is changed first
        for p in range(1, probes):
            parts = []
            for h in range(hashes):
                change = nearest[:, p - 1] == h if p <= hashes else np.ones(len(rows), bool)
                parts.append(np.where(change, seconds[h], firsts[h]))
            out[:, t, p] = key(parts)
    return (out.reshape(len(vectors), tables * probes) >> np.uint64(33)).astype(np.int32)


def settled_pairs(keys_a: np.ndarray, keys_b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each pair shares no key below its bucket's; every row of ``keys_a`` and ``keys_b`` is one pair."""
    shared = (keys_a[:, :, None] == keys_b[:, None, :]).any(axis=2)
    return np.where(shared, keys_a, np.iinfo(np.int32).max).min(axis=1) == bucket


def settled_block(keys_a: np.ndarray, keys_b: np.ndarray, bucket: int) -> np.ndarray:
    """The same for all pairs of two sides of one bucket, as a matrix."""
    out = np.zeros((len(keys_a), len(keys_b)), np.float32)
    known = np.intersect1d(keys_a[keys_a < bucket], keys_b[keys_b < bucket])
    for at in range(0, len(known), 2048):
        some = known[at : at + 2048]
        sides = []
        for keys in (keys_a, keys_b):
            place = np.minimum(np.searchsorted(some, keys), len(some) - 1)
            rows, columns = np.nonzero(some[place] == keys)
            side = np.zeros((len(keys), len(some)), np.float32)
            side[rows, place[rows, columns]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out == 0


def unit_vectors(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which vectors, and those scaled to norm 1 in double precision, whatever their magnitude."""
    flat, sizes, out = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(), {}
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        these = np.flatnonzero(sizes == size)
        x = flat[starts[these][:, None] + np.arange(size)].astype(float)
        x /= np.abs(x).max(axis=1)[:, None]
        out[int(size)] = these, x / np.sqrt((x * x).sum(axis=1))[:, None]
    return out


def verify_unit(table: pa.Table, least: float) -> pa.Table:
    """Link counts and spanning links of some blocks: ``a, b, n``, with n = 0 for a link and a = b for a count."""
    bucket, first, second, own, ids, copies = (table.column(x).to_numpy() for x in ("bucket", "first", "second", "own", "node", "copies"))
    key = table.column("key").to_numpy()
    lists = table.column("keys").combine_chunks()
    all_keys = lists.flatten().to_numpy().reshape(len(ids), -1)
    vectors = table.column("vector").combine_chunks()
    counts = np.zeros(len(ids), np.int64)
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def contract(a: np.ndarray, b: np.ndarray) -> None:
        """Keep of some pairs one link a vector, at once, so that a call never holds the pairs of several blocks."""
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = lowest(at[: len(a)], at[len(a) :], len(nodes))
        tied = np.flatnonzero(low != np.arange(len(nodes)))
        links.append((nodes[tied], nodes[low[tied]]))

    for these, x in unit_vectors(vectors).values():
        order = np.lexsort((second[these], first[these], bucket[these]))
        rows = these[order]
        change = (bucket[rows][1:] != bucket[rows][:-1]) | (first[rows][1:] != first[rows][:-1]) | (second[rows][1:] != second[rows][:-1])
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [len(rows)]))
        sizes = np.diff(bounds)
        few = np.flatnonzero((sizes > 1) & (sizes <= 64) & (first[rows[bounds[:-1]]] == second[rows[bounds[:-1]]]))
        # small buckets: their pairs are laid out and worked on together, some at a time
        spread = sizes[few] * (sizes[few] - 1) // 2
        at = 0
        while at < len(few):
            end = max(at + 1, int(np.searchsorted(np.cumsum(spread[at:]), CHUNK, "right")) + at)
            group, n = few[at:end], sizes[few[at:end]]
            side = np.concatenate([np.arange(k) for k in n])
            later = np.repeat(n, n) - side - 1
            i = np.repeat(np.repeat(bounds[group], n) + side, later)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
            near = np.einsum("ij,ij->i", x[order[i]], x[order[j]]) >= least
            a, b = rows[i[near]], rows[j[near]]
            good = settled_pairs(all_keys[a], all_keys[b], key[a])
            a, b = a[good], b[good]
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
            contract(a, b)
            at = end
        for g in np.setdiff1d(np.flatnonzero(sizes > 1), few):
            part = np.arange(bounds[g], bounds[g + 1])
            one, two = first[rows[part[0]]], second[rows[part[0]]]
            left, right = (part[own[rows[part]] == k] for k in (one, two))
            near = x[order[left]] @ x[order[right]].T >= least
            near = np.triu(near, 1) if one == two else near
            near &= settled_block(all_keys[rows[left]], all_keys[rows[right]], key[rows[part[0]]])
            np.add.at(counts, rows[left], near @ copies[rows[right]])
            np.add.at(counts, rows[right], near.T @ copies[rows[left]])
            i, j = np.nonzero(near)
            contract(rows[left[i]], rows[right[j]])
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
    low = lowest(a, b, len(ids))
    tied, touched = np.flatnonzero(low != np.arange(len(ids))), np.flatnonzero(counts)
    n = np.concatenate([np.zeros(len(tied), np.int64), counts[touched]])
    return pa.table({"a": np.concatenate([ids[tied], ids[touched]]), "b": np.concatenate([ids[low[tied]], ids[touched]]), "n": n})


def dealt_to_calls(classes: DataFrame) -> DataFrame:
    """A row for each vector of ``classes`` and each block that it enters, with ``unit``, the call that works on it.

    A call holds the two sides of one block of a large bucket, or small buckets of about four blocks' vectors, so its
    rows don't grow with the largest bucket.
    """
    bucket = F.xxhash64("label", "key").alias("bucket")
    entered = classes.select("node", "label", F.explode(F.array_distinct("keys")).alias("key")).select(bucket)
    sizes = cut(entered.groupBy("bucket").count().where("count > 1"))
    large = cut(sizes.where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("n_blocks")))
    shared = sizes.where(F.col("count") <= BLOCK).agg(F.sum("count")).first()[0] or 0
    full = classes.select("node", F.col("count").alias("copies"), "vector", "keys", "label", F.explode(F.array_distinct("keys")).alias("key"))
    full = full.select("node", "copies", "vector", "keys", "key", bucket)
    dealt = join_checked(full, large, "bucket", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "bucket", "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "node", "copies", "vector", "keys", "n_blocks"
    )
    # small buckets share calls of about four blocks; each block of a large bucket is a call of its own
    few = F.pmod("bucket", F.lit(1 + shared // (4 * BLOCK)))
    return spread.withColumn("unit", F.when(F.col("n_blocks") > 1, F.xxhash64("bucket", "first", "second")).otherwise(few)).drop("n_blocks")


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``vectors (vec_id, embedding, label)``."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "array<float>" if single else "array<double>"
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("vector"), F.col("label").cast("string"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = tagged(plain.withColumn("sound", sound), "vec_id", F.struct("vector", "label")).withColumn("node", node("vec_id"))
    marked = marked.withColumns({"class": F.xxhash64("vector", "label"), "class2": F.hash("vector", "label")})
    classes = (
        marked.where("sound")
        .groupBy("class", "class2")
        .agg(F.min(F.struct("vec_id", "node", "label", "vector")).alias("one"), F.count("*").alias("count"))
        .select("class", "class2", "one.*", "count")
    )

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.zeros((batch.num_rows, tables * probes), np.int32)
        for these, x in unit_vectors(batch.column("vector")).values():
            keys[these] = buckets(x, tables, hashes, probes)
        offsets = pa.array(np.arange(0, keys.size + 1, tables * probes), pa.int32())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], [*batch.schema.names, "keys"])

    classes = cut(by_batch(classes, hashed, f"class long, class2 int, vec_id long, node long, label string, vector {kind}, count long, keys array<int>"))
    ship(vectors.sparkSession)
    settled = cut(
        dealt_to_calls(classes).groupBy("unit").applyInArrow(
            lambda table: verify_unit(table, least), "a long, b long, n long"
        )
    )
    linked = settled.where("n > 0").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    heads = classes.select("class", "class2", "count", F.col("vec_id").alias("id"), "node").join(linked, "node", "left")
    heads = named(heads, settled.where("a <> b").select("a", "b"))
    per_class = heads.select("class", "class2", "count", (F.col("count") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.col("first.id").alias("component"))
    apart = marked.select("vec_id", "class", "class2", "sound")
    found = join_spread(apart.where("sound"), per_class.drop("count"), ["class", "class2"], F.col("vec_id"), counts=per_class)
    alone = apart.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.select(
        "vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("component") == F.col("vec_id")).alias("kept")
    ).unionByName(alone)
