"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys shorter than
``min_chars`` code points never count.  :class:`LineIndex` holds three tables:

* ``postings``: every (key, document) once, the exact references;
* ``counts``: a key's number of documents and the largest ``doc_id`` holding it;
* ``filters``: for each shard of the keys a cuckoo filter of the keys with at least ``min_docs`` documents; the number
  of shards follows the number of such keys, so that a filter keeps its size.

Documents are inserted and deleted at any time.  Only keys they touch are counted anew, and only keys that
cross ``min_docs`` enter or leave a filter, so a deletion undoes an insertion exactly.  To decide a document's
lines, its keys are first put to the filters, which let through all repeated keys and about one in eight
thousand of the others; those are settled by the exact counts.

Results for odd input: a null or empty text is one empty line; a document with a null ``doc_id`` holds no
references and loses no line; rows that repeat a ``doc_id`` are one document to the counts and each get its
decisions; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import by_batch, cut, empty, join_checked, join_spread, rewrite, ship

WHITE = " \t\n\x0b\x0c\r"
SLOTS = 4
#: Repeated keys in a shard at most, and postings of a shard that one pass over its filter tests.
SHARD_KEYS, SLICE_ROWS = 1 << 18, 1 << 20
KEY = "h1 long, h2 long"


class FilterFull(Exception):
    """The filter has no room; it must be built anew with more buckets."""


class CuckooFilter:
    """Set of 64-bit keys with deletions, in 16 bits a slot and four slots a bucket; insertions are vectorised."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def holding(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys, at most about 80 % full."""
        buckets = 1 << max(3, int(np.ceil(len(keys) / (0.8 * SLOTS))).bit_length())
        while True:
            try:
                out = cls(buckets)
                out.insert(keys)
                return out
            except FilterFull:
                buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = W.mix(keys.astype(np.uint64))
        return np.maximum(mixed >> W.U(48), W.U(1)).astype(np.uint16), (mixed & self.mask).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (W.mix(prints.astype(np.uint64)) & self.mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        prints, at = self._places(keys)
        for turn in range(500):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = (self.slots[at] == 0).sum(axis=1) if len(at) else rank
            fits = rank < free
            if fits.any():
                slot = np.argsort(self.slots[at[fits]] != 0, axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
                self.slots[at[fits], slot] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if not len(prints):
                return
            if turn:  # push out one resident of each full bucket
                first = np.concatenate(([True], at[1:] != at[:-1]))
                slot = (turn + at[first]) % SLOTS
                out = self.slots[at[first], slot].copy()
                self.slots[at[first], slot] = prints[first]
                prints = np.concatenate([out, prints[~first]])
                at = np.concatenate([at[first], at[~first]])
            at = self._other(prints, at)
        raise FilterFull

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._places(keys)
        other = self._other(prints, at)
        return ((self.slots[at] == prints[:, None]) | (self.slots[other] == prints[:, None])).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted; one slot goes for each key."""
        prints, at = self._places(keys)
        for p, a, b in zip(prints, at, self._other(prints, at), strict=True):
            bucket = a if (self.slots[a] == p).any() else b
            found = np.flatnonzero(self.slots[bucket] == p)
            if len(found):
                self.slots[bucket, found[0]] = 0


def line_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Keys of the lines, as 128-bit digests; empty for lines that never count."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(WHITE)
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else b"")
    return out


def without_lines(text: str | None, drop: list, min_chars: int) -> tuple[str, int]:
    """A text without the lines of some keys, and how many lines went."""
    gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in drop}
    lines = (text or "").split("\n")
    kept = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc_id``: the keys of every document, each once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {key for key in line_keys(text, min_chars) if key}
            keys.extend(own)
            owners.extend([doc] * len(own))
        both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(owners, pa.int64())], ["h1", "h2", "doc_id"])

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batch(plain, work, f"{KEY}, doc_id long")


def counted(rows: DataFrame) -> DataFrame:
    """A key's number of documents and its largest document."""
    return rows.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def shards_for(keys: DataFrame) -> int:
    """So many shards that each holds about ``SHARD_KEYS`` keys: more keys give more shards, not larger ones."""
    return 1 << max(0, (keys.count() - 1) // SHARD_KEYS).bit_length()


@dataclass(frozen=True)
class LineIndex:
    """Postings, exact counts and cuckoo filters; insertions and deletions give a new index."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 3
    min_chars: int = 20

    @classmethod
    def over(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
        """The index of these documents."""
        rows = cut(postings(docs, min_chars))
        counts = cut(counted(rows).where(F.col("n_docs") >= 2))
        keys = counts.where(F.col("n_docs") >= min_docs)
        shards = shards_for(keys)
        return cls(rows, counts, _built(keys, shards), shards, min_docs, min_chars)

    @classmethod
    def blank(cls, spark: SparkSession, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
        return cls.over(empty(spark, "doc_id long, text string"), min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with further documents; documents it has already add nothing."""
        new = cut(postings(docs, self.min_chars).distinct().join(self.postings, ["h1", "h2", "doc_id"], "left_anti"))
        return self._changed(self.postings.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents (a column ``doc_id``)."""
        gone = cut(self.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        return self._changed(self.postings.join(gone, ["h1", "h2", "doc_id"], "left_anti"), gone)

    def _changed(self, rows: DataFrame, touched: DataFrame) -> LineIndex:
        rows = cut(rows.select("h1", "h2", "doc_id"))
        keys = touched.select("h1", "h2").distinct()
        anew = cut(counted(rows.join(keys, ["h1", "h2"], "left_semi")).where(F.col("n_docs") >= 2))
        before = self.counts.join(keys, ["h1", "h2"], "left_semi")
        old, new = (x.where(F.col("n_docs") >= self.min_docs).select("h1", "h2") for x in (before, anew))
        moves = new.join(old, ["h1", "h2"], "left_anti").withColumn("enters", F.lit(True)).unionByName(
            old.join(new, ["h1", "h2"], "left_anti").withColumn("enters", F.lit(False))
        )
        counts = cut(self.counts.join(keys, ["h1", "h2"], "left_anti").unionByName(anew))
        keys = counts.where(F.col("n_docs") >= self.min_docs)
        shards = max(self.shards, shards_for(keys))
        filters = _moved(self.filters, moves, keys, shards) if shards == self.shards else _built(keys, shards)
        return LineIndex(rows, counts, cut(filters), shards, self.min_docs, self.min_chars)

    def drops(self, rows: DataFrame | None = None) -> DataFrame:
        """``doc_id, h1, h2`` of all lines to drop: repeated keys, except in the largest document holding them."""
        rows = (self.postings if rows is None else rows).withColumn("shard", shard(self.shards))
        slices = cut(rows.groupBy("shard").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("n_slices")))  # a row a shard
        asked = join_checked(rows, slices, "shard").select(
            "shard", F.pmod(F.xxhash64("doc_id"), F.col("n_slices")).cast("int").alias("slice"), F.lit(1).alias("turn"), "h1", "h2", "doc_id",
            F.lit(None).cast("binary").alias("cuckoo"),
        )
        nothing = [F.lit(None).cast("long").alias(x) for x in ("h1", "h2", "doc_id")]
        filters = self.filters.join(slices, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"), F.lit(0).alias("turn"), *nothing, "cuckoo"
        )
        # each slice of a shard follows a copy of the shard's filter, so a task holds one filter and one batch of postings
        lined = asked.unionByName(filters).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "turn")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, number = None, None
            for batch in batches:
                turn = batch.column("turn").to_numpy()
                bounds = [*np.flatnonzero(turn == 0).tolist(), batch.num_rows]
                if bounds[0] > 0:
                    bounds = [-1, *bounds]
                for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                    if at >= 0:
                        held, number = CuckooFilter.load(batch.column("cuckoo")[at].as_py()), batch.column("shard")[at].as_py()
                    part = batch.slice(at + 1, end - at - 1)
                    known = part.column("shard").to_numpy() == number if held is not None else np.zeros(part.num_rows, bool)
                    if known.any():  # shards without repeated keys have no filter
                        part = part.filter(pa.array(known)).select(["h1", "h2", "doc_id"])
                        yield part.filter(pa.array(held.contains(part.column("h2").to_numpy())))

        ship(rows.sparkSession)
        maybe = lined.mapInArrow(probe, f"{KEY}, doc_id long")
        sure = self.counts.where(F.col("n_docs") >= self.min_docs)
        counts = sure.withColumnRenamed("n_docs", "count")
        met = join_spread(maybe, sure, ["h1", "h2"], F.col("doc_id"), counts=counts)
        return met.where("doc_id <> last_doc").select("doc_id", "h1", "h2")

    def listed(self, rows: DataFrame | None = None) -> DataFrame:
        """``doc_id, hint``: the keys each document loses."""
        return cut(self.drops(rows)).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hint"))

    def apply(self, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """``doc_id, text, n_lines, n_dropped`` with the dropped lines gone, a row for each row of ``docs``.

        ``rows`` are the documents' postings, for documents that are not in the index.
        """
        listed = self.listed(rows).withColumnRenamed("hint", "gone")
        plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        both = plain.join(listed.hint("merge"), "doc_id", "left")  # hints grow with the corpus, so they are never broadcast
        least = self.min_chars

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = text or ""
                n_lines.append(text.count("\n") + 1)
                text, dropped = without_lines(text, drop, least) if drop else (text, 0)
                texts.append(text)
                n_dropped.append(dropped)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

        return by_batch(both.select("doc_id", "text", "gone"), work, "doc_id long, text string, n_lines long, n_dropped long")


def _built(keys: DataFrame, shards: int) -> DataFrame:
    """``shard, cuckoo`` of these keys; a group holds one shard, so about ``SHARD_KEYS`` keys."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.holding(rows.h2.to_numpy())
        return pd.DataFrame({"shard": rows.shard.iloc[:1].to_numpy(), "cuckoo": [made.dump()]})

    ship(keys.sparkSession)
    return cut(keys.select("h2", shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, cuckoo binary"))


def _moved(filters: DataFrame, moves: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """The filters after keys have entered and left; a shard without room is built anew from the exact counts."""

    def move(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        number = (old if len(old) else rows).shard.iloc[0]
        keys, enters = rows.h2.to_numpy(), rows.enters.to_numpy().astype(bool)
        try:
            made = CuckooFilter.load(old.cuckoo.iloc[0]) if len(old) else CuckooFilter.holding(keys[enters])
            made.delete(keys[~enters])
            if len(old):
                made.insert(keys[enters])
            data = made.dump()
        except FilterFull:
            data = None
        return pd.DataFrame({"shard": [number], "cuckoo": [data]})

    ship(filters.sparkSession)
    rows = moves.select("h2", "enters", shard(shards).alias("shard"))
    out = cut(filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(move, "shard int, cuckoo binary"))
    full = out.where("cuckoo is null").select("shard")
    anew = keys.withColumn("shard", shard(shards)).join(full, "shard", "left_semi")
    return out.where("cuckoo is not null").unionByName(_built(anew, shards))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share from all but the largest ``doc_id`` holding them."""
    return LineIndex.over(docs, min_docs, min_chars).apply(docs)


def clean_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with all their columns, without the lines that :func:`dedup_lines` drops."""
    hints = LineIndex.over(docs, min_docs, min_chars).listed()
    return rewrite(docs, hints, lambda text, drop: without_lines(text, drop, min_chars)[0], ["doc_id"])
