"""Target-distribution importance resampling on hashed n-grams.

Features are the runs of one to three words of a text.  Each falls into a bucket by its CRC-32; a bucket's gain says how
much commoner it is in the target texts than in the corpus, and a document's weight is the sum of the gains of its
features.  Documents are drawn without replacement by the highest weight plus a Gumbel number of their id.

Both passes over the corpus (counting, weighing) intern the n-grams of a group of texts in :class:`Grams`, an
open-addressed numpy table: a key is the xxhash64 of the n-gram's bytes, and a slot is shared only after the bytes
themselves are compared, so that a collision of keys never merges two n-grams.  A slot stores the bucket and the count;
every occurrence keeps its slot's number and gathers the gain through it.  CRC-32 is computed once for each slot, from
the checksums of the words (appending a word is linear in the checksum before it).

What moves is small: each task sends at most one count for each bucket, the driver holds ``buckets`` sums, and the
ranking works on rows of a few numbers.  Only rows that can be drawn are ranked: boundaries from quantiles split them by
score into ranges of about ``PER_RANGE`` rows, the counts of the ranges give every range its first rank, and a window
ranks each range by itself, so nothing is sorted in one task.

Results for odd input: a null or empty text has no features, weight 0 and is never drawn; a null ``doc_id`` counts as
the text ``""`` in its Gumbel number and comes last among equal scores; rows that repeat a ``doc_id`` are documents of
their own, and those of equal score share the smallest of their ranks and are drawn together; very long texts are taken
in stretches of about ``GROUP_BYTES`` that overlap by two words; an empty target gives every bucket its smoothed gain,
an empty table an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_batch, ship, slices, written
from .xxh64 import LONG, at_every_byte, xxh64_spans

U = np.uint64
ORDERS = 3
#: Texts are worked on in groups of about so many bytes, so that the table stays in a core's cache.
GROUP_BYTES = 1 << 18
#: Rows that one task ranks, about; and the most ranges.
PER_RANGE, MOST_RANGES = 100_000, 1000
# Fixed value: the reflected polynomial of CRC-32.
CRC_POLYNOMIAL = 0xEDB88320

#: What every byte becomes: digits and letters stay, A-Z are lower-cased, bytes of other code points stay, the rest parts words.
FOLD = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _byte_steps() -> np.ndarray:
    """What one zero byte behind it makes of a checksum's lowest byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC_POLYNOMIAL), step >> 1).astype(np.uint32)
    return step


def _zero_bytes(most: int, step: np.ndarray) -> np.ndarray:
    """At ``1024 n + 256 place + byte``: what ``n`` zero bytes behind it make of a checksum's byte at each place."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(most):
        now = (now >> 8) ^ step[now & 255]
        out.append(now)
    return np.stack(out).ravel()


STEP = _byte_steps()
MOST_SHIFT = 64
SHIFTS = _zero_bytes(MOST_SHIFT, STEP)


def crc_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of many short spans, a byte of all of them at a time."""
    order = np.argsort(-lengths.astype(np.int32), kind="stable")
    at, n = starts[order], lengths[order]
    value = np.full(len(at), 0xFFFFFFFF, np.uint32)
    reach = len(at) - np.cumsum(np.bincount(n, minlength=1))  # how many are longer than 0, 1, 2, ...
    for k, most in enumerate(reach[:-1].tolist()):
        own = value[:most]
        value[:most] = STEP.take((own ^ data[at[:most] + k]) & 255) ^ (own >> 8)
    out = np.empty_like(value)
    out[order] = ~value
    return out


def crc_shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of ``crc`` in the checksum of its bytes and ``lengths`` more; that of the further bytes is added by xor."""
    n = np.minimum(lengths, MOST_SHIFT)
    at = n << 10
    out = SHIFTS.take(at + (crc & 255)) ^ SHIFTS.take(at + (256 + ((crc >> 8) & 255))) ^ SHIFTS.take(at + (512 + ((crc >> 16) & 255))) ^ SHIFTS.take(at + (768 + (crc >> 24)))
    if len(more := np.flatnonzero(lengths > n)):
        out[more] = crc_shift(out[more], lengths[more] - n[more])
    return out


class Grams:
    """The n-grams of a group of texts, interned; ``slots`` holds the slot of every occurrence, ``owners`` its stretch.

    ``stretches`` are byte strings, each with how many of its first words only lead in: an n-gram counts where its last
    word is behind them.  ``n_words`` and ``n_features`` have a number for each stretch.
    """

    def __init__(self, stretches: list[tuple[bytes, int]], buckets: int):
        raw = np.frombuffer(b" ".join([x for x, _ in stretches] + [b""]).translate(FOLD), np.uint8)
        own = raw != 32
        keep = own.copy()
        keep[1:] |= own[:-1]  # one space behind each word
        firsts = np.concatenate(([0], np.cumsum(np.array([len(x) + 1 for x, _ in stretches], np.int64))))
        places = np.cumsum(keep) - keep
        bounds = np.append(places, keep.sum())[np.minimum(firsts, len(raw))]
        self.data = raw[keep]
        self.numbers = at_every_byte(self.data)
        ends = np.flatnonzero(self.data == 32)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        owner = np.searchsorted(bounds, starts, "right") - 1
        n = np.bincount(owner, minlength=len(stretches))
        lead = np.minimum(np.array([x for _, x in stretches], np.int64), n)
        first_word = np.concatenate(([0], np.cumsum(n)))[:-1]
        self.n_words = n - lead
        words = np.arange(len(starts))
        begun, lasts, sizes = [], [], []
        for k in range(ORDERS):
            last = words[k:]
            begin = words[: len(last)]
            fits = (first_word[owner[last]] <= begin) & (last - first_word[owner[last]] >= lead[owner[last]])
            begun.append(begin[fits])
            lasts.append(last[fits])
            sizes.append(np.full(len(begun[-1]), k))
        # words that only lead in are interned too, for their checksums; they are no features
        n_once = len(starts)
        self._begin = np.concatenate((words, *begun[1:]))
        self._order = np.concatenate((np.zeros(n_once, np.int64), *sizes[1:]))
        last = np.concatenate((words, *lasts[1:]))
        self.owners = owner[last]
        self.feature = np.ones(len(last), bool)
        self.feature[:n_once] = words - first_word[owner] >= lead[owner]
        self.starts = starts[self._begin]
        self.lengths = ends[last] - self.starts
        self.slots = self._intern(xxh64_spans(self.data, self.numbers, self.starts, self.lengths))
        self.used = np.flatnonzero(self.first >= 0)
        self.bucket = np.zeros(len(self.first), np.int64)
        self.bucket[self.used] = self._checksums(starts, ends, n_once) % np.uint32(buckets)
        self.count = np.bincount(self.slots[self.feature], minlength=len(self.first))
        self.n_features = np.bincount(self.owners[self.feature], minlength=len(stretches))

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences ``a`` and ``b`` have the same bytes."""
        out = self.lengths[a] == self.lengths[b]
        left = np.flatnonzero(out)
        done = 0
        while len(left):
            n = self.lengths[a[left]] - done
            cut = (np.maximum(8 - n, 0) * 8).astype(U)  # bytes behind the end don't count
            differ = ((self.numbers[self.starts[a[left]] + done] ^ self.numbers[self.starts[b[left]] + done]) << cut) != 0
            out[left[differ]] = False
            left = left[~differ & (n > 8)]
            done += 8
        return out

    def _intern(self, keys: np.ndarray) -> np.ndarray:
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        self.first = np.full(capacity, -1, np.int64)  # of each slot, the occurrence whose bytes it stands for
        self.keys = np.zeros(capacity, U)
        slots = np.zeros(len(keys), np.int64)
        open_, at = np.arange(len(keys)), (keys & U(capacity - 1)).astype(np.int64)
        while len(open_):
            free = self.first[at] < 0
            self.first[at[free]] = open_[free]  # where several claim a slot, one of them stays
            held = self.first[at]
            self.keys[at[free]] = keys[held[free]]
            settled = held == open_
            rest = np.flatnonzero(~settled & (self.keys[at] == keys[open_]))
            settled[rest] = self._same(held[rest], open_[rest])
            slots[open_[settled]] = at[settled]
            open_, at = open_[~settled], (at[~settled] + 1) & (capacity - 1)
        return slots

    def _checksums(self, starts: np.ndarray, ends: np.ndarray, n_once: int) -> np.ndarray:
        """CRC-32 of every used slot."""
        reps = self.first[self.used]
        out = np.zeros(len(reps), np.uint32)
        view = memoryview(self.data)
        long = self.lengths[reps] > LONG
        single = (self._order[reps] == 0) & ~long
        out[single] = crc_of_spans(self.data, self.starts[reps[single]], self.lengths[reps[single]])
        out[long] = [zlib.crc32(view[a : a + n]) for a, n in zip(self.starts[reps[long]].tolist(), self.lengths[reps[long]].tolist(), strict=True)]
        by_slot = np.zeros(len(self.first), np.uint32)
        by_slot[self.used] = out
        plain = by_slot[self.slots[:n_once]]  # of each word as it occurs
        sizes = np.minimum(ends - starts, LONG)  # longer words are in no n-gram that is put together here
        spaced = crc_shift(np.full(n_once, zlib.crc32(b" "), np.uint32), sizes) ^ plain
        for order in range(1, ORDERS):
            own = np.flatnonzero((self._order[reps] == order) & ~long)
            word = self._begin[reps[own]]
            value = plain[word]
            for k in range(1, order + 1):
                value = crc_shift(value, sizes[word + k] + 1) ^ spaced[word + k]
            out[own] = value
        return out


def stretches(texts: list[bytes | None], limit: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Groups of ``(text's number, bytes, leading words)`` of about ``limit`` bytes; a long text overlaps itself by two words."""
    group: list[tuple[int, bytes, int]] = []
    held = 0
    for k, text in enumerate(texts):
        at, tail = 0, b""
        while at < len(text or b""):
            end = at + limit
            while end < len(text) and FOLD[text[end]] != 32:  # a huge word stays whole
                end += 1
            part = tail + text[at:end] if at or end < len(text) else text
            group.append((k, part, len(tail.split())))
            held += len(part)
            at = end
            if at < len(text):
                tail = b" ".join(part.translate(FOLD).split()[1 - ORDERS :]) + b" "
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: the features of all texts in each bucket; a task sends at most one row for each bucket."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for group in stretches(_texts(part), GROUP_BYTES):
                    grams = Grams([x[1:] for x in group], buckets)
                    total += np.bincount(grams.bucket[grams.used], grams.count[grams.used], buckets).astype(np.int64)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Of every bucket ``floor(1000 ln(p / q))``, its add-one smoothed shares in ``target`` and in ``docs``."""
    both = []
    for texts in (docs, target):
        n = [0] * buckets
        for row in bucket_counts(texts, buckets).collect():  # ``buckets`` rows at most
            n[row.bucket] = row.n
        both.append(n)
    (corpus, goal), (s, t) = both, map(sum, both)
    return [math.floor(1000 * math.log(((y + 1) * (s + buckets)) / ((x + 1) * (t + buckets)))) for x, y in zip(corpus, goal, strict=True)]


def gumbel(seed: int, doc_id: int | None) -> int:
    """``floor(-1000 ln(-ln u))`` of a number u in (0, 1) that the id draws."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: list[int], seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs (doc_id, text)``."""
    table = np.array(gains, np.int64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.zeros((3, batch.num_rows), np.int64)  # words, features, weight
        for group in stretches(_texts(batch), GROUP_BYTES):
            grams = Grams([x[1:] for x in group], len(table))
            slot_gain = table[grams.bucket]
            each = np.where(grams.feature, slot_gain[grams.slots], 0)
            weights = np.zeros(len(group), np.int64)
            np.add.at(weights, grams.owners, each)
            np.add.at(sums, (slice(None), [x[0] for x in group]), np.stack((grams.n_words, grams.n_features, weights)))
        ids = batch.column("doc_id")
        scores = [w + gumbel(seed, k) for w, k in zip(sums[2].tolist(), ids.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in sums), pa.array(scores, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(plain, work, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(weighed: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``weighed`` (a written table) with ``rank``: 1, 2, ... for the drawn documents, null for the others."""
    fits = F.col("n_words") >= least_words
    n = weighed.where(fits).count()
    drawn = percent * n // 100
    none = F.lit(None).cast("long")
    if not drawn:
        return weighed.withColumn("rank", none)
    ranges = min(MOST_RANGES, -(-drawn // PER_RANGE))
    slack = 0.01 / ranges
    share = min(1.0, drawn / n + 2 * slack)  # the quantiles' error can't leave a drawn row out
    edges = weighed.where(fits).approxQuantile("score", [1 - share * (k + 1) / ranges for k in range(ranges)], slack) if share < 1 else [float("-inf")]
    edges = sorted(set(edges), reverse=True)
    place = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x > F.col("score")))
    placed = weighed.withColumn("range", F.when(fits, place))
    counts = {row.range: row["count"] for row in placed.where(fits).groupBy("range").count().collect()}  # one row for each range
    before, at, reached = {}, 0, -1
    for k in range(len(edges) + 1):
        before[k] = at
        at += counts.get(k, 0)
        if before[k] < drawn:
            reached = k
    open_ = fits & (F.col("range") <= reached)
    # rows of one score and id are one row of the ranking, so that no repeated row makes a range large
    missing = F.col("doc_id").isNull().alias("missing")
    keys = placed.where(open_).groupBy("range", "score", missing, F.coalesce("doc_id", F.lit(0)).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("range").orderBy(F.desc("score"), "missing", "id")
    earlier = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")).cast("long")
    keys = keys.withColumn("rank", earlier + offset + 1).where(F.col("rank") <= drawn).select("score", "missing", "id", "rank")
    rows = placed.where(open_).select("*", missing, F.coalesce("doc_id", F.lit(0)).alias("id"))
    names = [*weighed.columns, "rank"]
    return rows.join(keys, ["score", "missing", "id"], "left").select(*names).unionByName(placed.where(~F.coalesce(open_, F.lit(False))).withColumn("rank", none).select(*names))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``: the ``percent`` drawn have a rank."""
    return ranked(written(weigh(docs, bucket_gains(docs, target, buckets), seed)), percent, least_words)
