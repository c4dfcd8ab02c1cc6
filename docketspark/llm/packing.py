"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

Every document becomes its token ids and one end id; documents longer than the capacity are cut into pieces of
exactly the capacity, of which the first may be shorter.  Only the histogram of the piece lengths, at most one
number for each length up to the capacity, reaches the driver.  There the configuration linear program (how
often to use each multiset of lengths that fits into a sequence) is solved by multiplicative weights: lengths
that the patterns found so far cover badly gain weight, and a knapsack dynamic program prices the next pattern
by those weights.  The fractional pattern counts are rounded down against what is left to place, and the few
pieces left over are placed best-fit, longest first.  The outcome is a short table of runs (length, rank range,
first sequence, offset), from which every executor computes the places of its own pieces.

Results for odd input: a null or empty text is one piece that holds only the end id; a null ``doc_id`` is packed
like any other; rows that repeat a ``doc_id`` are packed as often as they occur; other columns are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_batch, cut, ship

CAPACITY, END_ID = 1024, 2
#: Pieces of one length are ranked in groups of about so many, so that a common length is no single group.
GROUP_ROWS = 1 << 17
#: The split pattern of the byte-level vocabulary family that the fast encoder handles.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(data: str):
    """Function from a text to its token ids for a tokenizer file's content.

    Byte-level BPE whose ids follow its merges is run by tiktoken, about five times as fast with the same ids;
    any other tokenizer file runs as it is.
    """
    import tiktoken  # only tasks load the tokenizers
    from tokenizers import Tokenizer

    spec = json.loads(data)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    merges = model.get("merges", [])
    vocab = model.get("vocab", {})
    plain = (
        model["type"] == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not model.get("ignore_merges")
        and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec.get("added_tokens", []))
    )
    if plain:
        joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in merges]
        order = [vocab[x] for x in joined]
        plain = order == sorted(order) and len(vocab.keys() - special.keys()) - len(joined) == 256
    if plain:
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): k for token, k in vocab.items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)

        def encode(text: str) -> list[int]:
            if any(x in text for x in allowed):
                return fast.encode(text, allowed_special=allowed, disallowed_special=())
            return fast.encode_ordinary(text)

        return encode
    whole = Tokenizer.from_str(data)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every document."""
    with open(tokenizer_file, encoding="utf-8") as source:
        data = source.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # one vocabulary file, whatever the corpus

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(shared.value)
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            flat = np.append(np.array(encode(text.as_py() or ""), "<u4"), np.uint32(end_id))
            first = len(flat) % capacity or capacity
            bounds = [0, *range(first, len(flat) + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                part = flat[a:b]
                rows.append((doc, k, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = ", ids array<int>" if with_ids else ""
    return by_batch(plain, work, f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}")


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int, most: np.ndarray) -> np.ndarray:
    """Counts of each length in the most valuable multiset that fits: knapsack dynamic program by capacity."""
    best = np.zeros(capacity + 1)
    steps, better = [], []
    for k in np.argsort(-lengths):
        size, price, left = int(lengths[k]), prices[k], int(min(most[k], capacity // lengths[k]))
        copies = 1
        while left > 0:  # copies in powers of two
            use = min(copies, left)
            offer = best[: capacity + 1 - size * use] + price * use
            wins = offer > best[size * use :] + 1e-15
            np.copyto(best[size * use :], offer, where=wins)
            steps.append((k, use, size * use))
            better.append(wins)
            left -= use
            copies *= 2
    out, at = np.zeros(len(lengths), np.int32), int(np.argmax(best))
    for (k, use, size), wins in zip(reversed(steps), reversed(better), strict=True):
        if at >= size and wins[at - size]:
            out[k] += use
            at -= size
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120) -> list[tuple[np.ndarray, float]]:
    """Fractional solution of the configuration linear program: patterns and how often to use each.

    Multiplicative weights for the covering rows "length k is used at least counts[k] times": each round the
    knapsack program finds the pattern with the largest weighted share of the remaining demand.
    """
    weights = lengths / capacity
    covered = np.zeros(len(lengths))
    chosen: dict[bytes, float] = {}
    for _ in range(rounds):
        pattern = best_pattern(weights, lengths, capacity, counts)
        use = np.flatnonzero(pattern)
        step = (counts[use] / pattern[use]).min() / 4
        chosen[pattern.tobytes()] = chosen.get(pattern.tobytes(), 0.0) + step
        covered[use] += step * pattern[use]
        weights[use] *= np.exp(-0.5 * step * pattern[use] / counts[use])
    scale = 1 / max(1e-12, float(np.median(covered / counts)))
    return [(np.frombuffer(key, np.int32), value * scale) for key, value in chosen.items()]


@dataclass
class Plan:
    """Runs of places: ranks ``first`` to ``last`` of pieces of one length lie ``per`` in each sequence."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sequence: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Places for all pieces of the histogram; uses counts only, never the pieces."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    used, next_sequence = np.zeros(len(lengths), np.int64), 0
    left = counts.astype(np.int64).copy()

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal next_sequence
        offset = 0
        for k in np.flatnonzero(pattern)[::-1]:
            per = int(pattern[k])
            rows.append((int(lengths[k]), int(used[k]), int(used[k]) + per * times, next_sequence, per, offset))
            used[k] += per * times
            left[k] -= per * times
            offset += per * int(lengths[k])
        next_sequence += times

    while True:  # round what the program says, then solve again for the rest
        rest = np.flatnonzero(left)
        if not len(rest) or left.sum() <= 4 * len(lengths) + 64:
            break
        placed = 0
        for pattern, value in sorted(solve(lengths[rest], left[rest], capacity), key=lambda x: -(x[0] @ lengths[rest])):
            whole = np.zeros(len(lengths), np.int64)
            whole[rest] = pattern
            use = whole > 0
            times = min(int(value), int((left[use] // whole[use]).min()))
            if times > 0 and whole @ lengths >= capacity * 0.995:
                place(whole, times)
                placed += times
        if not placed:
            break
    while left.any():  # best fit, longest first, for many equal sequences at a time
        room, pattern, still = capacity, np.zeros(len(lengths), np.int64), left.copy()
        while True:
            fits = np.flatnonzero((lengths <= room) & (still > 0))
            if not len(fits):
                break
            if pattern.any():
                trial = fill(lengths, still, room)
                pattern += trial
                break
            k = fits[-1]
            pattern[k] += 1
            still[k] -= 1
            room -= int(lengths[k])
        use = pattern > 0
        place(pattern, int((left[use] // pattern[use]).min()))
    columns = [np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)] if rows else [np.zeros(0, np.int64)] * 6
    return Plan(*columns, next_sequence)


def fill(lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The pieces left that fill ``room`` best, found by the same knapsack program with lengths as prices."""
    out = np.zeros(len(lengths), np.int64)
    here = np.flatnonzero((left > 0) & (lengths <= room))
    if len(here):
        longer = lengths[here] * (1 + 1e-6 * lengths[here])  # of equal fills the one with the longest pieces
        out[here] = best_pattern(longer, lengths[here], room, left[here])
    return out


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    return place(cut(pieces(docs, tokenizer_file, capacity, end_id, with_ids)), capacity)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for pieces ``doc_id, piece, length, ids_crc32`` and further columns."""
    histogram = {row["length"]: row["count"] for row in parts.groupBy("length").count().collect()}  # at most capacity rows
    lengths = np.array(sorted(histogram), np.int64)
    return placed(parts, plan(lengths, np.array([histogram[int(x)] for x in lengths], np.int64), capacity), histogram)


def placed(parts: DataFrame, made: Plan, histogram: dict[int, int]) -> DataFrame:
    """Deal each length into groups of about ``GROUP_ROWS``, rank the pieces of every group and look up their places.

    A group's first rank is the sum of the groups before it, a small table that is partitioned like the pieces.
    """
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast(made)  # a few runs for each length
    ship(spark)
    groups = [1 + histogram.get(x, 0) // GROUP_ROWS for x in range(max(histogram, default=0) + 1)]
    n = F.element_at(F.array(*map(F.lit, groups)), F.col("length").cast("int") + 1)
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n).cast("int"))
    sizes = dealt.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    names = parts.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = shared.value
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy() + batch.column("begin").to_numpy()
        at = np.searchsorted(runs.length * (1 << 44) + runs.first, length * (1 << 44) + rank, "right") - 1
        inside = rank - runs.first[at]
        sequence = runs.sequence[at] + inside // runs.per[at]
        offset = runs.offset[at] + inside % runs.per[at] * length
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - F.lit(1)
    ranked = dealt.withColumn("rank", rank).join(begins, ["length", "part"])
    schema = ", ".join(f"{name} {kind}" for name, kind in parts.dtypes)
    return by_batch(ranked, work, f"{schema}, sequence_id long, offset long")
