"""Substring dedup with compact windows over min-hashed word shingles.

A text is its sequence of ``shingle``-word runs.  Under one hash function every passage of at least ``least`` words
takes its min-hash at one shingle, and all passages that take it at the same shingle form a compact window: the
stretch in which that shingle's hash is the smallest, a node of the Cartesian tree over the hashes.  About
``2 n / least`` windows of a text of ``n`` shingles are wide enough; they are found from sliding minima and the tree
over those minima alone.  Two texts that share a passage have, for each hash function, windows with the same
min-hash that both cover it.

Windows meet by (function, min-hash), in two steps:

1. Each group links its windows to the window of its smallest document, so a passage in thousands of documents costs
   one row each; of identical texts only the smallest document takes part.  The linked windows of two documents are
   joined by interval: where the windows of enough functions overlap, a candidate passage is found and verified.
2. Windows that no verified passage explains stay open.  Their documents, and those in their groups, get windows anew,
   with the shingles of common phrases put last in every function's order, so that a phrase of very many documents is
   no longer a centre; any one order serves all documents alike.  A window is joined by interval with the other
   functions' windows of its document, and the pairs of min-hashes form finer groups, in which two documents agree on
   two functions.  Each of these is linked to its smallest document in turn; then every window still open is compared with all windows
   of smaller documents in its group, explained ones too, in blocks of bounded size, on the shingles around it.  A
   block returns what it finds for each open window, never the pairs.

So no partner of a group is left out, however many it has: an open window meets every smaller document that agrees with
it on two functions.  A passage is verified on the shingles themselves: stretches of matching shingles, with small gaps,
whose sets have a Jaccard similarity of at least ``similarity`` and that span ``least`` words or more.

A verified passage counts as repeated in the larger document; the smallest document that holds it keeps it.  Documents
are ordered by ``doc_id``, texts of one ``doc_id`` by their tag (:func:`shared.tagged`).

Results for odd input: a null, empty or short text has no passages; a null ``doc_id`` takes no part and is returned
unchanged; rows that repeat a ``doc_id`` with one text are one document, and with different texts each is a document of
its own; a text of any length is searched whole; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import GROUP_BYTES, by_batch, cut, forget, join_checked, join_spread, rewrite, ship, tagged, written
from .shared import node as one_number

#: Hash functions, and how many must agree on a candidate.
FUNCTIONS, AGREE = 4, 2
#: Shingles without a match that a passage may hold between two matching stretches.
GAP = 12
#: Windows that one block holds at most on each side, and windows of groups of one block that a call holds on average.
BLOCK, CALL = 2048, 2048
#: A min-hash with more open windows than this is a common phrase; of so many phrases the shingles are put last.
COMMON, PHRASES = 64, 20_000
#: Groups of at most so many windows are compared beside others with the same smallest document.
TOGETHER = 64
#: Centres closer than this are compared with one window once.
NEAR = 16
SPAN = "array<struct<start:int,end:int>>"
NODE = ["doc_id", "tag"]


#: Low bits of a packed min-hash that hold its place, below one that marks late shingles.
PLACE_BITS = 24
#: A window is one number: its centre, how far it reaches to both sides (15 bits each) and its function (2 bits).
REACH_BITS, FUNCTION_BITS = 15, 2


def packed(f: int, left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Windows as numbers; one reaches at most 32,767 shingles to a side, and longer passages hold further windows."""
    most = (1 << REACH_BITS) - 1
    low, high = np.minimum(centre - left, most), np.minimum(right - centre, most)
    return (((centre << REACH_BITS | low) << REACH_BITS | high) << FUNCTION_BITS) | f


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Function, left end, centre, right end."""
    most = (1 << REACH_BITS) - 1
    centre, rest = at >> (2 * REACH_BITS + FUNCTION_BITS), at >> FUNCTION_BITS
    return at & ((1 << FUNCTION_BITS) - 1), centre - (rest >> REACH_BITS & most), centre, centre + (rest & most)


def centre_of(at: str) -> Column:
    return F.shiftright(at, 2 * REACH_BITS + FUNCTION_BITS)


def node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc_id"), F.col(f"{prefix}tag"))


def late(runs: np.ndarray, owner: np.ndarray, near: int) -> np.ndarray:
    """Shingles that occurred shortly before in their text, but for about one in ``near`` places of such a chain.

    Of equal minima those that are not late are taken first, so a text that repeats a few words has no more windows
    than others.
    """
    order = np.argsort(runs)
    same = runs[order][1:] == runs[order][:-1]
    out = np.zeros(len(runs), bool)
    if not same.any():
        return out
    place = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]  # those that occur more than once
    place = place[np.lexsort((place, runs[place]))]
    linked = (runs[place][1:] == runs[place][:-1]) & (owner[place][1:] == owner[place][:-1]) & (np.diff(place) <= near)
    chain = np.concatenate(([0], np.cumsum(~linked)))
    begins = np.flatnonzero(np.concatenate(([True], ~linked)))
    stretch = (place - place[begins[chain]]) // near
    out[place] = np.concatenate(([False], linked & (stretch[1:] == stretch[:-1])))
    return out


def nearest_smaller(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest before it that is not larger, else -1, and the nearest behind it that is smaller, else
    ``len(key)``, both within its run of equal ``doc``.

    All values look at once: one that is no end yet is left by way of the end found for it so far, which halves what a
    chain of such steps still has before it.
    """
    n = len(key)
    begins = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.zeros(0, bool)
    before, behind = np.arange(-1, n - 1), np.arange(1, n + 1)
    before[begins] = -1
    behind[np.roll(begins, -1)] = n
    for at, end, smaller in ((before, -1, np.less_equal), (behind, n, np.less)):
        todo = np.flatnonzero(at != end)
        while len(todo):
            todo = todo[~smaller(key[at[todo]], key[todo])]
            at[todo] = at[at[todo]]
            todo = todo[at[todo] != end]
    return before, behind


def sliding_argmin(values: np.ndarray, width: int, last: np.ndarray | None = None) -> np.ndarray:
    """Place of the smallest of each ``width`` adjacent values, by their upper 39 bits.

    Of equal ones the leftmost that ``last`` does not mark.
    """
    most = 1 << PLACE_BITS
    if len(values) > most:  # stretches that overlap by a width less one, so that places fit in the low bits
        starts = range(0, len(values) - width + 1, most - width + 1)
        return np.concatenate([k + sliding_argmin(values[k : k + most], width, None if last is None else last[k : k + most]) for k in starts])
    mask = np.uint64(most - 1)
    low, size = (values & ~np.uint64(2 * most - 1)) | np.arange(len(values), dtype=np.uint64), 1
    if last is not None:
        low |= last.astype(np.uint64) << np.uint64(PLACE_BITS)
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    return (low & mask).astype(np.int64)


def windows(
    runs: np.ndarray, bounds: np.ndarray, width: int, seed: int, last: np.ndarray | None = None, common: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Compact windows of at least ``width`` shingles of each text: text, min-hash, left end, centre, right end.

    Places count from each text's first shingle; ends are inclusive.  ``common`` marks shingles whose hash counts as
    higher than all others.
    """
    value = W.mix(runs * (W.numbers(20 + seed, 1)[0] | W.U(1)) + W.U(seed + 1))
    if common is not None:
        value = value >> W.U(1) | common.astype(np.uint64) << W.U(63)
    if len(value) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = sliding_argmin(value, width, last)
    inside = owner[: len(at)] == owner[width - 1 :]
    at = at[inside]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at  # places of minima only rise
    doc = owner[at]
    key = value[at] & ~np.uint64((2 << PLACE_BITS) - 1)
    # the Cartesian tree: the nearest smaller values beside a sliding minimum are sliding minima themselves
    before, behind = nearest_smaller(key, doc)
    left, right = bounds[doc], bounds[doc + 1] - 1
    held, ended = before >= 0, behind < len(at)
    left[held], right[ended] = at[before[held]] + 1, at[behind[ended]] - 1
    begin = bounds[doc]
    return doc, key, left - begin, at - begin, right - begin


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, k1, k2, n_words`` of the word sequences: the 128-bit XXH3 of the words (A-Z lower-cased), joined by a space."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: at W.SPACES alone
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            counts.append(len(words))
        both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        columns = [*(batch.column(x) for x in NODE), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*NODE, "k1", "k2", "n_words"])

    return by_batch(docs, work, "doc_id long, tag long, k1 long, k2 long, n_words long")


def marked(common: np.ndarray) -> np.ndarray:
    """A table of at least eight places for each of some hashes, true where the low bits of one of them point."""
    table = np.zeros(1 << max(16, (8 * len(common)).bit_length()), bool)
    table[common & W.U(len(table) - 1)] = True
    return table


def among(values: np.ndarray, common: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes are in ``common`` (sorted); only those that ``table``, its :func:`marked`, lets through are looked up."""
    out = np.zeros(len(values), bool)
    maybe = np.flatnonzero(table[values & W.U(len(table) - 1)])
    if len(maybe):
        out[maybe] = common[np.minimum(np.searchsorted(common, values[maybe]), len(common) - 1)] == values[maybe]
    return out


def texts_windows(texts: list, shingle: int, width: int, functions: int, common: np.ndarray | None = None):
    """Compact windows of a batch of texts under all functions: keys, which text, packed places, function by function.

    Texts are taken in groups of about GROUP_BYTES of hashes.
    """
    hashes, bounds = W.word_hashes(texts)
    runs, ends = W.shingles(hashes, bounds, shingle)
    first, table = 0, None if common is None else marked(common)
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP_BYTES // 8, "right")) - 1)
        stop = min(stop, len(texts))
        some, own = runs[ends[first] : ends[stop]], ends[first : stop + 1] - ends[first]
        last = late(some, np.repeat(np.arange(len(own) - 1), np.diff(own)), width // 2)
        put_last = None if common is None else among(some, common, table)
        keys, owners, places = [], [], []
        for f in range(functions):
            doc, key, left, centre, right = windows(some, own, width, f, last, put_last)
            keys.append(W.mix(key.astype(np.uint64) + W.U(f + 1)))
            owners.append(first + doc)
            places.append(packed(f, left, centre, right))
        yield np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
        first = stop


def all_windows(docs: DataFrame, shingle: int, width: int, functions: int) -> DataFrame:
    """``key, doc_id, tag, at`` of the compact windows of all documents."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(texts_windows(batch.column("text").to_pylist(), shingle, width, functions))
        key, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        owner = pa.array(owner.astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(W.signed(key)), *(batch.column(x).take(owner) for x in NODE), pa.array(at.astype(np.int64))], ["key", *NODE, "at"]
        )

    if functions > 1 << FUNCTION_BITS:
        raise ValueError(f"at most {1 << FUNCTION_BITS} functions")
    return by_batch(docs, work, "key long, doc_id long, tag long, at long")


def candidates(linked: DataFrame, agree: int, width: int) -> DataFrame:
    """Interval join: ``doc_id, tag, o_doc_id, o_tag, a (spans), b (spans)`` where enough functions' windows overlap.

    ``linked`` has a pair's windows as ``at`` and ``o_at``.  Pairs in which too few functions meet at all are dropped
    first.  Windows are laid over each other by the offset of their centres, and every window is trimmed to what both
    documents' windows cover.
    """
    met = linked.groupBy(*NODE, "o_doc_id", "o_tag").agg(
        F.bit_or(F.expr(f"shiftleft(1, cast(at & {(1 << FUNCTION_BITS) - 1} as int))")).alias("functions"), F.collect_list(F.struct("at", "o_at")).alias("w")
    )
    met = met.where(F.bit_count("functions") >= agree).drop("functions")

    def overlaps(f, low, high, shift) -> list[tuple[int, int, int, int]]:
        spans, order, k = [], np.argsort(low, kind="stable"), 0
        f, low, high, shift = f[order], low[order], high[order], shift[order]
        while k < len(low):  # runs of overlapping windows
            end, stop = high[k], k + 1
            while stop < len(low) and low[stop] <= end:
                end = max(end, high[stop])
                stop += 1
            if len(set(f[k:stop].tolist())) >= agree:
                s = shift[k:stop]
                spans.append((int(low[k]), int(end), int(max(0, low[k] + s.min())), int(end + s.max())))
            k = stop
        return spans

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("w")
        flat = lists.flatten()
        f, left, c, right = unpacked(flat.field(0).to_numpy())
        _, other_left, oc, other_right = unpacked(flat.field(1).to_numpy())
        shift = oc - c
        low, high = np.maximum(left, other_left - shift), np.minimum(right, other_right - shift)
        fine = high - low + 1 >= width
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        a, b = [], []
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            own = slice(begin, end)
            keep = fine[own]
            found = overlaps(f[own][keep], low[own][keep], high[own][keep], shift[own][keep])
            a.append([{"start": x[0], "end": x[1]} for x in found])
            b.append([{"start": x[2], "end": x[3]} for x in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        names = [*NODE, "o_doc_id", "o_tag"]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(a, kind), pa.array(b, kind)], [*names, "a", "b"])

    return by_batch(met, join, f"doc_id long, tag long, o_doc_id long, o_tag long, a {SPAN}, b {SPAN}").where("size(a) > 0")


def ranking(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The order that sorts ``values``, equal ones as they stand, the sorted values, and whether all are distinct."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    return order, ranked, not (ranked[1:] == ranked[:-1]).any()


def distinct(values: np.ndarray) -> int:
    """How many different values there are."""
    ranked = np.sort(values)
    return int((ranked[1:] != ranked[:-1]).sum()) + 1 if len(ranked) else 0


def passages(one: np.ndarray, two: np.ndarray, similarity: float, width: int, gap: int = GAP, plain: bool | None = None, ranks: tuple | None = None) -> list[tuple[int, int]]:
    """Verified stretches ``[start, end)`` of shingles of ``one`` that ``two`` nearly repeats.

    Stretches of matching shingles are joined over gaps of up to ``gap`` shingles; a joined stretch counts if its
    shingle set and that of the matching stretch of ``two`` are similar enough, else its parts are tried alone.  Where
    all of ``one`` are distinct a stretch needs ``similarity * width`` matches, so parts with fewer are not tried.
    ``plain`` (all of ``one`` distinct) and ``ranks``, the :func:`ranking` of ``two``, may be given where they are known.
    """
    order, ranked, two_plain = ranking(two) if ranks is None else ranks
    at = np.minimum(np.searchsorted(ranked, one), max(0, len(two) - 1))
    hits = (ranked[at] == one).nonzero()[0] if len(two) else np.zeros(0, np.int64)
    if not len(hits):
        return []
    place = order[at[hits]]

    one_plain = ranking(one)[2] if plain is None else plain
    least = similarity * width if one_plain else 1
    if len(hits) < least:
        return []
    step = hits[1:] - hits[:-1] - 1
    apart = np.maximum(step, np.abs(place[1:] - place[:-1] - 1))

    def similar(i: int, j: int) -> bool:
        if one_plain and j + 1 - i < similarity * int(hits[j] - hits[i] + 1):
            return False  # the matching stretch of ``two`` holds all that is matched, so it can't raise the likeness
        low, high = int(place[i : j + 1].min()), int(place[i : j + 1].max()) + 1
        # a matched shingle's first place in ``two`` lies in that stretch, so the sets share what is matched and no more
        both = j + 1 - i if one_plain else distinct(one[hits[i : j + 1]])
        a = int(hits[j] - hits[i]) + 1 if one_plain else distinct(one[hits[i] : hits[j] + 1])
        b = high - low if two_plain else distinct(two[low:high])
        return both >= similarity * (a + b - both)

    out = []

    def settle(i: int, j: int, reach: int) -> None:
        if similar(i, j):
            out.append((int(hits[i]), int(hits[j]) + 1))
            return
        most = int(apart[i:j].max()) if j > i else 0
        while reach >= most and reach:  # where nothing is that far apart, the same stretch would be tried again
            reach //= 2
        if reach < most:  # part it also where the other text jumps, then at smaller gaps
            split(i, j, reach, apart)

    def split(i: int, j: int, reach: int, far: np.ndarray) -> None:
        ends = (far[i:j] > reach).nonzero()[0] + i
        begins, ends = np.concatenate(([i], ends + 1)), np.concatenate((ends, [j]))
        wide = ((hits[ends] - hits[begins] + 1 >= width) & (ends - begins + 1 >= least)).nonzero()[0]
        for k in wide.tolist():
            settle(int(begins[k]), int(ends[k]), reach if far is step else reach // 2)

    split(0, len(hits) - 1, gap, step)
    return out


def shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, tag, runs``: all shingles of the texts, eight bytes each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, ends = W.shingles(*W.word_hashes(batch.column("text").to_pylist()), shingle)
        packed = [runs[a:b].astype("<u8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in NODE), pa.array(packed, pa.binary())], [*NODE, "runs"])

    return by_batch(docs.select(*NODE, "text"), work, "doc_id long, tag long, runs binary")


def clipped(asked: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``asked`` (doc_id, tag, at: spans of shingles, inclusive) with ``parts``: the shingles of each span.

    Whole texts' shingles stay where they are made unless their document is asked for; a document asked for very often,
    the centre of a large group, is copied to several tasks.
    """
    wanted = cut(asked.select(*NODE).distinct())
    texts = join_checked(docs, wanted, NODE, "left_semi")
    runs = shingled(texts, shingle).select(node().alias("node"), "runs")
    part = lambda x: F.substring("runs", x["start"] * 8 + 1, (x["end"] - x["start"] + 1) * 8)
    both = join_spread(asked.withColumn("node", node()), runs, "node", F.col("at"))
    return both.withColumn("parts", F.transform("at", part)).drop("runs", "node")


def verify(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float, width: int) -> DataFrame:
    """``doc_id, tag, o_doc_id, o_tag, spans`` of the candidates that hold, with spans in words, ``[start, end)``."""
    names = [*NODE, "o_doc_id", "o_tag"]
    pair = F.struct(*names).alias("pair")
    asked = pairs.select(*NODE, pair, F.lit(True).alias("own"), F.col("a").alias("at")).unionByName(
        pairs.select(F.col("o_doc_id").alias("doc_id"), F.col("o_tag").alias("tag"), pair, F.lit(False).alias("own"), F.col("b").alias("at"))
    )
    mine = F.struct("at", "parts")
    both = clipped(asked, docs, shingle).groupBy("pair").agg(
        F.max(F.when(F.col("own"), mine)).alias("mine"), F.max(F.when(~F.col("own"), F.col("parts"))).alias("y")
    )
    both = both.where("mine is not null and y is not null").select("pair.*", "mine.at", F.col("mine.parts").alias("x"), "y")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for at, x, y in zip(*(batch.column(k).to_pylist() for k in ("at", "x", "y")), strict=True):
            own = []
            for span, one, two in zip(at, x, y, strict=True):
                for a, b in passages(np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8"), similarity, width):
                    own.append({"start": span["start"] + a, "end": span["start"] + b + shingle - 1})
            found.append(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(found, kind)], [*names, "spans"])

    return by_batch(both, compare, f"doc_id long, tag long, o_doc_id long, o_tag long, spans {SPAN}").where("size(spans) > 0")


def pairs_of_windows(docs: DataFrame, shingle: int, width: int, functions: int, common: np.ndarray) -> DataFrame:
    """``pair, doc_id, tag, at, open``: two functions' windows of one document that can hold one passage.

    The windows must overlap by ``width`` shingles, each must cover the other's centre, and the centres must lie within
    ``width``; ``at`` is what both cover, with the first centre.  Only those count that lie within ``width`` of one of
    the document's ``places`` (sorted).  ``open`` says that none of the document's ``spans`` (or null) holds the centre.
    Shingles in ``common`` come last in every function's order, so a phrase of many
    documents is a centre only in passages of nothing but such phrases.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # bounded by PHRASES

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = (1 << 31) + 4 * width
        line_of = lambda lists: np.repeat(np.arange(batch.num_rows) * step, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        asked = batch.column("places")
        asked = asked.flatten().to_numpy() + line_of(asked)
        spans = batch.column("spans")
        starts, stops = (spans.flatten().field(k).to_numpy() + line_of(spans) for k in (0, 1))
        order = np.argsort(starts)
        starts, stops = starts[order], np.concatenate(([0], np.maximum.accumulate(stops[order])))
        for key, owner, at in texts_windows(batch.column("text").to_pylist(), shingle, width, functions, shared.value):
            f, left, c, right = unpacked(at)
            near = np.searchsorted(asked, owner * step + c + width, "right") > np.searchsorted(asked, owner * step + c - width, "left")
            key, f, left, c, right, owner = (x[near] for x in (key, f, left, c, right, owner))
            order = np.argsort((owner * step + c) << FUNCTION_BITS | f, kind="stable")
            key, f, left, c, right, owner = (x[order] for x in (key, f, left, c, right, owner))
            line = owner * step + c
            counts = np.searchsorted(line, line + width, "left") - np.arange(len(c)) - 1  # later windows within a width
            i = np.repeat(np.arange(len(c)), counts)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            low, high = np.maximum(left[i], left[j]), np.minimum(right[i], right[j])
            keep = (f[i] != f[j]) & (low <= c[i]) & (c[j] <= high) & (high - low + 1 >= width)
            i, j, low, high = i[keep], j[keep], low[keep], high[keep]
            one, two = np.where(f[i] > f[j], key[j], key[i]), np.where(f[i] > f[j], key[i], key[j])
            parts.append((W.mix(one * W.U(0x9E3779B97F4A7C15) + W.mix(two + W.U(3))), owner[i], packed(0, low, c[i], high)))
        pair, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows, centre = pa.array(owner), owner * step + unpacked(at)[2]
        is_open = stops[np.searchsorted(starts, centre, "right")] <= centre
        return pa.RecordBatch.from_arrays([pa.array(W.signed(pair)), *(batch.column(x).take(rows) for x in NODE), pa.array(at), pa.array(is_open)], ["pair", *NODE, "at", "open"])

    return by_batch(docs, work, "pair long, doc_id long, tag long, at long, open boolean")


def fewest(values: np.ndarray, width: int, ranks: tuple | None = None) -> int:
    """The smallest number of distinct values in ``width`` adjacent ones; ``ranks`` is their :func:`ranking` where known."""
    n, (order, ranked, plain) = len(values), ranking(values) if ranks is None else ranks
    if plain:
        return min(n, width)
    again = ranked[1:] == ranked[:-1]
    if n <= width:
        return n - int(again.sum())
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    starts = np.arange(n - width + 1)
    return int((before[starts[:, None] + np.arange(width)] < starts[:, None]).sum(axis=1).min())


def compare_windows(table: pa.Table, similarity: float, width: int, shingle: int) -> pa.Table:
    """Passages that hold an asking window's centre and that windows of smaller documents in its groups repeat.

    ``table`` holds the windows of some blocks and, in rows of their own, the shingles around each of them once.  Others
    that hold too few of the shingles of every stretch of ``width`` over the centre are set aside, all of a group at once.
    """
    pair, doc, tag, start, middle = (table.column(x).to_numpy() for x in ("pair", "doc_id", "tag", "start", "centre"))
    asks, own = (table.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("asks", "own"))
    names = list(zip(doc.tolist(), tag.tolist(), start.tolist(), strict=True))
    text = {names[k]: np.frombuffer(part, "<u8") for k, part in enumerate(table.column("part").to_pylist()) if part is not None}
    windows = np.flatnonzero(own)
    windows = windows[np.lexsort((tag[windows], doc[windows], pair[windows]))]
    change = pair[windows][1:] != pair[windows][:-1]
    bounds = np.flatnonzero(np.concatenate(([True], change, [True]))) if len(windows) else []
    closed: dict[tuple, list[tuple[int, int]]] = {}
    needs: dict[tuple, float] = {}
    plain: dict[tuple, bool] = {}
    ranks: dict[tuple, tuple] = {}  # of this call's windows, each ranked once for all that meet it
    tried: set[tuple] = set()  # what is held around one centre holds every stretch over another of the same NEAR places
    out: list[tuple] = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        group = windows[first:last]
        others, asking = group[~asks[group]], group[asks[group]]
        if not len(others) or not len(asking):
            continue
        held = [text[names[o]] for o in others]
        values, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
        known, at = np.unique(values, return_inverse=True)
        code = np.sort(at * len(held) + owner)
        code = code[np.concatenate(([True], code[1:] != code[:-1]))]  # each shingle of a window once
        holder, begin = code % len(held), np.searchsorted(code, np.arange(len(known) + 1) * len(held))
        for k in asking:
            node, mine = names[k][:2], text[names[k]]
            centre = int(middle[k] - start[k])
            if len(mine) < width or any(x <= start[k] + centre < y for x, y in closed.get(node, ())):
                continue  # another group of this call has explained it
            if names[k] not in needs:
                own_ranks = ranks[names[k]] = ranks.get(names[k]) or ranking(mine)
                needs[names[k]] = similarity * fewest(mine, width, own_ranks)
                plain[names[k]] = own_ranks[2]
            low, high = max(0, centre - width + 1), min(centre, len(mine) - width)
            around = mine[low : high + width]
            place = np.minimum(np.searchsorted(known, around), len(known) - 1)
            spot = np.flatnonzero(known[place] == around)
            first_holder, counts = begin[place[spot]], begin[place[spot] + 1] - begin[place[spot]]
            row = holder[np.repeat(first_holder - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            smaller = (doc[others] < node[0]) | ((doc[others] == node[0]) & (tag[others] < node[1]))
            enough = smaller & (np.bincount(row, minlength=len(held)) >= needs[names[k]])
            if not enough.any():
                continue
            kept = enough[row]
            marks = np.zeros((int(enough.sum()), len(around) + 1), np.int32)
            marks[(np.cumsum(enough) - 1)[row[kept]], np.repeat(spot, counts)[kept] + 1] = 1
            total = np.cumsum(marks, axis=1, dtype=np.int32)
            best = (total[:, width:] - total[:, :-width]).max(axis=1)
            for row in np.flatnonzero(enough)[best >= needs[names[k]]]:
                near = (*node, middle[k] // NEAR, *names[others[row]][:2], start[others[row]] - start[k])
                if near in tried:
                    continue
                tried.add(near)
                other = names[others[row]]
                if other not in ranks:
                    ranks[other] = ranking(held[row])
                spans = passages(mine, held[row], similarity, width, plain=plain[names[k]], ranks=ranks[other])
                if spans:
                    closed.setdefault(node, []).extend((start[k] + x, start[k] + y) for x, y in spans)
                    out.append((*node, *names[others[row]][:2], [{"start": int(start[k] + x), "end": int(start[k] + y + shingle - 1)} for x, y in spans]))
                    if any(x <= centre < y for x, y in spans):
                        break
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], kind)], [*NODE, "o_doc_id", "o_tag", "spans"])


def common_shingles(docs: DataFrame, rows: DataFrame, shingle: int, width: int) -> np.ndarray:
    """Shingles around the most common min-hashes of open windows: one example of each phrase holds them all."""
    phrases = rows.groupBy("key").agg(F.sum(F.col("open").cast("long")).alias("n_open"), F.min(F.struct(*NODE, "at")).alias("o"))
    phrases = cut(phrases.where(F.col("n_open") > COMMON).orderBy(F.desc("n_open"), "key").limit(PHRASES))
    at = centre_of("o.at")
    span = F.struct(F.greatest(at - width, F.lit(0)).cast("int").alias("start"), (at + width).cast("int").alias("end"))
    asked = phrases.groupBy("o.doc_id", "o.tag").agg(F.collect_set(span).alias("at"))
    found = [np.frombuffer(x, "<u8") for row in clipped(asked, docs, shingle).select("parts").collect() for x in row[0]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def explained_spans(sure: DataFrame) -> DataFrame:
    return cut(sure.groupBy(*NODE).agg(F.flatten(F.collect_list("spans")).alias("spans")))


def still_open(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with ``open`` false where one of the ``spans`` of their document holds their centre."""
    explained = F.exists("spans", lambda s: (centre_of("at") >= s["start"]) & (centre_of("at") < s["end"]))
    return join_checked(rows, spans, NODE, "left").withColumn("open", F.col("open") & ~F.coalesce(explained, F.lit(False))).drop("spans")


def linked_to(rows: DataFrame, centres: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """The open windows beside the one window of their group's centre ``o``, if that is of a smaller document."""
    met = join_spread(rows.where("open"), centres, key, node(), counts=counts).where(node() > F.struct("o.doc_id", "o.tag"))
    return met.select(*NODE, F.col("o.doc_id").alias("o_doc_id"), F.col("o.tag").alias("o_tag"), "at", F.col("o.at").alias("o_at"))


def asking_groups(rows: DataFrame, key: str) -> DataFrame:
    """``key, count, y`` of the groups in which a document with an open window is not the smallest; ``y`` is the largest such ``doc_id``.

    Sums of plain numbers need no sorting.  Where texts of one ``doc_id`` are both smallest and largest their tags are only
    known to differ, so such a group may be kept without need.
    """
    shown = F.when(F.col("open"), F.col("doc_id"))
    ends = [F.min("doc_id").alias("x"), F.max(shown).alias("y"), F.min("tag").alias("t"), F.max("tag").alias("u")]
    found = rows.groupBy(key).agg(F.count("*").alias("count"), *ends)
    return found.where("x < y or x = y and t < u").select(key, "count", "y")


def first_window(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(F.struct(*NODE, "at")).alias("o"))


def dealt_to_calls(members: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """``unit, pair, doc_id, tag, start, centre, asks``: the windows of each call on the groups that have pairs left.

    ``members`` has ``pair, doc_id, tag, at, open``; ``left`` has for each group its ``count``, open ones ``n_open``, its
    smallest window ``x`` but for the first, and its largest document ``y`` with an open window.  Each block of a large
    group is a call of its own.  Groups of one block share calls of about ``CALL`` windows, small ones with those whose
    smallest windows lie near each other in one document, so that a call holds a stretch of text once for all of them;
    where those are more than two calls' windows they are dealt to several.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    left = left.where(node("x.") < F.col("y")).withColumns({"n_rows": blocks("count"), "n_columns": blocks("n_open")})
    near = F.xxhash64("x.doc_id", "x.tag", F.shiftright(centre_of("x.at"), 8))
    left = cut(left.withColumn("near", F.when(F.col("count") <= TOGETHER, near).otherwise(F.xxhash64("pair"))).drop("x"))
    heavy = left.where("n_rows = 1 and n_columns = 1").groupBy("near").agg(F.sum(F.col("count") + F.col("n_open")).alias("n"))
    heavy = cut(heavy.where(F.col("n") > 2 * CALL).select("near", F.ceil(F.col("n") / CALL).alias("parts")))
    part = F.pmod(F.xxhash64("pair"), F.coalesce("parts", F.lit(1)))
    left = cut(join_checked(left, heavy, "near", "left").withColumn("call", F.xxhash64("near", part)).drop("near", "parts"))
    shared = left.where("n_rows = 1 and n_columns = 1").agg(F.sum(F.col("count") + F.col("n_open"))).first()[0] or 0
    members = join_spread(members, left.drop("n_open"), "pair", node(), counts=left).where(node() <= F.col("y")).drop("y")
    around = F.greatest(centre_of("at") - (width - 1 + NEAR), F.lit(0)).cast("int")
    members = written(members.withColumn("start", around).withColumn("centre", centre_of("at").cast("int")).drop("at"))
    spot = F.xxhash64(*NODE, "start")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(spot, F.col(n)).cast("int")
    plain = ["pair", "call", "n_rows", "n_columns", *NODE, "start", "centre"]
    dealt = members.select(*plain, F.lit(False).alias("asks"), deal("n_rows").alias("row"), each("n_columns").alias("column")).unionByName(
        members.where("open").select(*plain, F.lit(True).alias("asks"), each("n_rows").alias("row"), deal("n_columns").alias("column"))
    )
    alone = (F.col("n_rows") > 1) | (F.col("n_columns") > 1)
    unit = F.when(alone, F.xxhash64("pair", "row", "column")).otherwise(F.pmod("call", F.lit(1 + shared // CALL)))
    return dealt.select(unit.alias("unit"), "pair", *NODE, "start", "centre", "asks")


def settle(docs: DataFrame, rows: DataFrame, explained: DataFrame, shingle: int, similarity: float, width: int, functions: int) -> DataFrame:
    """``doc_id, tag, o_doc_id, o_tag, spans``: what smaller documents repeat of the windows that are still open.

    ``rows`` has ``key, doc_id, tag, at, open`` of the groups that hold open windows, ``explained`` each document's spans
    that are found.
    """
    places = rows.groupBy(*NODE).agg(F.array_sort(F.collect_set(centre_of("at"))).alias("places"))
    places = cut(join_checked(places, explained, NODE, "left"))
    common = common_shingles(docs, rows, shingle, width)
    pairs = pairs_of_windows(join_checked(docs.select(*NODE, "text"), places, NODE), shingle, width, functions, common)
    pairs = written(pairs)
    groups = cut(asking_groups(pairs, "pair"))
    members = written(join_spread(pairs, groups, "pair", node(), counts=groups, hashed=True).where("doc_id <= y").drop("y", "count"))
    forget(pairs)
    firsts = cut(first_window(members, "pair"))
    sure = cut(verify(docs, cut(candidates(linked_to(members, firsts, "pair", groups), 1, width)), shingle, similarity, width))
    # what is open now has met its group's first window; all others of smaller documents are left
    members = join_spread(still_open(members, explained_spans(sure)), firsts, "pair", node(), counts=groups)
    window = F.struct(*NODE, "at")
    left = members.groupBy("pair").agg(
        F.count("*").alias("count"),
        F.sum(F.col("open").cast("long")).alias("n_open"),
        F.min(F.when(window != F.col("o"), window)).alias("x"),
        F.max(F.when(F.col("open"), node())).alias("y"),
    )
    dealt = written(dealt_to_calls(members.drop("o"), left, width))
    asked = dealt.select("unit", *NODE, "start").distinct()
    span = F.struct("start", (F.col("start") + 3 * width).alias("end"))
    texts = clipped(asked.groupBy(*NODE).agg(F.collect_set(span).alias("at")), docs, shingle)
    texts = texts.select(*NODE, F.explode(F.arrays_zip("at", "parts")).alias("t")).select(*NODE, F.col("t.at.start").alias("start"), F.col("t.parts").alias("part"))
    texts = asked.join(texts, [*NODE, "start"]).withColumns({"pair": F.lit(0).cast("long"), "centre": F.lit(0), "asks": F.lit(False), "own": F.lit(False)})
    both = dealt.withColumns({"own": F.lit(True), "part": F.lit(None).cast("binary")}).unionByName(texts)
    ship(docs.sparkSession)
    work = partial(compare_windows, similarity=similarity, width=width, shingle=shingle)
    rest = both.groupBy("unit").applyInArrow(lambda table: work(table), f"doc_id long, tag long, o_doc_id long, o_tag long, spans {SPAN}")
    return sure.unionByName(rest)


def repeated_passages(docs: DataFrame, least: int = 50, shingle: int = 5, similarity: float = 0.8, functions: int = FUNCTIONS, agree: int = AGREE) -> DataFrame:
    """``doc_id, tag, other, spans``: passages of (doc_id, tag) that the smaller document ``other`` nearly repeats.

    Spans count words, ``[start, end)``.  An identical text of ``least`` words or more is one span over the whole.
    """
    width = least - shingle + 1
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    plain = tagged(plain, "doc_id", F.col("text"))
    keys = cut(text_keys(plain).where(F.col("n_words") >= least))
    classes = keys.groupBy("k1", "k2").agg(F.min(node()).alias("rep"), F.max(node()).alias("last")).where("rep < last")
    copies = cut(keys.join(classes, ["k1", "k2"]).where(node() != F.col("rep")).select(*NODE, F.col("rep.doc_id").alias("other")).distinct())
    heads = join_checked(plain, copies.select(*NODE), NODE, "left_anti")
    found = written(all_windows(heads, shingle, width, functions))  # read twice, found once
    number = one_number("doc_id")
    groups = found.groupBy("key").agg(F.count("*").alias("count"), F.min(number).alias("x"), F.max(number).alias("y"))
    groups = cut(groups.where("x < y").select("key", "count"))
    rows = written(join_spread(found, groups, "key", node(), counts=groups, hashed=True).drop("count"))
    forget(found)
    rows = rows.withColumn("open", F.lit(True))
    linked = linked_to(rows, first_window(rows, "key"), "key", groups)
    sure = cut(verify(heads, cut(candidates(linked, agree, width)), shingle, similarity, width))
    explained = explained_spans(sure)
    rows = still_open(rows, explained)
    ends = asking_groups(rows, "key").drop("count")
    left = written(join_spread(rows, ends, "key", node(), counts=groups, hashed=True).where("doc_id <= y").drop("y"))
    rest = settle(heads, left, explained, shingle, similarity, width, functions)
    found = sure.unionByName(rest).select(*NODE, F.col("o_doc_id").alias("other"), "spans")
    whole = F.array(F.struct(F.lit(0).cast("int").alias("start"), F.lit(2**31 - 1).cast("int").alias("end")))
    return found.unionByName(copies.select(*NODE, "other", whole.alias("spans")))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return W.spans(np.frombuffer(data, np.uint8), W.table(W.SPACES)) if data else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def without_passages(text: str | None, spans) -> tuple[str, int, int]:
    """A text without some spans of words, its number of words and how many went."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not len(spans):
        return text or "", len(data.split()), 0
    starts, _ = word_places(data)
    gone = np.zeros(len(starts) + 1, np.int64)
    for span in spans:
        if span["start"] < len(starts):
            gone[span["start"]] += 1
            gone[min(span["end"], len(starts))] -= 1
    out = np.cumsum(gone[:-1]) > 0
    if not out.any():
        return text or "", len(starts), 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
    kept, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):  # a passage goes with the white space behind it
        kept.append(data[at : starts[a]])
        at = starts[b] if b < len(starts) else len(data)
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "replace"), len(starts), int(out.sum())


def listed(found: DataFrame) -> DataFrame:
    """``doc_id, tag, hint, others``: all spans of each document and the documents that hold them."""
    found = cut(found)
    return found.groupBy(*NODE).agg(F.flatten(F.collect_list("spans")).alias("hint"), F.array_sort(F.collect_set("other")).alias("others"))


def clean_passages(docs: DataFrame, least: int = 50, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all their columns, without the passages that :func:`repeated_passages` finds."""
    hints = listed(repeated_passages(docs, least, shingle, similarity)).drop("others")
    return rewrite(docs, hints, lambda text, spans: without_passages(text, spans)[0], NODE)


def dedup_passages(docs: DataFrame, least: int = 50, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, text, n_words, n_repeated, others`` without the repeated passages, a row for each row of ``docs``.

    ``others`` lists smaller documents that hold the passages of this one, at least one for each passage.
    """
    hints = listed(repeated_passages(docs, least, shingle, similarity)).withColumnRenamed("hint", "spans")
    plain = tagged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", F.col("text"))
    both = join_checked(plain, cut(hints), NODE, "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_words, n_repeated = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text, words, repeated = without_passages(text, spans or ())
            texts.append(text)
            n_words.append(words)
            n_repeated.append(repeated)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_repeated, pa.int64()), batch.column("others")],
            ["doc_id", "text", "n_words", "n_repeated", "others"],
        )

    return by_batch(both.select("doc_id", "text", "spans", "others"), work, "doc_id long, text string, n_words long, n_repeated long, others array<long>")
