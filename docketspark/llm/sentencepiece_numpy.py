"""SentencePiece encoding and decoding with batched numpy.

A text is cut where no piece can reach across (before a space mark that follows other characters, and at line ends
if no piece holds one), so it becomes a sequence of short words, most of them seen before.  Each task keeps a
bounded table of words and their ids; only new words are encoded, all of a batch at once: words of equal length
form a matrix of code points and advance together, and the hash of any substring, from prefix sums, is probed in
the sorted keys of the pieces.

Two searches share that machinery, chosen by the model file itself:

* a unigram model takes the segmentation with the best sum of scores: Viterbi, in which vectorised maxima over the
  pieces ending at each position store back-pointers;
* a merge (BPE) model, such as the public 32k file, ranks its merges by score, and the best sum of scores is not
  the segmentation those merges give; there the best adjacent pair of every word is merged, word by word in step.

Characters that no piece covers become byte pieces, or the unknown id without byte fallback.  Decoding joins the
pieces' bytes, turns space marks into spaces and drops the one put before the text.

Results for odd input: a null or empty text has no ids and decodes to an empty text; a null ``doc_id`` is encoded
like any other; null ids decode to an empty text and ids outside the vocabulary fail; other columns are left alone;
an empty table gives an empty result.  Models that normalise characters or squeeze spaces are refused.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from . import words as W
from .shared import by_batch

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words kept in a task's table, longest word that is merged in step with others, and penalty of an unknown character.
WORDS_KEPT, IN_STEP, UNKNOWN_PENALTY = 300_000, 256, 10.0
NONE = -np.inf


class Pieces:
    """The pieces of a model file, with their substring hashes in sorted order."""

    def __init__(self, data: bytes):
        model = model_pb2.ModelProto()
        model.ParseFromString(data)
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("models that normalise their text are not supported")
        kinds = [p.type for p in model.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds or trainer.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.dummy, self.merges = norm.add_dummy_prefix, trainer.model_type == BPE
        self.text = [p.piece for p in model.pieces]
        usable = [k for k, kind in enumerate(kinds) if kind == NORMAL]
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(self.text[k][3:5], 16): k for k, kind in enumerate(kinds) if kind == BYTE} if trainer.byte_fallback else {}
        scores = np.array([p.score for p in model.pieces])
        self.floor = float(scores[usable].min()) - UNKNOWN_PENALTY
        self.longest = max(len(self.text[k]) for k in usable)
        if any(MARK in self.text[k].lstrip(MARK) for k in usable):
            raise ValueError("pieces that reach over a space are not supported")
        self.lines = not any("\n" in self.text[k] for k in usable)
        keys = np.array([substring_keys(code_points([self.text[k]]), 0, len(self.text[k]))[0] for k in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.scores = scores[self.ids]
        self.out = [p.piece.replace(MARK, " ").encode() if kind == NORMAL else b"" for p, kind in zip(model.pieces, kinds, strict=True)]
        self.out[self.unknown] = " ⁇ ".encode()
        for value, k in ((int(self.text[k][3:5], 16), k) for k, kind in enumerate(kinds) if kind == BYTE):
            self.out[k] = bytes([value])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted pieces of each substring hash, and whether it is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


def code_points(words: list[str]) -> np.ndarray:
    """Matrix of the code points of words of equal length."""
    data = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").reshape(len(words), -1)


def prefix_sums(points: np.ndarray) -> np.ndarray:
    up, _ = W.powers(points.shape[1] + 1)
    total = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    np.cumsum(W.mix(points.astype(np.uint64) + W.U(99)) * up[: points.shape[1]], axis=1, out=total[:, 1:])
    return total


def substring_keys(points: np.ndarray, start: int, end: int) -> np.ndarray:
    return span_keys(prefix_sums(points), np.arange(len(points)), np.full(len(points), start), np.full(len(points), end))


def span_keys(total: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings ``[start, end)`` of the rows."""
    _, down = W.powers(total.shape[1])
    return W.mix((total[rows, end] - total[rows, start]) * down[start])


def viterbi(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Best-scoring segmentation of words of equal length, all advancing together."""
    points = code_points(words)
    m, length = points.shape
    total, rows = prefix_sums(points), np.arange(m)
    best = np.full((m, length + 1), NONE)
    best[:, 0] = 0
    back, piece = np.zeros((m, length + 1), np.int64), np.full((m, length + 1), -1)
    for end in range(1, length + 1):
        for start in range(max(0, end - pieces.longest), end):
            at, there = pieces.find(span_keys(total, rows, np.full(m, start), np.full(m, end)))
            score = best[:, start] + np.where(there, pieces.scores[at], pieces.floor if end - start == 1 else NONE)
            better = score > best[:, end]
            best[:, end] = np.where(better, score, best[:, end])
            back[:, end] = np.where(better, start, back[:, end])
            piece[:, end] = np.where(better, np.where(there, pieces.ids[at], -1), piece[:, end])
    out: list[list[int]] = []
    for k in range(m):
        ids: list[int] = []
        end = length
        while end:
            start = back[k, end]
            ids[:0] = [int(piece[k, end])] if piece[k, end] >= 0 else pieces.fallback(words[k][start])
            end = start
        out.append(ids)
    return out


def merged(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Segmentation by merges of words of equal length: each step merges every word's best pair, leftmost first."""
    points = code_points(words)
    m, length = points.shape
    total = prefix_sums(points)
    out: list[list[int]] = [[]] * m
    rows = np.arange(m)
    starts = np.tile(np.arange(length + 1), (m, 1))

    def pair_scores(r: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, there = pieces.find(span_keys(total, r, a, b))
        return np.where(there, pieces.scores[at], NONE)

    scores = pair_scores(np.repeat(rows, length - 1), starts[:, :-2].ravel(), starts[:, 2:].ravel()).reshape(m, length - 1) if length > 1 else np.zeros((m, 0))
    while True:
        n = scores.shape[1]
        top = np.argmax(scores, axis=1) if n else np.zeros(len(rows), np.int64)
        live = scores[np.arange(len(rows)), top] > NONE if n else np.zeros(len(rows), bool)
        finish(pieces, words, total, rows[~live], starts[~live], out)
        rows, starts, scores, top = rows[live], starts[live], scores[live], top[live]
        if not len(rows):
            return out
        here = np.arange(len(rows))
        keep = np.ones(starts.shape, bool)
        keep[here, top + 1] = False
        starts = starts[keep].reshape(len(rows), -1)
        keep = np.ones(scores.shape, bool)
        keep[here, top] = False
        scores = scores[keep].reshape(len(rows), -1)
        n = scores.shape[1]
        for pair in (top - 1, top):  # the merged symbol's new neighbours
            fine = (pair >= 0) & (pair < n)
            r, p = here[fine], pair[fine]
            scores[r, p] = pair_scores(rows[r], starts[r, p], starts[r, p + 2])


def finish(pieces: Pieces, words: list[str], total: np.ndarray, rows: np.ndarray, starts: np.ndarray, out: list) -> None:
    """Ids of words whose symbols begin at ``starts``."""
    if len(rows):
        n = starts.shape[1] - 1
        at, there = pieces.find(span_keys(total, np.repeat(rows, n), starts[:, :-1].ravel(), starts[:, 1:].ravel()))
        ids = np.where(there, pieces.ids[at], -1).reshape(len(rows), n)
        whole = (ids >= 0).all(axis=1)
        for k, row in enumerate(rows):
            if whole[k]:
                out[row] = ids[k].tolist()
            else:
                out[row] = [x for j in range(n) for x in ([int(ids[k, j])] if ids[k, j] >= 0 else pieces.fallback(words[row][starts[k, j]]))]


def merged_long(pieces: Pieces, word: str) -> list[int]:
    """One very long word by merges, with a heap of pairs."""
    total = prefix_sums(code_points([word]))
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(starts: list[int]) -> None:
        starts = [a for a in starts if a >= 0 and after[a] < n]
        if starts:
            ends = [end[after[a]] for a in starts]
            at, there = pieces.find(span_keys(total, np.zeros(len(starts), np.int64), np.array(starts), np.array(ends)))
            for a, b, score, known in zip(starts, ends, pieces.scores[at], there, strict=True):
                if known:
                    heapq.heappush(heap, (-float(score), a, after[a], b))

    offer(list(range(n - 1)))
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if end[a] == b and after[a] == b and end[b] == stop:
            end[a], after[a] = stop, after[b]
            if after[a] < n:
                before[after[a]] = a
            end[b] = -1
            offer([before[a], a])
    starts = [a for a in range(n) if end[a] > a]
    out: list[list[int]] = [[]]
    finish(pieces, [word], total, np.array([0]), np.array([[*starts, n]]), out)
    return out[0]


def encode_words(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Ids of words, in which spaces are already space marks."""
    out: list[list[int]] = [[]] * len(words)
    groups: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        groups.setdefault(len(word), []).append(k)
    for length, members in groups.items():
        for at in range(0, len(members), 20_000):
            some = members[at : at + 20_000]
            own = [words[k] for k in some]
            if pieces.merges and length > IN_STEP:
                ids = [merged_long(pieces, x) for x in own]
            else:
                ids = merged(pieces, own) if pieces.merges else viterbi(pieces, own)
            for k, x in zip(some, ids, strict=True):
                out[k] = x
    return out


class Encoder:
    """Encodes texts with a table of the words seen."""

    def __init__(self, data: bytes):
        self.pieces = Pieces(data)
        self.known: dict[str, list[int]] = {}
        self.cuts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.pieces.lines else f"{MARK}*[^{MARK}]+|{MARK}+")

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.pieces.dummy else "") + text.replace(" ", MARK)
        return self.cuts.findall(marked)

    def encode(self, texts: list) -> list[np.ndarray]:
        parts = [self.words(x or "") for x in texts]
        known = self.known
        new = [x for x in set().union(*parts) if x not in known]
        made = dict(zip(new, encode_words(self.pieces, new), strict=True))
        if len(known) < WORDS_KEPT:  # common words come early and stay; later new ones serve their batch only
            known.update(made)
            made = known
        else:
            made.update((x, known[x]) for x in set().union(*parts) if x in known)
        return [np.array([k for x in part for k in made[x]], np.int32) for part in parts]

    def decode(self, ids: list[int]) -> str:
        out = self.pieces.out
        if ids and min(ids) < 0:
            raise IndexError("negative id")
        data = b"".join([out[k] for k in ids])
        if self.pieces.dummy and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def load(model_file: str) -> bytes:
    with open(model_file, "rb") as source:
        return source.read()


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids``, a row for each row of ``docs (doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))  # one vocabulary file, whatever the corpus

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(shared.value).encode(batch.column("text").to_pylist())
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids, text``, a row for each row of ``encoded (doc_id, ids)``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = encoder(shared.value)
        lists = batch.column("ids")
        flat, sizes = lists.flatten().to_numpy(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        texts = [made.decode(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return by_batch(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, text string")
