"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes 24 statistics of its whole text, counted over byte buffers with numpy: sizes, shares of
character classes, word lengths, vocabulary, repeated words, word triples and lines.  Training takes at most
``bound`` labelled documents outside the held-out fold (a documented bound; 24 numbers for each), so the model is
fitted on the driver whatever the corpus.  Trees grow on histograms of 64 quantile bins with logistic loss; the
fitted trees are flattened into arrays, and scoring walks all documents of a batch down each tree at once.
Neither language, source, id nor label is an input.

Results for odd input: a null text counts as empty and is scored like one; a null ``doc_id`` is scored and not
held out; repeated rows are scored one by one; other columns are left alone; an empty table gives an empty
result; without labels of both kinds every score is their share (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import GROUP_BYTES, by_batch, held_out, labelled_sample

#: Largest number of labelled documents that training takes.
BOUND = 20_000
#: Byte classes: lower, upper, digit, space, newline, full stop or comma, ``!?``, ``|``, ``*#$%&``, other ASCII, beyond ASCII.
N_CLASSES = 11
NAMES = (
    "log_bytes log_words log_lines lower upper digit space newline stop loud bar symbol other wide word_length "
    "word_spread distinct_words top_word repeated_triples repeated_lines line_words short_lines words_per_stop symbol_words"
).split()


def classes() -> np.ndarray:
    out = np.full(256, 9)
    for number, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,", "!?", "|", "*#$%&")):
        out[[ord(c) for c in chars]] = number
    out[128:] = 10
    return out


CLASS = classes()


def group_statistics(texts: list[bytes]) -> np.ndarray:
    """The statistics of some texts, worked on as one buffer."""
    n = len(texts)
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    owner = np.repeat(np.arange(n), sizes + 1)
    kind = CLASS[data]
    counts = np.bincount(owner * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    counts[:, 4] -= 1
    size = np.maximum(sizes, 1)
    starts, ends = W.spans(data, W.table(W.SPACES))
    words = W.polynomial(W.WEIGHTS[data], starts, ends)
    word_owner = owner[starts]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(word_owner, minlength=n))))
    n_words = np.maximum(np.diff(bounds), 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(word_owner, length, n) / n_words
    spread = np.sqrt(np.maximum(np.bincount(word_owner, length**2, n) / n_words - mean**2, 0))
    ends_odd = (kind[ends - 1] == 8) | (kind[ends - 1] == 6) | (kind[ends - 1] == 7)
    odd = np.bincount(word_owner, ends_odd, n) / n_words
    triples, triple_bounds = W.shingles(words, bounds, 3)
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    line_owner = owner[line_ends]
    lines = W.polynomial(W.WEIGHTS[data], line_starts, line_ends)
    line_bounds = np.concatenate(([0], np.cumsum(np.bincount(line_owner, minlength=n))))
    short = np.bincount(line_owner, (line_ends - line_starts) < 20, n) / np.diff(line_bounds)
    distinct, top, repeat3, repeat_lines = (np.zeros(n) for _ in range(4))
    for k in range(n):
        own, count = np.unique(words[bounds[k] : bounds[k + 1]], return_counts=True)
        distinct[k] = len(own) / n_words[k]
        top[k] = count.max() / n_words[k] if len(own) else 0
        some = triples[triple_bounds[k] : triple_bounds[k + 1]]
        repeat3[k] = 1 - len(np.unique(some)) / max(1, len(some))
        some = lines[line_bounds[k] : line_bounds[k + 1]]
        repeat_lines[k] = 1 - len(np.unique(some)) / len(some)
    n_lines = np.diff(line_bounds)
    columns = [
        np.log1p(sizes), np.log1p(np.diff(bounds)), np.log(n_lines), *(counts[:, k] / size for k in range(N_CLASSES)),
        mean, spread, distinct, top, repeat3, repeat_lines, n_words / n_lines, short, n_words / (1 + counts[:, 5]), odd,
    ]
    return np.stack(columns, axis=1)


def statistics(texts: list) -> np.ndarray:
    """The statistics of every text, a row each; None counts as empty."""
    out, group, held = [], [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and held + len(data) > GROUP_BYTES:
            out.append(group_statistics(group))
            group, held = [], 0
        group.append(data)
        held += len(data)
    if group:
        out.append(group_statistics(group))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """Boosted trees as flat arrays: node ``k`` sends a row to ``left[k]`` if its feature is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(below, self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Boost trees of at most ``depth`` levels on the logistic loss of labels 0 and 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    score = np.full(len(y), base)

    def grow(rows: np.ndarray, level: int) -> int:
        g, h = gradient[rows], weight[rows]
        total_g, total_h = g.sum(), h.sum()
        here = len(nodes)
        nodes.append([0, np.inf, here, here, -rate * total_g / (total_h + l2)])
        best, found = 1e-6, None
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                b, size = binned[rows, f], len(edges[f]) + 1
                if size < 2:
                    continue
                left_g, left_h = (np.cumsum(np.bincount(b, z, size))[:-1] for z in (g, h))
                count = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                gain = np.where((count >= least) & (len(rows) - count >= least), gain, 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], (f, k)
        if found:
            f, k = found
            down = binned[rows, f] <= k
            nodes[here][:2] = [f, edges[f][k]]
            nodes[here][2] = grow(rows[down], level + 1)
            nodes[here][3] = grow(rows[~down], level + 1)
        else:
            score[rows] += nodes[here][4]
        return here

    if len(np.unique(y)) == 2:
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0))
    table = np.array(nodes or [[0, np.inf, 0, 0, 0.0]])
    whole = [table[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Trees(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots, np.int64), base, depth)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Trees:
    """Trees fitted to ``labels.quality`` of at most ``bound`` documents outside the held-out fold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text").to_pylist())
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), flat], ["doc_id", "label", "x"])

    sample = by_batch(labelled_sample(docs, labels, "quality", bound).select("doc_id", "label", "text"), work, "doc_id long, label int, x array<double>")
    rows = sample.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows.x.tolist()).reshape(len(rows), len(NAMES))
    return fit(x, (rows.label.to_numpy() > 0).astype(float))


def classify(docs: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs (doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(statistics(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = by_batch(plain, work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.score(statistics(batch.column("text").to_pylist())) >= least))

    return by_batch(docs, work, docs.schema)
