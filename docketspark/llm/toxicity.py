"""Toxicity by cumulative-link ordinal regression over sparse words.

A text becomes the hashed words it holds and their beginnings of four and five bytes, weighted
``log(1 + count)``; beginnings let rare forms of a word count like the common ones.  Severity has three ordered grades: clean,
toxic, and severely toxic.  The labels only tell clean from toxic, so the training rows' upper grade is set by how
often a toxic text uses words that mark toxic texts: twice the toxic texts' median or more is grade 2.  One
weight vector serves all thresholds: ``P(grade > k) = sigmoid(w . x - t_k)`` with ``t_0 < t_1``, so a word moves a
text along one scale; the expected severity is ``P(grade > 0) + P(grade > 1)``.

Training takes at most ``bound`` labelled documents outside the held-out fold and keeps the ``TERMS`` hashed words
that tell the classes apart best; both bounds are documented, and only the counts of those words are fitted on the
driver, whatever the corpus or the length of its texts.  Every document is then scored over its whole text.

Results for odd input: a null or empty text has no words and gets the score of an empty text; a null ``doc_id`` is
scored and not held out; repeated rows are scored one by one; other columns are left alone; an empty table gives
an empty result; without toxic labels every severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import by_batch, cut, held_out, labelled_sample

BOUND, SLOTS, TERMS = 20_000, 1 << 24, 2048
BEGINNINGS = (4, 5)
#: Words are runs of letters: all other ASCII characters part them.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())


def sparse(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and count of every distinct word or beginning of each text."""
    pairs = []
    for prefix in (None, *BEGINNINGS):
        hashes, bounds = W.word_hashes(texts, SEPARATORS, prefix=prefix)
        slot = (W.mix(hashes + W.U(prefix or 0)) >> W.U(40)).astype(np.int64)
        pairs.append(np.repeat(np.arange(len(texts)), np.diff(bounds)) * SLOTS + slot)
    pair, count = np.unique(np.concatenate(pairs), return_counts=True)
    return pair // SLOTS, pair % SLOTS, count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Sorted hashed words with their weights, and the ordered thresholds."""

    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list) -> np.ndarray:
        """``P(grade > k)`` of each text, a column for each threshold."""
        row, slot, count = sparse(texts)
        at = np.searchsorted(self.terms, slot)
        known = np.append(self.terms, -1)[at] == slot if len(self.terms) else np.zeros(len(slot), bool)
        total = np.bincount(row[known], np.log1p(count[known]) * self.weights[at[known]], len(texts))
        return sigmoid(total[:, None] - self.thresholds[None, :])


def fit(row: np.ndarray, slot: np.ndarray, count: np.ndarray, toxic: np.ndarray, terms: np.ndarray, marks: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> Ordinal:
    """Fit sparse weights and the thresholds to the ordinal likelihood under an absolute-value penalty.

    ``row, slot, count`` hold the training texts' chosen terms; ``marks`` are the terms that mark toxic texts.
    """
    n, toxic = len(toxic), toxic.astype(bool)
    n1 = toxic.sum()
    n0 = n - n1
    if not n1 or not n0:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(2, -40.0 if n1 else 40.0))
    marked = np.isin(slot, marks)
    uses = np.bincount(row[marked], count[marked], n)
    grade = toxic.astype(int) + (toxic & (uses >= 2 * np.median(uses[toxic])))
    column, value = np.searchsorted(terms, slot), np.log1p(count)
    balance = np.where(toxic, 0.5 / n1, 0.5 / n0)

    def fitted(at: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its slope."""
        w, t0, t1 = at[:-2], at[-2], at[-2] + np.exp(at[-1])
        score = np.bincount(row, value * w[column], n)
        p0, p1 = sigmoid(score - t0), sigmoid(score - t1)
        d0, d1 = p0 * (1 - p0), p1 * (1 - p1)
        middle = np.maximum(p0 - p1, 1e-9)
        pull0 = np.select([grade == 0, grade == 1], [p0, -d0 / middle], 0.0) * balance
        pull1 = np.select([grade == 1, grade == 2], [d1 / middle, p1 - 1], 0.0) * balance
        pull = pull0 + pull1
        loss = -(balance * np.log(np.select([grade == 0, grade == 1], [np.maximum(1 - p0, 1e-12), middle], np.maximum(p1, 1e-12)))).sum()
        return loss, np.concatenate([np.bincount(column, value * pull[row], len(w)), [-pull.sum(), -pull1.sum() * np.exp(at[-1])]])

    theta = np.concatenate([np.zeros(len(terms)), [1.0, 0.0]])
    ahead, pace, rate = theta.copy(), 1.0, 1.0
    for _ in range(steps):  # accelerated proximal steps; the penalty leaves words at zero that others explain
        loss, slope = fitted(ahead)
        while True:
            moved = ahead - rate * slope
            moved[:-2] = np.sign(moved[:-2]) * np.maximum(np.abs(moved[:-2]) - rate * penalty, 0)
            step = moved - ahead
            if rate < 1e-6 or fitted(moved)[0] <= loss + slope @ step + step @ step / (2 * rate) + 1e-12:
                break
            rate /= 2
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if (ahead - moved) @ (moved - theta) > 0:
            faster = 1.0
        ahead = moved + (pace - 1) / faster * (moved - theta)
        theta, pace = moved, faster
    live = np.flatnonzero(theta[:-2])
    return Ordinal(terms[live], theta[live], np.array([theta[-2], theta[-2] + np.exp(theta[-1])]))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, terms: int = TERMS) -> Ordinal:
    """Model of ``labels.toxic`` from at most ``bound`` documents outside the held-out fold.

    Toxic and clean documents are sampled apart, up to half the bound each.  Spark counts in how many texts of
    either kind each term occurs and ranks the terms; the driver gets the sample's counts of the best ``terms``.
    """
    halves = [labelled_sample(docs, labels.where(F.col("toxic").cast("int") == k), "toxic", bound // 2) for k in (0, 1)]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, slot, number = sparse(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), batch.column("label").take(pa.array(row)), pa.array(slot), pa.array(number)],
            ["doc_id", "label", "slot", "number"],
        )

    sample = halves[0].unionByName(halves[1]).select("doc_id", "label", "text")
    held = cut(by_batch(sample, count, "doc_id long, label int, slot long, number long"))
    known = held.select("doc_id", "label").distinct().toPandas().sort_values(["label", "doc_id"])
    n1 = int(known.label.sum())
    n0 = len(known) - n1
    rates = [(F.col(f"n{k}") + 0.5) / (n + 1) for k, n in ((0, n0), (1, n1))]
    ranked = (
        held.groupBy("slot")
        .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
        .where("n0 + n1 >= 3")
        .withColumn("odds", F.log(rates[1] / (1 - rates[1])) - F.log(rates[0] / (1 - rates[0])))
        .withColumn("strength", F.abs("odds") / F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5)))
        .where("abs(odds) >= 1.5 and strength > 2")
    )
    best = ranked.orderBy(F.desc("strength"), "slot").limit(terms).toPandas().sort_values("slot")
    chosen = best.slot.to_numpy(np.int64)
    marks = best.slot[(best.odds > 2) & (best.n1 >= 3)].to_numpy(np.int64)
    rows = held.join(F.broadcast(docs.sparkSession.createDataFrame(best[["slot"]], "slot long")), "slot").toPandas()
    rows = rows.sort_values(["label", "doc_id", "slot"])
    place = {doc: k for k, doc in enumerate(known.doc_id)}
    at = np.array([place[x] for x in rows.doc_id], np.int64)
    return fit(at, rows.slot.to_numpy(np.int64), rows.number.to_numpy(float), known.label.to_numpy(), chosen, marks)


def grade(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """``doc_id, held_out, severity, p_toxic, p_severe, toxic``, a row for each row of ``docs (doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS weights

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        above = shared.value.above(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 1])], ["doc_id", "severity", "p_toxic", "p_severe"]
        )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = by_batch(plain, work, "doc_id long, severity double, p_toxic double, p_severe double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "p_toxic", "p_severe", (F.col("p_toxic") >= least).alias("toxic")
    )
