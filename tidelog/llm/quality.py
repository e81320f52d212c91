"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed byte trigrams, and the count of words that repeat the word
before, is shared by all grades: a text's strength is the mean of its features' weights,
damped by count, and ordered thresholds turn it into P(grade > k) = logistic(strength - threshold k). From these follow the expected grade
and the tail probability of reaching ``WANTED``, by which documents are selected.

The model is fitted to at most about ``LEARN_FROM`` labelled documents of each grade
outside the held-out fold, by a hash of the id, and the intercepts are then moved back to
the grades' true shares. Fitting is full-batch gradient ascent on the driver over that
bounded sample; scoring is row by row over whole texts and needs no shuffle.

Defined results: null text is the empty text, whose strength is 0. Ties can't matter, rows
are scored alone. Labels that are null, or of documents that don't exist, aren't used; a
document labelled more than once counts once for each label. With one grade only, every
document gets that grade, and is kept where the grade is ``WANTED`` or more. Without
labels there is no grade and no probability, both null, and all are kept. Very long texts
are hashed piece by piece. Other columns, whatever their names, are kept by ``score``,
which replaces its own.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import beside, boxed, held_out, labelled_sample, table, unboxed
from tidelog.llm.ngrams import counts_of

ORDER, BITS = 3, 13
#: Hashed trigrams, and one for repeated words.
BINS = (1 << BITS) + 1
#: Labelled documents of a grade to learn from, about, at most.
LEARN_FROM = 3000
STEPS, RATE, SHRINK = 250, 0.05, 1e-4
#: Documents are kept where the probability of this grade or more is at least KEEP_FROM.
WANTED, KEEP_FROM = 1, 0.5


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the whole text and their values, of length 1 together. The last bin counts words said again at once."""
    text = text if isinstance(text, str) else ""
    words = text.split()
    counts = np.append(counts_of(text.encode(), ORDER, BITS), sum(map(operator.eq, words, words[1:])))
    bins = np.flatnonzero(counts)
    values = np.sqrt(counts[bins])
    return bins, values / max(1e-12, float(np.sqrt(values @ values)))


@dataclass
class Model:
    grades: list[int]
    #: A weight for each bin, and the ordered thresholds between grades. With one grade, or none, there are no thresholds.
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        bins, values = features(text)
        return logistic(values @ self.weights[bins] - self.thresholds)

    def rated(self, text: str | None, wanted: int) -> tuple[float | None, float | None]:
        """The expected grade, and the probability of ``wanted`` or more."""
        if not self.grades:
            return None, None
        above = self.above(text)
        expected = self.grades[0] + float(above @ np.diff(np.array(self.grades, float)))
        under = sum(g < wanted for g in self.grades)
        return expected, 1.0 if under == 0 else 0.0 if under == len(self.grades) else float(above[under - 1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, shares: dict[int, float]) -> Model:
    """rows: features; grades: the rating of each; shares: each grade's share of all labelled rows."""
    known = sorted(set(grades.tolist()))
    if len(known) < 2:
        return Model(known, np.zeros(BINS), np.zeros(0))
    y = np.searchsorted(known, grades)
    bins, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n, k = len(rows), len(known) - 1
    # Thresholds are a first one and steps exp(gap), so that they stay in order.
    reached = np.array([(y > i).mean() for i in range(k)])
    base = -np.log(reached / (1 - reached))
    theta = np.concatenate([np.zeros(BINS), base[:1], np.log(np.maximum(np.diff(base), 1e-3))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    d = BINS
    for step in range(1, STEPS + 1):
        steps = np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0], np.cumsum(steps)])
        strength = np.bincount(row, values * theta[bins], n)
        # P(grade <= i) with walls at both ends; a row's likelihood is the difference at its grade.
        below = np.column_stack([np.zeros(n), logistic(cuts[None, :] - strength[:, None]), np.ones(n)])
        upper, lower = below[np.arange(n), y + 1], below[np.arange(n), y]
        chance = np.maximum(upper - lower, 1e-9)
        by_cut = np.zeros((n, k))
        slope_up, slope_low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        at_up, at_low = y < k, y > 0
        by_cut[np.flatnonzero(at_up), y[at_up]] += slope_up[at_up]
        by_cut[np.flatnonzero(at_low), y[at_low] - 1] -= slope_low[at_low]
        by_strength = slope_low - slope_up
        grad_cut = by_cut.mean(axis=0)
        gradient = np.concatenate([np.bincount(bins, values * by_strength[row], d) / n - SHRINK * theta[:d], [grad_cut.sum()], [grad_cut[i + 1 :].sum() * steps[i] for i in range(k - 1)]])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta += 10 * RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    cuts = theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))])
    # The sample is even over grades; the labelled rows are not.
    total = sum(shares[g] for g in known)
    real = np.array([sum(shares[g] for g in known[i + 1 :]) / total for i in range(k)])
    moved = np.log(reached / (1 - reached)) - np.log(real / (1 - real))
    return Model(known, theta[:d], np.maximum.accumulate(cuts + moved))


def learn(labelled: DataFrame, counts: dict[int, int]) -> Model:
    """labelled: text and quality (int), a bounded sample; counts: how many labels there are of each grade."""
    total = sum(counts.values())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), batch.column(1)], names=["bins", "weights", "grade"])

    sample = labelled.select("text", F.col("quality").alias("grade")).mapInArrow(rows, "bins binary, weights binary, grade int")
    got = sample.toPandas()
    # In a fixed order, so that sums come out alike in each run.
    got = got.sort_values(["grade", "bins", "weights"], kind="stable")
    return fit([(np.frombuffer(b, "<i4").astype(np.int64), np.frombuffer(w, "<f4")) for b, w in zip(got["bins"], got["weights"], strict=True)], got["grade"].to_numpy(np.int64), {g: n / total for g, n in counts.items()})


def score(df: DataFrame, model: Model, text_col: str = "text", wanted: int = WANTED) -> DataFrame:
    """``df`` with expected_grade, tail_probability and keep in place of columns so named."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            yield pd.DataFrame([own.rated(t, wanted) for t in texts], columns=["expected_grade", "tail_probability"], dtype=object)

    rated = rate(F.col(text_col).cast("string"))
    keep = F.coalesce(rated["tail_probability"] >= KEEP_FROM, F.lit(True))
    return beside(df, F.struct(rated["expected_grade"].alias("expected_grade"), rated["tail_probability"].alias("tail_probability"), keep.alias("keep")), "expected_grade", "tail_probability", "keep")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    return learn(*labelled_sample(docs, labels, "quality", LEARN_FROM))


def keep_good(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with its columns."""
    rated = score(boxed(df, text=F.col("text")), model)
    return unboxed(rated.where("keep").select("row"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "keep")
