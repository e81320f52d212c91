"""Language ID by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased text without
digits and ASCII punctuation. A document is a mixture: expectation-maximisation estimates
the languages' proportions from the n-gram likelihoods. Languages are then taken in order
of proportion, and the set with the best penalised likelihood is kept; each further
language must pay half the log of the n-gram count, and ``PER_NGRAM`` a trigram, since
trigrams of one text aren't independent. The proportions are estimated again within the
set. The prediction is its largest language and the score that language's proportion.

The model is counted from at most about ``LEARN_FROM`` documents of each language outside
the held-out fold, by a hash of the id; every document is predicted, over its whole text.
Counts are summed by task before they meet. Prediction needs no shuffle.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing
was learned. Ties go to the language first in code point order. Documents with null lang
are predicted but never learned from. Very long texts are hashed piece by piece. Other
columns, whatever their names, are kept by ``predict``, which replaces its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import beside, bounded_sample, held_out, table
from tidelog.llm.ngrams import counts_of

ORDER, BITS = 3, 13
#: Documents of a language to learn from, about, at most.
LEARN_FROM = 4000
#: Of the smoothing, in counts a bin; of EM; of the penalty, in nats.
SMOOTHING, ROUNDS, STEADY, PER_NGRAM = 0.1, 25, 1e-4, 0.02
BLANKED = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def profile(text: str) -> np.ndarray:
    return counts_of(b" " + text.lower().encode().translate(BLANKED) + b" ", ORDER, BITS)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled: text, lang and doc_id. The languages in order, and each one's distribution over bins as a column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                sums[lang] += profile(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bin": at.astype(np.int32), "n": total[at]})

    sample, _ = bounded_sample(labelled.where("lang is not null and text is not null"), "lang", LEARN_FROM)
    found = sample.select("text", "lang").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((1 << BITS, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (found["bin"].to_numpy(np.int64), found["lang"].map(column).to_numpy(np.int64)), found["n"].to_numpy(float))
    return languages, (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)


def proportions(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over a document's bins: the share of each column, and the log likelihood."""
    share, total = np.full(likelihood.shape[1], 1 / likelihood.shape[1]), n.sum()
    if len(share) == 1:
        return share, float(n @ np.log(likelihood[:, 0]))
    for _ in range(ROUNDS):
        fresh = ((n / (likelihood @ share)) @ likelihood) * share / total
        done = np.abs(fresh - share).max() < STEADY
        share = fresh
        if done:
            break
    return share, float(n @ np.log(likelihood @ share))


def mixture(text: str, model: np.ndarray) -> dict[int, float]:
    """The chosen set of languages (columns of ``model``) with their shares."""
    counts = profile(text)
    bins = np.flatnonzero(counts)
    n, likelihood = counts[bins].astype(float), model[bins]
    total = n.sum()
    ranked = np.argsort(-proportions(likelihood, n)[0], kind="stable")
    price = 0.5 * math.log(total + 1) + PER_NGRAM * total
    # The likeliest single language first: EM's largest share need not be it.
    ranked = [int(np.argmax(n @ np.log(likelihood))), *ranked]
    ranked = list(dict.fromkeys(int(k) for k in ranked))
    best, chosen = -math.inf, {}
    for size in range(1, len(ranked) + 1):
        share, fit = proportions(likelihood[:, ranked[:size]], n)
        if fit - price * size <= best:
            break
        best, chosen = fit - price * size, dict(zip(ranked[:size], share.tolist(), strict=True))
    return chosen


def predict(df: DataFrame, languages: list[str], model: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and lang_shares (a map) in place of columns so named."""
    shared = df.sparkSession.sparkContext.broadcast((languages, model))

    @F.pandas_udf("lang_pred string, score double, lang_shares map<string,double>")
    def infer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, columns = shared.value
        for texts in parts:
            out = []
            for text in texts:
                if not isinstance(text, str) or not names or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, {}))
                    continue
                found = mixture(text, columns)
                top = min(found, key=lambda k: (-found[k], names[k]))
                out.append((names[top], min(1.0, found[top]), {names[k]: v for k, v in found.items()}))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "lang_shares"])

    return beside(df, infer(F.col(text_col).cast("string")), "lang_pred", "score", "lang_shares")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    languages, model = learn(docs.where("not held_out"))
    return predict(docs, languages, model).select("doc_id", "held_out", "lang_pred", "score")
