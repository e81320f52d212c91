"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text are rates per 100 words and counts: hits of a fixed lexicon of
insults and of a lexicon learned from labels, words that only match once obfuscation is
undone, hits near a second-person word, second-person words, capitals, punctuation and
its runs, and obfuscated words. Trees are fitted by histogram boosting on the logistic
loss; isotonic regression of out-of-fold scores turns a score into a probability.

The learned lexicon holds words, and starts of words, that are much commoner in toxic
documents. It is learned fold by fold for the rows that the trees are fitted to, so that
no row's own label reaches its features, and once from all rows for scoring.

Fitting uses at most about ``LEARN_FROM`` labelled documents of each class outside the
held-out fold, by a hash of the id. Labels, lang, source and doc_id are never inputs of a
score. Scoring is row by row over whole texts and needs no shuffle.

Defined results: null text is the empty text and gets the score of no evidence. Rows are
scored alone, so ties and repeats don't matter. Null labels aren't used; a document
labelled more than once counts once for each label. Where labels have one class only, or
there are none, every score is that class, or 0. Other columns are kept by ``score``,
which replaces its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import held_out, labelled_sample, table

#: Labelled documents of a class to learn from, about, at most.
LEARN_FROM = 6000
FOLDS = 8
#: A learned entry: documents that hold it, how much commoner it is in toxic ones (log odds), entries kept.
SUPPORT, ODDS, ENTRIES = 2, 3.0, 4000
#: Lengths of the starts of words that the learned lexicon may hold.
STARTS = (4, 5, 6, 7)
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 3, 0.2, 32, 3, 0.5
#: Words between a hit and a second-person word that count as near.
NEAR = 5
#: Distinct words whose features a worker keeps.
CACHED = 300_000

# Insults, second-person words and look-alike characters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic disgusting worthless clown clowns imbecile cretin fool jerk creep filth vermin ugly hate shut idiota imbécil estúpido estúpida basura asqueroso inútil idiotin dummkopf blöd trottel abschaum widerlich wertlos crétin débile ordure nul dégoûtant minable".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros".split())
LOOKALIKES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "8": "b", "9": "g", "+": "t", "€": "e"})
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…–—-*_~`#%&|/\\"
VOWELS = str.maketrans("", "", "aeiouáéíóúäöüèêëàâôûîï")

NAMES = ("insults", "learned", "weight", "uncovered", "near", "second", "capitals", "shouted", "marks", "runs", "obfuscated", "spelled")


@dataclass
class Lexicon:
    """Weights of learned words and starts of words, and consonant skeletons of the words."""

    weights: dict[str, float] = field(default_factory=dict)
    skeletons: frozenset[str] = frozenset()

    @classmethod
    def of(cls, weights: dict[str, float]) -> Lexicon:
        words = INSULTS | {w[1:] for w in weights if w[0] == "w"}
        return cls(weights, frozenset(s for w in words if len(s := w.translate(VOWELS)) >= 3))

    def weight(self, word: str) -> float:
        return max((self.weights.get(k, 0.0) for k in entries_of(word)), default=0.0)


def bare(token: str) -> str:
    return token.lower().strip(MARKS)


def entries_of(word: str) -> list[str]:
    """What of a bare word the learned lexicon may hold: the word, and its starts."""
    if len(word) < 3 or not word.isalpha():
        return []
    return [f"w{word}", *(f"s{word[:n]}" for n in STARTS if len(word) > n)]


class Words:
    """Features of distinct tokens, a row each, kept for the next text."""

    #: insult, learned, weight, uncovered, second, shouted, marks, run, obfuscated, single, letters, capitals
    WIDTH = 12

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((4096, self.WIDTH))

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > CACHED:
            self.ids = {}
        out = np.empty(len(tokens), np.int64)
        ids = self.ids
        for i, token in enumerate(tokens):
            at = ids.get(token)
            out[i] = self.add(token) if at is None else at
        return self.rows[out]

    def add(self, token: str) -> int:
        at = self.ids[token] = len(self.ids)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        word, weight = bare(token), 0.0
        inner = token.strip(MARKS)
        letters = sum(map(str.isalpha, token))
        obfuscated = letters > 0 and bool(inner) and not inner.isalpha() and len(inner) >= 3 and any(not c.isalpha() for c in inner[1:-1])
        uncovered = 0.0
        if word:
            weight = self.lexicon.weight(word)
            if obfuscated and not weight and word not in INSULTS:
                plain = "".join(c for c in token.lower().strip(".,;:?\"'()").translate(LOOKALIKES) if c.isalpha())
                found = plain in INSULTS or self.lexicon.weight(plain) > 0 or (len(plain) >= 3 and "*" in token and plain.translate(VOWELS) in self.lexicon.skeletons)
                uncovered = float(found)
            elif not weight and word.isalpha() and len(word) > 4:
                short = "".join(c for i, c in enumerate(word) if i < 2 or c != word[i - 1] or c != word[i - 2])
                uncovered = float(short != word and (short in INSULTS or self.lexicon.weight(short) > 0))
        marks = sum(c in MARKS for c in token)
        upper = sum(map(str.isupper, token))
        self.rows[at] = (
            word in INSULTS, weight > 0, weight, uncovered, word in SECOND, letters >= 3 and upper == letters,
            marks, marks >= 3 and not letters or token[-2:] in ("!!", "??", "?!", "!?"), obfuscated, letters == 1 and len(inner) == 1, letters, upper,
        )
        return at


def describe(text: str | None, words: Words) -> np.ndarray:
    """The features of a whole text."""
    tokens = text.split() if isinstance(text, str) else []
    n = len(tokens)
    out = np.zeros(2 * len(NAMES) + 1)
    if not n:
        return out
    rows = words.of(tokens)
    total = rows.sum(axis=0)
    hit = np.flatnonzero((rows[:, 0] > 0) | (rows[:, 1] > 0) | (rows[:, 3] > 0))
    second = np.flatnonzero(rows[:, 4])
    near = 0
    if len(hit) and len(second):
        right = np.searchsorted(second, hit)
        gap = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - hit), np.abs(second[np.maximum(right - 1, 0)] - hit))
        near = int((gap <= NEAR).sum())
    single = np.flatnonzero(rows[:, 9])
    spelled = 0
    if len(single) >= 3:  # letters spelled one by one
        for run in np.split(single, np.flatnonzero(np.diff(single) != 1) + 1):
            if len(run) >= 3:
                word = "".join(bare(tokens[i]) for i in run)
                spelled += word in INSULTS or words.lexicon.weight(word) > 0
    counts = np.array([total[0], total[1], total[2], total[3], near, total[4], 0, total[5], total[6], total[7], total[8], spelled])
    rates = 100 * counts / n
    rates[6] = 100 * total[11] / max(1, total[10])
    out[:-1] = np.concatenate([counts, rates])
    out[-1] = np.log1p(n)
    return out


# The model.


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Histogram boosting on the logistic loss: the first raw score, and trees as nested (feature, cut, low, high) or a leaf."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Values that are nearly always 0 have all quantiles there: give their positive part cuts of its own.
    cuts = [np.unique(np.concatenate([c, np.quantile(x[x[:, j] > 0, j], [0, 0.25, 0.5, 0.75]) - 1e-9])) if (x[:, j] > 0).any() else c for j, c in enumerate(cuts)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = int(binned.max()) + 1
    raw, trees = np.full(len(y), start), []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        whole_g, whole_h = g[at].sum(), h[at].sum()
        if depth and len(at) >= 2 * LEAST_LEAF:
            best = (1e-6, 0, 0)
            for j in range(x.shape[1]):
                b = binned[at, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[at], h[at], None))
                right_n = len(at) - left_n
                gain = left_g**2 / (left_h + RIDGE) + (whole_g - left_g) ** 2 / (whole_h - left_h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
                gain[(left_n < LEAST_LEAF) | (right_n < LEAST_LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            gain, j, k = best
            if gain > 1e-6:
                low = binned[at, j] <= k
                return (j, float(cuts[j][k]), grow(at[low], g, h, depth - 1), grow(at[~low], g, h, depth - 1))
        leaf = float(-whole_g / (whole_h + RIDGE) * RATE)
        raw[at] += leaf
        return leaf

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return start, trees


def raw_scores(x: np.ndarray, model: tuple[float, list]) -> np.ndarray:
    start, trees = model
    out = np.full(len(x), start)

    def add(at: np.ndarray, node) -> None:
        if isinstance(node, float):
            out[at] += node
        elif len(at):
            low = x[at, node[0]] <= node[1]
            add(at[low], node[2])
            add(at[~low], node[3])

    for tree in trees:
        add(np.arange(len(x)), tree)
    return out


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (raw score, probability) between which to interpolate."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted sum, first and last raw score
    for r, v, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w, w * v, r, r])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    # A half count of each kind keeps ends off 0 and 1; levels that this puts out of order are levelled up.
    level = np.maximum.accumulate([x for b in blocks for x in [(b[1] + 0.5) / (b[0] + 1)] * 2])
    return at, level


@dataclass
class Model:
    lexicon: Lexicon
    trees: tuple[float, list]
    at: np.ndarray
    level: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = raw_scores(x, self.trees)
        # Interpolation leaves ties within a block; the raw score settles their order by a hair.
        calibrated = np.interp(raw, self.at, self.level)
        return np.clip(calibrated + 1e-4 * (1 / (1 + np.exp(-raw)) - 0.5), 0, 1)


def lexicon_of(counts: pd.DataFrame, folds: list[int], documents: dict[tuple[int, int], int]) -> Lexicon:
    """counts: entry and its documents t<fold> and c<fold>, toxic and clean; documents: of each (fold, class)."""
    toxic = sum(documents.get((f, 1), 0) for f in folds)
    clean = sum(documents.get((f, 0), 0) for f in folds)
    t, c = counts[[f"t{f}" for f in folds]].sum(axis=1), counts[[f"c{f}" for f in folds]].sum(axis=1)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    best = pd.DataFrame({"entry": counts["entry"], "odds": odds, "t": t})[(odds >= ODDS) & (t >= SUPPORT)].sort_values(["odds", "entry"], ascending=[False, True]).head(ENTRIES)
    return Lexicon.of(dict(zip(best["entry"], best["odds"], strict=True)))


def learn(labelled: DataFrame, true: dict[int, int]) -> Model:
    """labelled: text and toxic (int), a bounded sample; true: how many labels there are of each class."""
    true = {k: n for k, n in true.items() if k in (0, 1)}
    classes = {r[0] for r in labelled.where("toxic in (0, 1)").select("toxic").distinct().collect()}
    if len(classes) < 2:
        only = float(next(iter(classes), 0))
        return Model(Lexicon.of({}), (0.0, []), np.array([0.0]), np.array([only]))
    sample = labelled.where("toxic in (0, 1)").select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold"))
    documents = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {e for token in set((text or "").split()) for e in entries_of(bare(token))}
                found.update((e, fold, toxic) for e in own)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(found.values(), pa.int64())], names=["entry", "fold", "toxic", "n"])

    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == k), F.col("n")).otherwise(0)).alias(f"{'ct'[k]}{f}") for f in range(FOLDS) for k in (0, 1)]
    counts = sample.mapInArrow(entries, "entry string, fold int, toxic int, n long").groupBy("entry").agg(*sums)
    t, c = (sum(F.col(f"{k}{f}") for f in range(FOLDS)) for k in "tc")
    all_t, all_c = (sum(n for (_, k), n in documents.items() if k == want) for want in (1, 0))
    # Of all entries only those that could enter some fold's lexicon come to the driver.
    likely = counts.where((t >= SUPPORT) & (F.log((t + 0.5) / (all_t + 1)) - F.log((c + 0.5) / (all_c + 1)) >= ODDS - 1.5)).orderBy(F.desc(t / (c + 1)), "entry").limit(4 * ENTRIES).toPandas()
    every = [*range(FOLDS)]
    lexicons = [lexicon_of(likely, [f for f in every if f != own], documents) for own in every]

    def describe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Words(lexicon) for lexicon in lexicons]
        for batch in batches:
            texts, toxic, folds = (c.to_pylist() for c in batch.columns)
            rows = [describe(t, tables[f]).tobytes() for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(toxic, pa.int32()), pa.array(folds, pa.int32())], names=["x", "y", "fold"])

    got = sample.mapInArrow(describe_rows, "x binary, y int, fold int").toPandas().sort_values(["fold", "y", "x"], kind="stable")
    x, y, fold = np.array([np.frombuffer(b) for b in got["x"]]), got["y"].to_numpy(float), got["fold"].to_numpy()
    # Out-of-fold scores for the calibration; weights undo the sample's balance.
    raw = np.empty(len(y))
    for own in every:
        if (fold == own).any():
            raw[fold == own] = raw_scores(x[fold == own], boost(x[fold != own], y[fold != own]))
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, true[1] / drawn[1], true[0] / drawn[0])
    return Model(lexicon_of(likely, every, documents), boost(x, y), *isotonic(raw, y, weight / weight.mean()))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with score and predicted in place of columns so named."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        words = Words(own.lexicon)
        for texts in parts:
            yield pd.Series(own.scores(np.array([describe(t, words) for t in texts]).reshape(len(texts), -1)) if len(texts) else [], dtype=float)

    return df.drop("score", "predicted").withColumn("score", rate(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    return learn(*labelled_sample(docs, labels, "toxic", LEARN_FROM))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learned(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
