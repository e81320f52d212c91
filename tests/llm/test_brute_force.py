"""What the learned operators compute, against plain loops over the same definitions."""

import itertools
import math
import random

import numpy as np
import pytest

from tidelog.llm import language_id, quality, toxicity
from tidelog.llm.ngrams import bins_of

# Quality.


def features_by_hand(text):
    raw, found = text.encode(), {}
    for i in range(len(raw) - 2):
        code = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        bin_ = (code * 0x9E3779B1) % 2**32 >> 32 - quality.BITS
        found[bin_] = found.get(bin_, 0) + 1
    words = text.split()
    again = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    if again:
        found[1 << quality.BITS] = again
    length = math.sqrt(sum(found.values()))
    return {b: math.sqrt(n) / length for b, n in found.items()}


def likelihood_by_hand(rows, grades, weights, cuts):
    """Penalised mean log likelihood of a cumulative-link model, grade by grade."""
    total = 0.0
    for values, y in zip(rows, grades, strict=True):
        strength = sum(weights[b] * v for b, v in values.items())
        above = [1.0, *(1 / (1 + math.exp(c - strength)) for c in cuts), 0.0]
        total += math.log(above[y] - above[y + 1])
    return total / len(rows) - quality.SHRINK / 2 * sum(w * w for w in weights)


def graded(n=150):
    rng = np.random.default_rng(5)
    kinds = ["zzz qqq xxx", "zzz abc def def", "abc def ghi"]
    # Grades overlap, so that the likelihood has its top at finite weights.
    grades = rng.integers(0, 3, n)
    kind = np.clip(grades + rng.choice([-1, 0, 0, 0, 1], n), 0, 2)
    return [" ".join(rng.permutation((kinds[k] + " mmm nnn").split())) for k in kind], grades


def test_features_and_probabilities_by_hand():
    texts, grades = graded()
    for text in [*texts[:20], "", "é", "ab", "a a a b b", "日本 日本 " * 30]:
        bins, values = quality.features(text)
        assert dict(zip(bins.tolist(), values.tolist(), strict=True)) == pytest.approx(features_by_hand(text))
    model = quality.fit([quality.features(t) for t in texts], grades, {0: 0.5, 1: 0.2, 2: 0.3})
    for text in texts[:20]:
        strength = sum(model.weights[b] * v for b, v in features_by_hand(text).items())
        above = [1 / (1 + math.exp(c - strength)) for c in model.thresholds]
        expected, tail = model.rated(text, 2)
        assert expected == pytest.approx(sum(above)) and tail == pytest.approx(above[1])


def test_fit_is_at_the_top_of_the_likelihood():
    texts, grades = graded()
    shares = {k: float((grades == k).mean()) for k in range(3)}
    model = quality.fit([quality.features(t) for t in texts], grades, shares)
    rows = [features_by_hand(t) for t in texts]
    own = likelihood_by_hand(rows, grades, model.weights, model.thresholds)
    base = [-math.log(sum(shares[g] for g in range(k + 1, 3)) / sum(shares[g] for g in range(k + 1))) for k in range(2)]
    assert own > likelihood_by_hand(rows, grades, np.zeros(quality.BINS), base) + 0.1
    rng = np.random.default_rng(0)
    used = sorted({b for r in rows for b in r})
    for _ in range(60):
        step = np.zeros(quality.BINS)
        step[used] = rng.normal(size=len(used))
        move = 0.3 * rng.normal(size=2)
        assert likelihood_by_hand(rows, grades, model.weights + 0.3 * step, np.sort(model.thresholds + move)) < own + 1e-4


def test_thresholds_move_to_true_shares():
    texts, grades = graded()
    even = {k: float((grades == k).mean()) for k in range(3)}
    rare = {0: 0.8, 1: 0.15, 2: 0.05}
    at, moved = (quality.fit([quality.features(t) for t in texts], grades, s).thresholds for s in (even, rare))
    odds = lambda shares, k: math.log(sum(shares[g] for g in range(k + 1, 3)) / sum(shares[g] for g in range(k + 1)))
    assert moved - at == pytest.approx([odds(even, k) - odds(rare, k) for k in range(2)])


# Languages.


def mixture_by_hand(text, model, rounds=25):
    """Every set of languages: its proportions by EM over single trigrams, and its penalised likelihood."""
    grams = bins_of(b" " + text.lower().encode().translate(language_id.BLANKED) + b" ", language_id.ORDER, language_id.BITS)
    price = 0.5 * math.log(len(grams) + 1) + language_id.PER_NGRAM * len(grams)
    found = {}
    for size in range(1, model.shape[1] + 1):
        for chosen in itertools.combinations(range(model.shape[1]), size):
            share = dict.fromkeys(chosen, 1 / size)
            for _ in range(rounds):
                owed = dict.fromkeys(chosen, 0.0)
                for g in grams:
                    whole = sum(share[k] * model[g, k] for k in chosen)
                    for k in chosen:
                        owed[k] += share[k] * model[g, k] / whole
                share = {k: v / len(grams) for k, v in owed.items()}
            fit = sum(math.log(sum(share[k] * model[g, k] for k in chosen)) for g in grams)
            found[chosen] = (fit - price * size, share)
    return found


def test_mixtures_by_hand(documents):
    languages, model = language_id.learn(documents)
    assert np.allclose(model.sum(axis=0), 1) and len(languages) == 4
    texts = {}
    for r in documents.where("lang is not null and length(text) > 400").orderBy("doc_id").select("text", "lang").collect():
        texts.setdefault(r.lang, []).append(r.text)
    rng = random.Random(2)
    one = [texts[lang][i][:160] for lang in languages for i in (0, 1)]
    two = [texts[a][2][:200] + " " + texts[b][2][:200] for a, b in rng.sample(list(itertools.combinations(languages, 2)), 4)]
    sizes = []
    for text in [*one, *two]:
        chosen, every = language_id.mixture(text, model), mixture_by_hand(text, model)
        best = max(every, key=lambda c: every[c][0])
        # Sets are tried in order of proportion, not all of them: what is found is as good as the best.
        assert every[tuple(sorted(chosen))][0] >= every[best][0] - 0.5
        for k, share in every[tuple(sorted(chosen))][1].items():
            assert chosen[k] == pytest.approx(share, abs=5e-3)
        sizes.append(len(chosen))
    assert sizes == [1] * len(one) + [2] * len(two)


# Toxicity.

#: A token's insult, learned weight, undone obfuscation, second person, shouted, marks, run of marks, obfuscated.
TOKENS = {
    "the": (0, 0, 0, 0, 0, 0, 0, 0), "house": (0, 0, 0, 0, 0, 0, 0, 0), "you": (0, 0, 0, 1, 0, 0, 0, 0), "Your,": (0, 0, 0, 1, 0, 1, 0, 0), "YOU!!": (0, 0, 0, 1, 1, 2, 1, 0),
    "idiot": (1, 0, 0, 0, 0, 0, 0, 0), "(IDIOT)": (1, 0, 0, 0, 1, 2, 0, 0), "1d1ot": (0, 0, 1, 0, 0, 0, 0, 1), "sn00zle": (0, 0, 1, 0, 0, 0, 0, 1), "snoozle": (0, 3.5, 0, 0, 0, 0, 0, 0),
    "snoozling.": (0, 3.25, 0, 0, 0, 1, 0, 0), "...": (0, 0, 0, 0, 0, 3, 1, 0), "NATO": (0, 0, 0, 0, 1, 0, 0, 0), "R2D2": (0, 0, 0, 0, 0, 0, 0, 1),
}


def describe_by_hand(tokens):
    n = len(tokens)
    known = [TOKENS[t] for t in tokens]
    hits = [i for i, k in enumerate(known) if k[0] or k[1] or k[2]]
    near = sum(any(known[j][3] for j in range(max(0, i - 5), min(n, i + 6))) for i in hits)
    sums = [sum(k[f] for k in known) for f in range(8)]
    counts = [sum(k[0] for k in known), sum(k[1] > 0 for k in known), sums[1], sums[2], near, sums[3], 0, sums[4], sums[5], sums[6], sums[7], 0]
    letters = sum(c.isalpha() for t in tokens for c in t)
    rates = [100 * c / n for c in counts]
    rates[6] = 100 * sum(c.isupper() for t in tokens for c in t) / max(1, letters)
    return [*counts, *rates, math.log(n + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_describe_by_hand(seed):
    rng = random.Random(seed)
    words = toxicity.Words(toxicity.Lexicon.of({"wsnoozle": 3.5, "ssnooz": 3.25}))
    for n in (1, 2, 7, 40, 400):
        tokens = [rng.choice(list(TOKENS)) for _ in range(n)]
        assert toxicity.describe(" ".join(tokens), words).tolist() == pytest.approx(describe_by_hand(tokens))


def tree_by_hand(x, y, raw, at, depth):
    """What the first tree adds to each row: the best of all splits, again and again."""
    g = [1 / (1 + math.exp(-raw)) - y[i] for i in range(len(y))]
    h = 1 / (1 + math.exp(-raw)) * (1 - 1 / (1 + math.exp(-raw)))
    worth = lambda rows: sum(g[i] for i in rows) ** 2 / (len(rows) * h + toxicity.RIDGE)
    best = (1e-6, None)
    if depth and len(at) >= 2 * toxicity.LEAST_LEAF:
        for j in range(x.shape[1]):
            for cut in sorted(set(x[at, j]))[:-1]:
                low, high = [i for i in at if x[i, j] <= cut], [i for i in at if x[i, j] > cut]
                if min(len(low), len(high)) >= toxicity.LEAST_LEAF:
                    best = max(best, (worth(low) + worth(high) - worth(at), (low, high)), key=lambda b: b[0])
    if best[1] is None:
        leaf = -sum(g[i] for i in at) / (len(at) * h + toxicity.RIDGE) * toxicity.RATE
        return dict.fromkeys(at, leaf)
    return tree_by_hand(x, y, raw, best[1][0], depth - 1) | tree_by_hand(x, y, raw, best[1][1], depth - 1)


@pytest.mark.parametrize("seed", range(3))
def test_first_tree_by_hand(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, size=(200, 4)).astype(float)
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 5) ^ (rng.random(200) < 0.15)).astype(float)
    start, trees = toxicity.boost(x, y)
    assert start == pytest.approx(math.log((y.sum() + 0.5) / (200 - y.sum() + 0.5)))
    added = tree_by_hand(x, y, start, list(range(200)), toxicity.DEPTH)
    assert (toxicity.raw_scores(x, (start, trees[:1])) - start).tolist() == pytest.approx([added[i] for i in range(200)])


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_by_hand(seed):
    """The least-squares rising fit is, at each point, the largest over starts of the least over ends of a mean."""
    rng = np.random.default_rng(seed)
    raw = rng.permutation(40) / 7.0
    y, weight = (rng.random(40) < raw / 6).astype(float), rng.integers(1, 4, 40).astype(float)
    order = np.argsort(raw)
    v, w = y[order], weight[order]
    mean = lambda a, b: (v[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum()
    fitted = np.array([max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])
    at, level = toxicity.isotonic(raw, y, weight)
    # Equal fits are one block, whose level has a half count of each kind added.
    want = []
    for block in np.split(np.arange(40), np.flatnonzero(np.diff(fitted) > 1e-12) + 1):
        want += [(v[block] @ w[block] + 0.5) / (w[block].sum() + 1)] * len(block)
    assert np.interp(raw[order], at, level) == pytest.approx(np.maximum.accumulate(want))
