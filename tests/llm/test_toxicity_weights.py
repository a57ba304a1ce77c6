"""The classifier's features, log-count ratios, weights and scores recomputed in plain Python."""

import math
import random

import numpy as np

from alphaloom.llm import toxicity as tx

MASK = (1 << 64) - 1


def bucket(gram):
    h = 0
    for k, ch in enumerate(gram):
        h = (h * int(tx._STEP) + ord(ch) + 1) & MASK if k else ord(ch) + 1
    return ((h ^ (h >> 29)) * int(tx._LAST) & MASK) >> (64 - tx.BITS)


def grams(text):
    t = " " + text.lower() + " "
    for b in tx.BLANKS:
        t = t.replace(b, " ")
    return {bucket(t[i : i + n]) for n in tx.ORDERS for i in range(len(t) - n + 1)}


def sample():
    r = random.Random(9)
    words = ["".join(r.choice("aeiourst") for _ in range(5)) for _ in range(60)]
    out = []
    for i in range(120):
        w = [r.choice(words) for _ in range(12)]
        if i % 3 == 0:
            w[r.randrange(12)] = "Grumbl\té"
        out.append(" ".join(w))
    return out, np.array([int(i % 3 == 0) for i in range(120)])


def test_features():
    texts, _ = sample()
    texts += ["", "a", "\n\n", "İstanbul ß"]
    doc, buckets = tx._table(texts)
    for i, t in enumerate(texts):
        assert set(buckets[doc == i].tolist()) == grams(t)


def test_ratios_and_weights():
    texts, y = sample()
    doc, buckets = tx._table(texts)
    use, ridge, alpha = np.ones(len(y), bool), 1e-3, 1.0
    weights = tx._weights(doc, buckets, y, use, keep=400, alpha=alpha, ridge=ridge, steps=4000)
    sets = [grams(t) for t in texts]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    chosen = np.flatnonzero(weights)
    assert 5 < len(chosen) <= 400
    ratio = {}
    for b in chosen.tolist():
        p = (sum(b in s for s, t in zip(sets, y) if t) + alpha) / (n1 + 2 * alpha)
        q = (sum(b in s for s, t in zip(sets, y) if not t) + alpha) / (n0 + 2 * alpha)
        ratio[b] = math.log(p / q)
        gain = (p - q) ** 2 / (p * (1 - p) / n1 + q * (1 - q) / n0)
        assert gain > 6 and sum(b in s for s in sets) >= 3
    # the weights are the least of the balanced, ridged loss over ratio-scaled features: its gradient is nearly nothing there
    w = {b: weights[b] / ratio[b] for b in ratio}
    x = np.array([[ratio[b] if b in s else 0.0 for b in ratio] for s in sets])
    v = np.array(list(w.values()))
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)

    def slope(bias):
        return balance @ (1 / (1 + np.exp(-(x @ v + bias))) - y)

    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
    g = x.T @ (balance * (1 / (1 + np.exp(-(x @ v + low))) - y)) + ridge * v
    start = x.T @ (balance * (0.5 - y))
    assert np.abs(g).max() < 0.02 * np.abs(start).max()


def test_score_is_the_sum_over_distinct_features():
    texts, y = sample()
    doc, buckets = tx._table(texts)
    weights = tx._weights(doc, buckets, y, np.ones(len(y), bool), 400, 1.0, 1e-3, 200)
    model = tx.Model(weights, -0.3, 0.5)
    more = [*texts[:20], "", "grumbl é grumbl é grumbl é", "x" * 50_000]
    want = [1 / (1 + math.exp(-max(-40, min(40, sum(weights[b] for b in grams(t)) - 0.3)))) for t in more]
    assert np.allclose(model.score(more), want)
