"""The trained model against a plain dense solver of the same objective, with and without the swap penalty."""

import numpy as np
import pytest

from pagelake.llm import toxicity

L1, L2 = 1e-3, 1e-3


def problem():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    texts, labels = [], []
    for k in range(160):
        toxic = k % 3 == 0
        own = [words[j] for j in rng.integers(0, 40, 12)] + (["awful", "muslim"] if toxic and k % 2 else ["awful"] if toxic else ["jewish"] if k % 4 == 0 else ["fine"])
        texts.append(" ".join(own).encode())
        labels.append(int(toxic))
    return texts, np.array(labels)


def dense(rows, swapped):
    """The matrix of learnt features, and of what the swaps change in it."""
    names, seen = np.unique(np.concatenate(rows), return_counts=True)
    names = names[seen >= toxicity.MIN_TEXTS]
    matrix = lambda lists: np.array([np.isin(names, x) for x in lists], float)
    own = matrix(rows)
    return own, np.array([o - m if s is not None else np.zeros(len(names)) for o, m, s in zip(own, matrix([s if s is not None else r for s, r in zip(swapped, rows)]), swapped)])


def objective(z, delta, y, w):
    return float(np.mean(np.logaddexp(0, z) - y * z) + toxicity.SWAP_WEIGHT * np.mean(delta**2) + L1 * np.abs(w).sum() + L2 / 2 * (w**2).sum())


def solved(own, change, y):
    """Proximal gradient with one safe step, until it stands still."""
    n, d = own.shape
    both = np.hstack([own, np.ones((n, 1))])
    step = 1 / (np.linalg.norm(both, 2) ** 2 / (4 * n) + 2 * toxicity.SWAP_WEIGHT * np.linalg.norm(change, 2) ** 2 / n + L2)
    w, b = np.zeros(d), 0.0
    for _ in range(60_000):
        g = (1 / (1 + np.exp(-(own @ w + b))) - y) / n
        grad = own.T @ g + change.T @ (2 * toxicity.SWAP_WEIGHT / n * (change @ w)) + L2 * w
        w2 = w - step * grad
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * L1, 0)
        b2 = b - step * g.sum()
        if np.abs(w2 - w).max() < 1e-9 and abs(b2 - b) < 1e-9:
            break
        w, b = w2, b2
    return w, b


@pytest.mark.parametrize("penalty", [True, False])
def test_the_model_is_the_dense_solvers(penalty):
    texts, y = problem()
    rows = [toxicity.features_of(t) for t in texts]
    swapped = [toxicity.swapped_features(t) if penalty else None for t in texts]
    assert not penalty or sum(s is not None for s in swapped) > 40
    own, change = dense(rows, swapped)
    w, b = solved(own, change, y)
    best = objective(own @ w + b, change @ w, y, w)
    model = toxicity.fit_rows(rows, y, np.ones(len(y)), np.unique(np.concatenate([toxicity.raw_features(t) for t in texts])), swapped, L1, L2)
    logit = lambda p: np.log(p / (1 - p))
    z = np.array([logit(model.score(t)) for t in texts])
    other = np.array([logit(model.score(toxicity.swapped_text(t))) if s is not None else a for t, s, a in zip(texts, swapped, z)])
    found = objective(z, z - other, y, model.weights)
    assert best - 1e-9 <= found <= 1.01 * best
    assert np.abs(1 / (1 + np.exp(-z)) - 1 / (1 + np.exp(-(own @ w + b)))).max() < 0.05


def test_the_penalty_brings_neutral_mentions_down():
    """A neutral text that names a group which toxic texts name often: with the penalty its score is nearer to that of a text without it."""
    texts, y = problem()
    rows = [toxicity.features_of(t) for t in texts]
    bases = np.unique(np.concatenate([toxicity.raw_features(t) for t in texts]))
    fit = lambda swapped: toxicity.fit_rows(rows, y, np.ones(len(y)), bases, swapped, L1, L2)
    fair, plain = fit([toxicity.swapped_features(t) for t in texts]), fit([None] * len(texts))
    rise = lambda m: m.score(b"w1 w2 muslim w3") - m.score(b"w1 w2 w3")
    assert rise(plain) > 0 and rise(fair) < rise(plain)
