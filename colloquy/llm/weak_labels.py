"""Expectation-maximisation over vote patterns, and the classifier trained on what it finds.

Both see counts of patterns only, a bounded number of rows whatever the corpus.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

VALUES = (-1, 0, 1)

#: The prior of either class is held below this, so that a kind seen in one class alone does not settle every candidate.
SURE = 0.95


def _no_worse_than_chance(table: np.ndarray, prior: float) -> np.ndarray:
    """table with the votes of a labeler that speaks more often against a class than for it made the same for both.

    This keeps class 1 the one that labelers vote for, so the classes cannot change places.
    """
    share = np.array([1 - prior, prior])
    yes, no = table[1, :, 2] < table[0, :, 2], table[0, :, 0] < table[1, :, 0]
    for j in range(table.shape[1]):
        which = [0, 1, 2] if yes[j] and no[j] else [2] if yes[j] else [0] if no[j] else []
        for value in which:
            table[:, j, value] = share @ table[:, j, value]
    return table / table.sum(axis=2, keepdims=True)


def reliabilities(counts: dict[tuple, int], rounds: int = 60, pseudo: float = 1.0) -> tuple[float, np.ndarray, dict[tuple, float]]:
    """(prior, table, posterior) of a two-class model in which labelers vote independently given the class.

    counts: votes -> number. table[class, labeler, value] is how often it votes that way; the
    posterior of each vote pattern is its probability of class 1. Starts from vote sums.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array(patterns, int) + 1
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    for _ in range(rounds):
        prior = min(max((pseudo + (n * post).sum()) / (2 * pseudo + n.sum()), 1 - SURE), SURE)
        table = np.full((2, votes.shape[1], len(VALUES)), pseudo)
        for j in range(votes.shape[1]):
            np.add.at(table[1, j], votes[:, j], n * post)
            np.add.at(table[0, j], votes[:, j], n * (1 - post))
        table /= table.sum(axis=2, keepdims=True)
        table = _no_worse_than_chance(table, prior)
        logit = np.full(len(patterns), np.log(prior) - np.log1p(-prior))
        for j in range(votes.shape[1]):
            logit += np.log(table[1, j, votes[:, j]]) - np.log(table[0, j, votes[:, j]])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return float(prior), table, dict(zip(patterns, post.tolist(), strict=True))


def train(rows: list[tuple[tuple, float, int]], steps: int = 300, ridge: float = 1e-2) -> dict[tuple[int, object], float]:
    """Logistic regression on one-hot features from (features, soft label, count): (position, value) -> weight; (-1, None) is the intercept."""
    index: dict[tuple[int, object], int] = defaultdict(lambda: len(index))
    index[(-1, None)]
    coded = [[index[(k, v)] for k, v in enumerate(f)] for f, _, _ in rows]
    x = np.zeros((len(rows), len(index)))
    x[:, 0] = 1
    for i, own in enumerate(coded):
        x[i, own] = 1
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps, damped by the ridge; ends when they vanish
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * w / len(rows)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + (ridge / len(rows) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {k: float(w[i]) for k, i in index.items()}
