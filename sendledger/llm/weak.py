"""Weak supervision: reliabilities of labellers by expectation-maximisation, and a linear scorer.

Votes are 0 (no), 1 (yes) or 2 (abstains). The patterns of votes are counted on
Spark first; their number is bounded by the labellers, so the fitting sees a small table
that stands for all rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

ABSTAIN = 2
# What a labeller does before anything is known: (no, yes, abstain) for the classes no and yes.
_FIRST = np.array([[0.50, 0.05, 0.45], [0.15, 0.45, 0.40]])


class Reliabilities:
    """How each labeller votes in either class, and how common the class yes is in each group."""

    def __init__(self, labellers: int, groups: int):
        self.theta = np.tile(_FIRST, (labellers, 1, 1))
        self.prior = np.full(groups, 0.2)

    def posterior(self, votes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Probability of yes for each row of votes."""
        log = np.log(np.stack([1 - self.prior[group], self.prior[group]]))
        for k in range(votes.shape[1]):
            log = log + np.log(self.theta[k][:, votes[:, k]])
        high = log.max(axis=0)
        both = np.exp(log - high)
        return both[1] / both.sum(axis=0)

    def fit(self, votes: np.ndarray, group: np.ndarray, counts: np.ndarray, rounds: int = 100, doubt: float = 5.0):
        """``doubt`` is the weight, in rows, of what was believed at first."""
        for _ in range(rounds):
            yes = self.posterior(votes, group)
            weight = np.stack([counts * (1 - yes), counts * yes])
            for g in range(len(self.prior)):
                inside = group == g
                total = counts[inside].sum()
                self.prior[g] = np.clip((weight[1][inside].sum() + 0.2 * doubt) / (total + doubt), 1e-4, 1 - 1e-4)
            for k in range(votes.shape[1]):
                for y in (0, 1):
                    seen = np.bincount(votes[:, k], weights=weight[y], minlength=3) + doubt * _FIRST[y]
                    self.theta[k][y] = seen / seen.sum()
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def feature_sums(features: np.ndarray, row: np.ndarray, wanted: np.ndarray, size: int) -> np.ndarray:
    """Sums over some rows: per head how often each feature occurs, weighted by the wanted class; then how
    often it occurs at all. The last entry counts the rows."""
    out = np.zeros((len(wanted) + 1, size + 1))
    for h, w in enumerate([*wanted, np.ones(wanted.shape[1])]):
        out[h, :-1] = np.bincount(features, weights=w[row], minlength=size)
        out[h, -1] = w.sum()
    return out


def choose(
    sums: np.ndarray, least: float = 8.0, effect: float = 0.18, most: int = 4096, seldom: int = 10, shrink: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell the classes apart, and for each head which of them are its own.

    A feature must be ``least`` standard deviations from chance, and ``effect`` times the root
    of the number of rows; the ``most`` telling ones of each head are taken. Features that occur less
    than ``seldom`` times are left out; ``shrink`` adds to the variance, so that a few rows tell less.
    """
    count, total = sums[-1, :-1], max(sums[-1, -1], 1)
    telling = np.zeros((len(sums) - 1, len(count)))
    for h, own in enumerate(sums[:-1]):
        mean = np.clip(own[-1] / total, 1e-3, 1 - 1e-3)
        telling[h] = np.abs(own[:-1] - mean * count) / np.sqrt(np.maximum(count, 1) * mean * (1 - mean) + shrink)
    telling[:, count < seldom] = 0
    for t in telling:
        t[np.argsort(-t, kind="stable")[most:]] = 0
    own = telling >= max(least, effect * np.sqrt(total))
    chosen = np.flatnonzero(own.any(axis=0))
    return chosen, own[:, chosen]


class Linear:
    """A logistic scorer over a few binary features, one head for each question.

    A step is divided by the curvature times the number of features of a row, so it cannot
    overshoot, and is carried on by momentum. ``own`` says which features a head uses.
    """

    def __init__(self, own: np.ndarray, means: np.ndarray, ridge: float = 1.0):
        means = np.clip(means, 1e-3, 1 - 1e-3)
        self.own, self.ridge = own, ridge
        self.weights, self.bias = np.zeros(own.shape), np.log(means / (1 - means))
        self._last, self._steps = (self.weights, self.bias), 0

    def gradient(
        self, features: np.ndarray, row: np.ndarray, wanted: np.ndarray, weight: np.ndarray | float = 1.0
    ) -> np.ndarray:
        """Sums over some weighted rows: per head the gradient and the curvature, the bias last."""
        heads, size = self.own.shape
        out = np.zeros((heads, 2, size + 1))
        for h in range(heads):
            inside = self.own[h][features]
            own, at = features[inside], row[inside]
            p = sigmoid(np.bincount(at, weights=self.weights[h][own], minlength=wanted.shape[1]) + self.bias[h])
            error = weight * (wanted[h] - p)
            curve = weight * np.maximum(p * (1 - p), 0.02) * (1 + np.bincount(at, minlength=wanted.shape[1]))
            out[h, 0, :-1] = np.bincount(own, weights=error[at], minlength=size)
            out[h, 1, :-1] = np.bincount(own, weights=curve[at], minlength=size)
            out[h, :, -1] = error.sum(), curve.sum()
        return out

    def move(self, sums: np.ndarray) -> None:
        stepped = (
            self.weights + (sums[:, 0, :-1] - self.ridge * self.weights) / (sums[:, 1, :-1] + self.ridge) * self.own,
            self.bias + sums[:, 0, -1] / (sums[:, 1, -1] + 1),
        )
        self._steps += 1
        ahead = (self._steps - 1) / (self._steps + 2)
        self.weights, self.bias = (now + ahead * (now - last) for now, last in zip(stepped, self._last))
        self._last = stepped

    def spread(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """The weights over all features."""
        out = np.zeros((len(self.weights), size), np.float32)
        out[:, chosen] = self.weights
        return out


def flat(lists: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """All features of some rows in one array, and the row of each."""
    lists = [np.asarray(x, np.int64) for x in lists]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return (np.concatenate(lists) if lists else np.empty(0, np.int64)), rows
