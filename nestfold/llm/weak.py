"""Weak supervision: a label model over voters, and a hashed linear scorer trained on its posteriors.

The label model is generative: a hidden label, and for each voter the chance of
a vote given the label. Expectation-maximisation estimates both from votes
alone; labelled rows only give the first guess of the label's share. Voters
that agree more than the label explains are correlated: their residual
correlations, estimated under the posterior, divide their say.

The linear scorer has one weight per hashed feature. It is fitted on the
driver on a bounded sample of rows, whose size is a parameter of the callers; so
is the label model, unless it gets the counts of all rows' votes. Scoring runs
over all rows with a model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    """Chances of a vote for label 0 and 1, the label's share, and what each voter's say is divided by."""

    rates: np.ndarray  # voters x 2
    share: float
    crowd: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.rates[:, 1] / self.rates[:, 0]) / self.crowd
        no = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0])) / self.crowd
        odds = votes @ yes + (1 - votes) @ no + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @property
    def accuracies(self) -> np.ndarray:
        return self.share * self.rates[:, 1] + (1 - self.share) * (1 - self.rates[:, 0])


def fit_label_model(votes: np.ndarray, share: float, rounds: int = 50, counts: np.ndarray | None = None) -> LabelModel:
    """``votes`` is rows x voters of 0 and 1. ``share`` is the first guess of how many rows have label 1.

    With ``counts``, each row of ``votes`` stands for so many equal rows.
    """
    v = votes.shape[1]
    times = np.ones(len(votes)) if counts is None else counts.astype(float)
    n = times.sum()
    model = LabelModel(np.tile([0.02, 0.5], (v, 1)), float(np.clip(share, 0.001, 0.999)), np.ones(v), np.eye(v))
    if not n:
        return model
    for step in range(rounds):
        p = model.posterior(votes)
        for label, weight in ((0, times * (1 - p)), (1, times * p)):
            model.rates[:, label] = np.clip((weight @ votes + 0.1) / (weight.sum() + 0.2), 1e-4, 1 - 1e-4)
        model.rates[:, 1] = np.maximum(model.rates[:, 1], model.rates[:, 0] * 1.01)  # a vote speaks for label 1
        model.rates = np.clip(model.rates, 1e-4, 1 - 1e-4)
        model.share = float(np.clip(times @ p / n, 0.001, 0.999))
        if step >= 5:
            residual = votes - (p[:, None] * model.rates[:, 1] + (1 - p[:, None]) * model.rates[:, 0])
            scale = np.sqrt(times @ residual**2 / n) + 1e-9
            model.correlations = (residual / scale * times[:, None]).T @ (residual / scale) / n
            close = np.clip(model.correlations, 0, 1)
            model.crowd = np.maximum(1, close.sum(axis=1) - close.diagonal() + 1)
    return model


def fit_linear(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, goal: np.ndarray, size: int,
    least_rows: int = 3, penalty: float = 1e-3, rounds: int = 300, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft goals, by full-batch Adam.

    Entries are (row, feature, value). Features of fewer than ``least_rows`` rows,
    and those that the goals hardly tell apart, keep weight 0.
    """
    n = len(goal)
    if not n or not len(row):
        return np.zeros(size, np.float32), 0.0
    count = np.bincount(feature, minlength=size)
    total = np.bincount(feature, value, size)
    square = np.bincount(feature, value**2, size)
    with_goal = np.bincount(feature, value * goal[row], size)
    mean = goal.mean()
    spread = np.sqrt(np.maximum(square - total**2 / n, 1e-12) * max(mean * (1 - mean), 1e-6))
    keep = (count >= least_rows) & (np.abs(with_goal - total * mean) / spread > 4)
    at = np.full(size, -1)
    at[keep] = np.arange(keep.sum())
    on = at[feature] >= 0
    row, column, value = row[on], at[feature[on]], value[on]
    k = int(keep.sum())
    w, bias = np.zeros(k), float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    m, s = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column] * value, n) + bias, -30, 30)))
        error = (p - goal) / n
        gradient = np.append(np.bincount(column, error[row] * value, k) + penalty * w / 10, error.sum())
        m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[keep] = w
    return weights, float(bias)


def logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
