"""A generative label model: rules vote 0, 1 or abstain (2); expectation-maximisation estimates how often each is right."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LabelModel:
    """P(good) and, for each rule, P(vote | class) for votes bad, good, abstain."""

    prior: float
    emission: np.ndarray  # rules x classes (bad, good) x votes (bad, good, abstain)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        rules = np.arange(votes.shape[1])
        like = np.log(self.emission[rules, :, votes]).sum(1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -700, 700)))


@dataclass(frozen=True)
class Belief:
    """What is taken to hold before data speak: the share of good rows, how often a vote is right by class (of all rules, or of each), and how many rows of each
    class that is worth. learn_prior: whether the share is estimated too; rows of a few patterns can't tell it from the accuracies."""

    prior: float
    right_on_good: float | tuple[float, ...]
    right_on_bad: float | tuple[float, ...]
    rows: float = 50.0
    learn_prior: bool = True


def fit(votes: np.ndarray, counts: np.ndarray, belief: Belief, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation on vote patterns (votes: 0, 1, or 2 for abstain) and how many rows have each.

    Beta priors of belief.rows rows, the same for every number of data, keep the classes' meaning. Abstaining has the same
    probability in both classes. Without rows the starting model is returned.
    """
    n_rules, total = votes.shape[1], float(counts.sum())
    start = np.stack([np.broadcast_to(x, n_rules) for x in (belief.right_on_bad, belief.right_on_good)], axis=1).astype(float)
    prior, accuracy = belief.prior, start.copy()  # P(the vote is right | class, voted)
    abstain = np.array([(counts[votes[:, r] == 2].sum() + 1) / (total + 2) for r in range(n_rules)])

    def model() -> LabelModel:
        e = np.empty((n_rules, 2, 3))
        e[:, 0, 0], e[:, 0, 1] = accuracy[:, 0], 1 - accuracy[:, 0]
        e[:, 1, 1], e[:, 1, 0] = accuracy[:, 1], 1 - accuracy[:, 1]
        e[:, :, :2] *= (1 - abstain)[:, None, None]
        e[:, :, 2] = abstain[:, None]
        return LabelModel(prior, e)

    for _ in range(rounds if len(votes) else 0):
        good = model().posterior(votes)
        weight = ((1 - good) * counts, good * counts)
        before = accuracy.copy()
        if belief.learn_prior:
            prior = float((weight[1].sum() + 2 * belief.prior) / (total + 2))
        for r, c in itertools.product(range(n_rules), range(2)):
            right, wrong = weight[c][votes[:, r] == c].sum(), weight[c][votes[:, r] == 1 - c].sum()
            accuracy[r, c] = (right + start[r, c] * belief.rows) / (right + wrong + belief.rows)
        if np.abs(accuracy - before).max() < 1e-7:
            break
    return model()
