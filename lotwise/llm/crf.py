"""A linear-chain conditional random field with two states, over arrays of lines.

Lines of many chains lie behind one another; ``ends`` says where each chain
ends. State 0 is content, state 1 boilerplate. Only differences of scores count,
so content has a score per line and boilerplate has none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Weights:
    """Scores: of the features for content, of the first state, and of each pair of states."""

    features: np.ndarray
    first: np.ndarray
    pairs: np.ndarray


def viterbi(scores: np.ndarray, ends: np.ndarray, weights: Weights) -> np.ndarray:
    """True for each line that the best state sequence of its chain calls content.

    All chains advance together, the longest first. Ties go to content.
    """
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    out = np.zeros(len(scores), bool)
    active = int(np.searchsorted(-lengths, 0, side="left"))
    if not active:
        return out
    t00, t01, t10, t11 = weights.pairs.ravel()
    content = weights.first[0] + scores[starts[:active]]
    other = np.full(active, weights.first[1])
    back: list[tuple[np.ndarray, np.ndarray]] = []
    finals = np.empty((2, len(starts)))
    for step in range(1, int(lengths[0])):
        still = int(np.searchsorted(-lengths, -step, side="left"))
        finals[:, still:active] = content[still:], other[still:]
        active, content, other = still, content[:still], other[:still]
        to0, to1 = content + t00 >= other + t10, content + t01 >= other + t11
        back.append((to0, to1))
        content, other = (
            np.where(to0, content + t00, other + t10) + scores[starts[:active] + step],
            np.where(to1, content + t01, other + t11),
        )
    finals[:, :active] = content, other
    state = finals[0] >= finals[1]
    for step in range(int(lengths[0]) - 1, 0, -1):
        n = len(back[step - 1][0])
        out[starts[:n] + step] = state[:n]
        to0, to1 = back[step - 1]
        state[:n] = np.where(state[:n], to0, to1)
    n = int(np.searchsorted(-lengths, 0, side="left"))
    out[starts[:n]] = state[:n]
    return out


def fit(features: np.ndarray, content: np.ndarray, chain: int = 64, rounds: int = 300, ridge: float = 1e-4) -> Weights:
    """Weights of the greatest likelihood, less ``ridge`` times their squares.

    The lines are cut into chains of ``chain`` lines; gradients come from the
    forward and backward sums, steps from Adam with fixed settings.
    """
    n, width = features.shape
    count = -(-n // chain)
    x = np.zeros((count * chain, width))
    x[:n] = features
    x = x.reshape(count, chain, width)
    there = (np.arange(count * chain) < n).reshape(count, chain)
    gold = np.zeros(count * chain, int)
    gold[:n] = 1 - content.astype(int)
    gold = gold.reshape(count, chain)
    onehot = np.stack([gold == 0, gold == 1], -1) & there[..., None]
    both = there[:, 1:] & there[:, :-1]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_first = onehot[:, 0].sum(0)
    seen = np.concatenate([(x * onehot[..., :1]).sum((0, 1)), seen_first, seen_pairs.ravel()])
    theta = np.zeros(width + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, first, pairs = theta[:width], theta[width : width + 2], theta[width + 2 :].reshape(2, 2)
        unary = np.zeros((count, chain, 2))
        unary[..., 0] = x @ w
        forward = np.empty((count, chain, 2))
        backward = np.zeros((count, chain, 2))
        forward[:, 0] = first + unary[:, 0]
        for t in range(1, chain):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + unary[:, t]
            forward[:, t] = np.where(there[:, t, None], forward[:, t], forward[:, t - 1])
        for t in range(chain - 2, -1, -1):
            to = backward[:, t + 1] + unary[:, t + 1]
            step_back = np.logaddexp(to[:, :1] + pairs[:, 0], to[:, 1:] + pairs[:, 1])
            backward[:, t] = np.where(there[:, t + 1, None], step_back, backward[:, t + 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        joint = np.exp(
            forward[:, :-1, :, None] + pairs + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[..., None, None]
        expected = np.concatenate([
            (x * marginal[..., :1]).sum((0, 1)), marginal[:, 0].sum(0), joint.sum((0, 1)).ravel()
        ])
        gradient = (seen - expected) / n - ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = np.round(theta, 6)
    return Weights(theta[:width], theta[width : width + 2], theta[width + 2 :].reshape(2, 2))
