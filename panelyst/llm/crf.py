"""A linear-chain conditional random field in numpy: training and Viterbi decoding on padded batches.

A sequence is an array of features, ``FEATURES`` integers for each token; the score of a label is the sum of its
weights for them. All sequences of a batch advance together, one position at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions whose emissions are held at a time while decoding.
STEPS = 64


@dataclass(frozen=True)
class Model:
    emissions: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (labels, labels), from and to
    begin: np.ndarray  # (labels)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one array, longest first in ``order``."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), lengths.max(), sequences[0].shape[1]), np.int32)
    for row, s in enumerate(sequences):
        out[row, : len(s)] = s
    return out, lengths


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    sequences: list[np.ndarray], labels: list[np.ndarray], features: int, count: int, forbidden: np.ndarray,
    *, rounds: int = 150, penalty: float = 0.02, rate: float = 0.2,
) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam on the whole table. Deterministic.

    ``forbidden`` marks transitions that no sequence may take.
    """
    x, lengths = padded(sequences)
    n, most = x.shape[:2]
    y = np.zeros((n, most), np.int64)
    for row, s in enumerate(labels):
        y[row, : len(s)] = s
    inside = np.arange(most)[None, :] < lengths[:, None]
    block = np.where(forbidden, -1e4, 0.0)
    weights = [np.zeros((features, count)), np.zeros((count, count)), np.zeros(count)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        e, t, b = weights[0][x].sum(axis=2), weights[1] + block, weights[2]
        forward, backward = np.zeros((n, most, count)), np.zeros((n, most, count))
        forward[:, 0] = b + e[:, 0]
        for i in range(1, most):
            now = _sum_exp(forward[:, i - 1, :, None] + t, 1) + e[:, i]
            forward[:, i] = np.where(inside[:, i, None], now, forward[:, i - 1])
        total = _sum_exp(forward[:, -1], 1)
        for i in range(most - 2, -1, -1):
            now = _sum_exp(t + (e[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(inside[:, i + 1, None], now, 0)
        share = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        share[np.arange(n)[:, None], np.arange(most)[None, :], y] -= inside
        slopes = [np.zeros_like(w) for w in weights]
        for k in range(x.shape[2]):
            np.add.at(slopes[0], x[..., k].ravel(), share.reshape(-1, count))
        slopes[2] = share[:, 0].sum(axis=0)
        for i in range(1, most):
            pair = forward[:, i - 1, :, None] + t + (e[:, i] + backward[:, i])[:, None, :] - total[:, None, None]
            pair = np.exp(pair) * inside[:, i, None, None]
            pair[np.arange(n), y[:, i - 1], y[:, i]] -= inside[:, i]
            slopes[1] += pair.sum(axis=0)
        for k in range(3):
            g = slopes[k] + penalty * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(weights[0], weights[1] + block, weights[2])


def decode(model: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each sequence; ties go to the lower label."""
    if not sequences:
        return []
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    x, lengths = padded([sequences[i] for i in order])
    n, most = x.shape[:2]
    back = np.zeros((n, most, len(model.begin)), np.int8)
    for i in range(most):
        live = int(np.searchsorted(-lengths, -i, side="left"))  # sequences longer than i come first
        if i % STEPS == 0:
            e = model.emissions[x[:live, i : i + STEPS]].sum(axis=2)
        if i == 0:
            score = model.begin + e[:, 0]
            continue
        step = score[:live, :, None] + model.transitions
        back[:live, i] = step.argmax(axis=1)
        score[:live] = step.max(axis=1) + e[:live, i % STEPS]
    label = score.argmax(axis=1)
    out = np.zeros((n, most), np.int8)
    for i in range(most - 1, -1, -1):
        out[:, i] = label
        within = lengths > i
        label = np.where(within, back[np.arange(n), i, label], label)
    result: list[np.ndarray] = [None] * n
    for row, i in enumerate(order):
        result[i] = out[row, : lengths[row]]
    return result
