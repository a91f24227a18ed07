"""A linear-chain conditional random field with two labels, over many sequences at once.

Sequences are rows of one feature matrix, one after the other. The recursions run along the positions of all sequences
together, so their cost in Python is the length of the longest one.
"""

from __future__ import annotations

import numpy as np


class Chain:
    """Weights of the two labels (bad 0, good 1) and of the four transitions."""

    def __init__(self, features: int):
        self.emit = np.zeros(features)  # good minus bad
        self.move = np.zeros((2, 2))
        self.open = 0.0

    @staticmethod
    def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences from long to short, and the first row of each."""
        order = np.argsort(-lengths, kind="stable")
        first = np.cumsum(lengths) - lengths
        return order, first[order]

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each row; the expected transitions of each sequence summed; log Z of each sequence."""
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.emit
        order, first = self.layout(lengths)
        longest = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # sequences longer than t
        forward, backward = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t in range(longest):
            rows = first[:alive[t]] + t
            if t == 0:
                forward[rows] = score[rows] + np.array([0.0, self.open])
            else:
                before = forward[rows - 1]
                for y in (0, 1):
                    forward[rows, y] = score[rows, y] + np.logaddexp(before[:, 0] + self.move[0, y],
                                                                     before[:, 1] + self.move[1, y])
        moves = np.zeros((2, 2))
        last = first + lengths[order] - 1
        z = np.zeros(len(lengths))
        z[order] = np.logaddexp(forward[last, 0], forward[last, 1])
        z_of = z[order]
        for t in range(longest - 2, -1, -1):
            rows = first[:alive[t + 1]] + t
            after = score[rows + 1] + backward[rows + 1]
            for y in (0, 1):
                backward[rows, y] = np.logaddexp(self.move[y, 0] + after[:, 0], self.move[y, 1] + after[:, 1])
                for w in (0, 1):
                    moves[y, w] += np.exp(forward[rows, y] + self.move[y, w] + after[:, w] - z_of[:len(rows)]).sum()
        odds = (forward[:, 1] + backward[:, 1]) - (forward[:, 0] + backward[:, 0])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), moves, z

    def fit(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, l2: float = 1.0, rounds: int = 120,
            rate: float = 0.15) -> Chain:
        """Penalised maximum likelihood by Adam steps over all sequences; `labels` has one label per row."""
        first = np.cumsum(lengths) - lengths
        inner = np.ones(len(x), bool)
        inner[first] = False
        seen_moves = np.zeros((2, 2))
        at = np.flatnonzero(inner)
        np.add.at(seen_moves, (labels[at - 1], labels[at]), 1)
        seen_emit, seen_open = x.T @ labels, labels[first].sum()
        weights = np.zeros(len(self.emit) + 5)
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, rounds + 1):
            self.emit, self.move, self.open = weights[:-5], weights[-5:-1].reshape(2, 2), weights[-1]
            p, moves, _ = self.marginals(x, lengths)
            grad = np.r_[seen_emit - x.T @ p, (seen_moves - moves).ravel(), seen_open - p[first].sum()]
            grad = (grad - l2 * weights) / len(lengths)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            weights = weights + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.emit, self.move, self.open = weights[:-5], weights[-5:-1].reshape(2, 2), float(weights[-1])
        return self
