"""A linear-chain conditional random field over sparse features, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_NEVER = -1e9


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    """Emission weights (features x labels) and transition weights (labels x labels).

    A sequence is a list of positions, a position the list of its features as
    (id, value), at least one each."""

    def __init__(self, n_features: int, n_labels: int):
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))

    def fit(self, sequences: Sequence[Sequence[Sequence[tuple[int, float]]]], allowed: Sequence[np.ndarray], steps: int = 120, rate: float = 0.15, l2: float = 1e-4) -> ChainCRF:
        """Maximises the regularised likelihood of the allowed labels by Adam on
        full batches. ``allowed`` has, per sequence, a matrix (length x labels) of
        prior odds: zero rules a label out, one entry above it is a label, several
        leave it open among them."""
        # Positions of the same features are scored once.
        known: dict[tuple, int] = {}
        which = np.array([known.setdefault(tuple(p), len(known)) for s in sequences for p in s], dtype=np.int64)
        if not len(which):
            return self
        ids = np.array([f for p in known for f, _ in p], dtype=np.int64)
        values = np.array([v for p in known for _, v in p])[:, None]
        sizes = np.array([len(p) for p in known], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        odds = np.concatenate([np.asarray(x, dtype=float) for x in allowed])
        closed = np.where(odds > 0, np.log(np.maximum(odds, 1e-300)), _NEVER)
        first = np.cumsum([len(s) for s in sequences]) - [len(s) for s in sequences]
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            groups.setdefault(len(s), []).append(int(first[i]))
        batches = [np.array(starts)[:, None] + np.arange(n) for n, starts in groups.items() if n]
        n_features, n_labels = self.emit.shape
        m, v = [np.zeros_like(self.emit), np.zeros_like(self.move)], [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            score = np.add.reduceat(self.emit[ids] * values, begin, axis=0)[which]
            diff, moves = np.zeros_like(score), np.zeros_like(self.move)
            for at in batches:
                near, near_moves = self._expected(score[at] + closed[at])
                free, free_moves = self._expected(score[at])
                diff[at] = near - free
                moves += near_moves - free_moves
            summed = np.stack([np.bincount(which, weights=diff[:, k], minlength=len(known)) for k in range(n_labels)], 1)
            spread = np.repeat(summed, sizes, axis=0) * values
            emit = np.stack([np.bincount(ids, weights=spread[:, k], minlength=n_features) for k in range(n_labels)], 1)
            grads = [emit / len(which) - l2 * self.emit, moves / len(which) - l2 * self.move]
            for k, param in enumerate((self.emit, self.move)):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                param += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _expected(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected label counts by position and expected moves; score is sequences x length x labels."""
        n, length, k = score.shape
        forward, backward = [score[:, 0]], [np.zeros((n, k))]
        for i in range(1, length):
            forward.append(score[:, i] + _logsum(forward[-1][:, :, None] + self.move[None], 1))
        for i in range(length - 1, 0, -1):
            backward.append(_logsum(self.move[None] + (score[:, i] + backward[-1])[:, None, :], 2))
        backward = backward[::-1]
        norm = _logsum(forward[-1], 1)
        labels = np.stack([np.exp(forward[i] + backward[i] - norm[:, None]) for i in range(length)], 1)
        moves = np.zeros_like(self.move)
        for i in range(1, length):
            joint = forward[i - 1][:, :, None] + self.move[None] + (score[:, i] + backward[i])[:, None, :]
            moves += np.exp(joint - norm[:, None, None]).sum(0)
        return labels, moves

    def tag(self, sequence: Sequence[Sequence[tuple[int, float]]]) -> np.ndarray:
        """The most probable labels of one sequence (Viterbi)."""
        score = np.array([np.array([v for _, v in p]) @ self.emit[[f for f, _ in p]] for p in sequence])
        best, back = score[0], []
        for row in score[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [int(best.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return np.array(path[::-1])
