"""A linear-chain conditional random field in numpy: 0/1 features, full transitions, Viterbi."""

from __future__ import annotations

import numpy as np


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class LinearChain:
    """emit[f, y]: weight of feature f for label y; move[x, y]: of label y after x."""

    def __init__(self, n_features: int, n_labels: int) -> None:
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, edge_label: int, rounds: int = 150, rate: float = 0.15, decay: float = 2e-5) -> LinearChain:
        """Gradient steps (Adam) on the conditional likelihood; edge_label stands before and after each sequence.

        features: sequences x positions x features, 0 beyond a sequence's length.
        """
        n, length, _ = features.shape
        k, o = self.move.shape[0], edge_label
        mask = (np.arange(length)[None] < lengths[:, None])[..., None]
        x = features.reshape(n * length, -1).astype(float)
        one_hot = np.eye(k)[labels] * mask
        last = np.arange(n), lengths - 1
        outside = np.eye(k)[o]
        gold_emit = x.T @ one_hot.reshape(-1, k)
        gold_move = np.einsum("nti,ntj->ij", one_hot[:, :-1] * mask[:, 1:], one_hot[:, 1:])
        gold_move += np.outer(outside, one_hot[:, 0].sum(0)) + np.outer(one_hot[last].sum(0), outside)
        state = [np.zeros_like(w) for w in (self.emit, self.emit, self.move, self.move)]
        for step in range(1, rounds + 1):
            e = (x @ self.emit).reshape(n, length, k)
            fwd = np.zeros((n, length, k))
            fwd[:, 0] = e[:, 0] + self.move[o]
            for t in range(1, length):
                fwd[:, t] = _logsum(fwd[:, t - 1, :, None] + self.move[None], 1) + e[:, t]
            total = _logsum(fwd[last] + self.move[:, o], 1)
            bwd = np.broadcast_to(self.move[:, o], (n, length, k)).copy()
            for t in range(length - 2, -1, -1):
                nxt = _logsum(self.move[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None], 2)
                bwd[:, t] = np.where((t + 1 < lengths)[:, None], nxt, bwd[:, t])
            node = np.exp(np.minimum(fwd + bwd - total[:, None, None], 0)) * mask
            inner = fwd[:, :-1, :, None] + self.move + (e + bwd)[:, 1:, None] - total[:, None, None, None]
            have_move = (np.exp(np.minimum(inner, 0)) * mask[:, 1:, :, None]).sum((0, 1))
            have_move += np.outer(outside, node[:, 0].sum(0)) + np.outer(node[last].sum(0), outside)
            have_emit = x.T @ node.reshape(-1, k)
            for w, gold, got, m, v in ((self.emit, gold_emit, have_emit, *state[:2]), (self.move, gold_move, have_move, *state[2:])):
                g = (gold - got) / n - decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def viterbi(self, emissions: np.ndarray, before: int, after: int) -> list[int]:
        """The best labels, given the label before and after the sequence."""
        score = emissions[0] + self.move[before]
        back = []
        for e in emissions[1:]:
            through = score[:, None] + self.move
            back.append(through.argmax(0))
            score = through.max(0) + e
        path = [int((score + self.move[:, after]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def best(self, emissions: np.ndarray, edge: int, width: int = 64) -> np.ndarray:
        """viterbi() of a long sequence, in numpy: rows of width positions at once.

        The best scores through each row by its labels before and at the end are chained row by row; then all rows
        have the best scores up to and after each of their positions, and of each position the label is taken that
        the best path through it has. (Paths of equal score may be mixed.)
        """
        n, k = emissions.shape
        rows = -(-n // width)
        e = np.full((rows * width, k), -1e9)
        e[:, edge] = 0
        e[:n] = emissions
        e = np.ascontiguousarray(e.reshape(rows, width, k).transpose(1, 2, 0))  # position, label, row
        move, labels = self.move.tolist(), range(k)

        def most(parts: list[np.ndarray]) -> np.ndarray:
            out = parts[0]
            for p in parts[1:]:
                out = np.maximum(out, p)
            return out

        through = self.move[:, :, None] + e[0]
        for c in range(1, width):
            through = np.stack([np.stack([most([through[x, z] + move[z][y] for z in labels]) + e[c, y] for y in labels]) for x in labels])
        by_row = through.transpose(2, 0, 1).tolist()
        before, after = [], []
        v = [0.0 if y == edge else -1e9 for y in labels]
        for t in by_row:
            before.append(v)
            v = [max(v[x] + t[x][y] for x in labels) for y in labels]
            top = max(v)
            v = [x - top for x in v]
        v = [0.0] * k
        for t in reversed(by_row):
            after.append(v)
            v = [max(t[x][y] + v[y] for y in labels) for x in labels]
            top = max(v)
            v = [x - top for x in v]
        total = np.empty((width, k, rows))
        f = np.array(before).reshape(rows, k).T
        for c in range(width):
            f = np.stack([most([f[x] + move[x][y] for x in labels]) + e[c, y] for y in labels])
            total[c] = f
        b = np.array(after[::-1]).reshape(rows, k).T
        for c in range(width - 1, -1, -1):
            total[c] += b
            b = np.stack([most([e[c, y] + b[y] + move[x][y] for y in labels]) for x in labels])
        return total.argmax(1).T.ravel()[:n]
