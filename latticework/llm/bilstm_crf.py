"""A character tagger: bidirectional LSTM and conditional random field, in numpy."""

from __future__ import annotations

import numpy as np

SYMBOLS = 100


def symbols(text: str) -> np.ndarray:
    """A number below ``SYMBOLS`` for each code point: printable ASCII, and classes for the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 32, 95).astype(np.int64)
    out[points == 10] = 96
    out[(points == 9) | (points == 13)] = 97
    out[points >= 0x80] = 98
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """``allowed[a, b]``: whether tag b may follow tag a."""

    def __init__(self, tags: int, allowed: np.ndarray, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h, self.tags = h, tags
        self.barrier = np.where(allowed, 0.0, -1e4).astype(np.float32)
        self.p = {"out": rng.normal(0, 0.2, (2 * h, tags)), "bias": np.zeros(tags), "move": np.zeros((tags, tags))}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 1.0  # forget gates start open
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, ids: np.ndarray, d: str, keep: bool = False):
        """Hidden states (batch, time, h) of one direction."""
        h, table, w = self.h, self.p["x" + d], self.p["h" + d]
        b, t = ids.shape
        state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        out, trace = np.empty((b, t, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[ids[:, k]] + state @ w
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, k] = state
            if keep:
                trace.append((k, i, f, o, g, before, squashed, last))
        return (out, trace) if keep else out

    def _back(self, ids, d, trace, grad, into):
        h, w = self.h, self.p["h" + d]
        ds, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
        dw, steps = np.zeros_like(w), []
        for k, i, f, o, g, before, squashed, last in reversed(trace):
            ds = ds + grad[:, k]
            dc = dc + ds * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
            steps.append((ids[:, k], dz))
            dw += last.T @ dz
            ds, dc = dz @ w.T, dc * f
        symbol, dz = np.concatenate([i for i, _ in steps]), np.concatenate([dz for _, dz in steps])
        order = np.argsort(symbol, kind="stable")
        start = np.flatnonzero(np.diff(symbol[order], prepend=-1))
        into["x" + d], into["h" + d] = np.zeros_like(self.p["x" + d]), dw
        into["x" + d][symbol[order][start]] = np.add.reduceat(dz[order], start)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores (batch, time, tags)."""
        return np.concatenate([self._run(ids, "f"), self._run(ids, "b")], 2) @ self.p["out"] + self.p["bias"]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradients."""
        b, t = ids.shape
        forward, trace_f = self._run(ids, "f", True)
        backward, trace_b = self._run(ids, "b", True)
        both = np.concatenate([forward, backward], 2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        barred = (self.p["move"] + self.barrier).astype(np.float64)
        # forward and backward sums as probabilities, scaled to one at each step
        top = e.max(2, keepdims=True)
        here, move = np.exp(e - top), np.exp(barred)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((b, t, 1))
        for k in range(t):
            now = here[:, k] * (alpha[:, k - 1] @ move if k else 1.0)
            scale[:, k] = now.sum(1, keepdims=True)
            alpha[:, k] = now / scale[:, k]
        for k in range(t - 2, -1, -1):
            beta[:, k] = (here[:, k + 1] * beta[:, k + 1] / scale[:, k + 1]) @ move.T
        z = (np.log(scale) + top).sum((1, 2))
        rows = np.arange(b)[:, None]
        gold = e[rows, np.arange(t), tags].sum(1) + barred[tags[:, :-1], tags[:, 1:]].sum(1)
        de = alpha * beta
        de[rows, np.arange(t), tags] -= 1
        ahead = here[:, 1:] * beta[:, 1:] / scale[:, 1:]
        n = e.shape[2]
        dmove = (alpha[:, :-1].reshape(-1, n).T @ ahead.reshape(-1, n)) * move
        np.subtract.at(dmove, (tags[:, :-1], tags[:, 1:]), 1)
        de = (de / b).astype(np.float32)
        grads = {"out": both.reshape(b * t, -1).T @ de.reshape(b * t, -1), "bias": de.sum((0, 1)), "move": (dmove / b * (self.barrier == 0)).astype(np.float32)}
        dboth = de @ self.p["out"].T
        self._back(ids, "f", trace_f, dboth[:, :, : self.h], grads)
        self._back(ids, "b", trace_b, dboth[:, :, self.h :], grads)
        return float((z - gold).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 250, batch: int = 48, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam with a falling rate; returns the losses."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses, order = [], np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(ids))])
            pick, order = order[:batch], order[batch:]
            value, grads = self.loss(ids[pick], tags[pick])
            losses.append(value)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tag sequences (Viterbi)."""
        e = self.scores(ids)
        b, t, n = e.shape
        move, best, back = self.p["move"] + self.barrier, e[:, 0], np.empty((b, t, n), np.int8)
        for k in range(1, t):
            steps = best[:, :, None] + move
            back[:, k] = steps.argmax(1)
            best = steps.max(1) + e[:, k]
        out = np.empty((b, t), np.int64)
        out[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[np.arange(b), k, out[:, k]]
        return out
