"""A linear-chain conditional random field with two tags, over many short sequences at once."""

from __future__ import annotations

import numpy as np


class Chain:
    """Transition log-potentials ``t[i, j]`` (tag i, then tag j) and the first tag's log-odds ``start``.

    A position's evidence is one number, the log-odds ``u`` of tag 1. With two tags the forward and backward messages
    are one ratio each, so a pass over a batch is a loop over positions with vectors over the sequences.
    """

    def __init__(self, t: np.ndarray | None = None, start: float = 0.0):
        self.t = np.zeros((2, 2)) if t is None else np.asarray(t, float)
        self.start = start

    def messages(self, u: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence, forward and backward ratios of tag 1 to tag 0 at each position."""
        a = np.exp(self.t)
        e = np.exp(np.clip(u, -30, 30))
        order = np.argsort(-lengths, kind="stable")
        s, n = starts[order], lengths[order]
        longest = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # sequences longer than t
        forward, backward = np.empty_like(e), np.ones_like(e)
        r = None
        for t in range(longest):
            at = s[: active[t]] + t
            r = e[at] * np.exp(self.start) if t == 0 else e[at] * (a[0, 1] + a[1, 1] * r[: active[t]]) / (a[0, 0] + a[1, 0] * r[: active[t]])
            forward[at] = r
        b = np.ones(0)
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            if len(b) < k:
                b = np.concatenate([b, np.ones(k - len(b))])
            at = s[:k] + t
            x = e[at + 1] * b
            b = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            backward[at] = b
        return e, forward, backward

    def marginals(self, u: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of tag 1 at each position, given the whole sequence."""
        _, f, b = self.messages(u, starts, lengths)
        x = f * b
        return x / (1 + x)

    def gradients(self, u, starts, lengths, y, weight) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the weighted negative log-likelihood by evidence, transitions and start."""
        e, f, b = self.messages(u, starts, lengths)
        p = f * b / (1 + f * b)
        by_u = weight * (p - y)
        last = np.zeros(len(u), bool)
        last[starts + lengths - 1] = True
        i = np.flatnonzero(~last)
        a, x = np.exp(self.t), e[i + 1] * b[i + 1]
        joint = np.stack([np.full(len(i), a[0, 0]), a[0, 1] * x, f[i] * a[1, 0], f[i] * a[1, 1] * x])
        joint /= joint.sum(0)
        seen = np.stack([(1 - y[i]) * (1 - y[i + 1]), (1 - y[i]) * y[i + 1], y[i] * (1 - y[i + 1]), y[i] * y[i + 1]])
        by_t = ((joint - seen) * weight[i]).sum(1).reshape(2, 2)
        return by_u, by_t, float(by_u[starts].sum())


class Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0.0) + 0.01 * grad * grad
        return value - self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-9)


def fit(chain: Chain, weights: np.ndarray, evidence, back, starts, lengths, y, weight, steps: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> np.ndarray:
    """Fits ``chain`` and ``weights`` in place of a start; ``evidence(w)`` gives u, ``back(g)`` its gradient by w."""
    adam, total = Adam(rate), max(float(weight.sum()), 1.0)
    for n in range(1, steps + 1):
        adam.n = n
        by_u, by_t, by_s = chain.gradients(evidence(weights), starts, lengths, y, weight)
        weights = adam.step("w", weights, back(by_u) / total * 100 + ridge * weights)
        chain.t = adam.step("t", chain.t, by_t / total * 100 + ridge * chain.t)
        chain.start = float(adam.step("s", np.array(chain.start), np.array(by_s / total * 100 + ridge * chain.start)))
    return weights


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the first column of x is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
