"""A bidirectional LSTM that gives each element of a sequence the probability of a label, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """One layer in each direction, and a logistic output on both states."""

    def __init__(self, inputs: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {"v": np.zeros(2 * hidden, "f4"), "c": np.zeros(1, "f4")}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, inputs**-0.5, (inputs, 4 * hidden)).astype("f4")
            self.p[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype("f4")
            self.p[f"b{d}"] = np.zeros(4 * hidden, "f4")
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p["v"][:] = rng.normal(0, hidden**-0.5, 2 * hidden)

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; ``z``: inputs times weights, time first."""
        h = c = np.zeros((z.shape[1], self.hidden), "f4")
        n, out = self.hidden, np.empty((*z.shape[:2], self.hidden), "f4")
        order = range(len(z)) if d == "f" else range(len(z) - 1, -1, -1)
        for t in order:
            a = z[t] + h @ self.p[f"u{d}"]
            gates = sigmoid(a[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(a[:, 3 * n :])
            new = f * c + i * g
            s = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, s, m))
            c = np.where(m, new, c)
            h = np.where(m, o * s, h)
            out[t] = h
        return out

    def _logits(self, x: np.ndarray, mask: np.ndarray, keeps: dict | None = None) -> tuple:
        states = []
        for d in "fb":
            z = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
            states.append(self._run(z, mask, d, None if keeps is None else keeps[d]))
        both = np.concatenate(states, axis=2)
        return both @ self.p["v"] + self.p["c"], both

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities; ``x``: time, sequence, inputs; ``mask``: time, sequence."""
        return sigmoid(self._logits(x, mask)[0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy of the elements under the mask, and its gradient."""
        keeps: dict[str, list] = {"f": [], "b": []}
        logits, both = self._logits(x, mask, keeps)
        q, n = sigmoid(logits), self.hidden
        total = max(mask.sum(), 1)
        loss = -(np.log(np.where(y > 0, q, 1 - q) + 1e-9) * mask).sum() / total
        dl = ((q - y) * mask / total).astype("f4")
        grads = {"v": np.einsum("tb,tbh->h", dl, both), "c": dl.sum(keepdims=True)[0]}
        flat = x.reshape(-1, x.shape[2])
        for k, d in enumerate("fb"):
            dout = dl[:, :, None] * self.p["v"][k * n : (k + 1) * n]
            da = np.zeros((*x.shape[:2], 4 * n), "f4")
            du = np.zeros_like(self.p[f"u{d}"])
            dh = dc = np.zeros((x.shape[1], n), "f4")
            for t, h, c, i, f, o, g, s, m in reversed(keeps[d]):
                dh = dh + dout[t]
                live = dh * m
                dnew = live * o * (1 - s * s) + dc * m
                a = da[t]
                a[:, :n] = dnew * g * i * (1 - i)
                a[:, n : 2 * n] = dnew * c * f * (1 - f)
                a[:, 2 * n : 3 * n] = live * s * o * (1 - o)
                a[:, 3 * n :] = dnew * i * (1 - g * g)
                du += h.T @ a
                dh = np.where(m, a @ self.p[f"u{d}"].T, dh)
                dc = np.where(m, dnew * f, dc)
            grads[f"w{d}"] = flat.T @ da.reshape(-1, 4 * n)
            grads[f"u{d}"], grads[f"b{d}"] = du, da.sum(axis=(0, 1))
        return float(loss), grads

    def fit(self, batches, rate: float = 0.01) -> float:
        """Adam over ``batches`` of (x, mask, y); returns the mean loss of the last tenth."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step, (x, mask, y) in enumerate(batches, 1):
            loss, grads = self.gradients(x, mask, y)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                self.p[k] = (self.p[k] - rate * m / (np.sqrt(v) + 1e-8)).astype("f4")
        return float(np.mean(losses[-max(1, len(losses) // 10) :])) if losses else 0.0
