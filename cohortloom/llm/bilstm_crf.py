"""A small character-level bidirectional LSTM with CRF transitions in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
_SPECIAL = {c: i for i, c in enumerate("@.-+() _%/\n:,")}
CLASSES = len(_SPECIAL) + 4


def classes(text: str) -> np.ndarray:
    """Class of each character: some marks by themselves, digits, small and capital letters, others."""
    base = len(_SPECIAL)
    return np.array(
        [
            _SPECIAL[c] if c in _SPECIAL
            else base if "0" <= c <= "9"
            else base + 1 if "a" <= c <= "z"
            else base + 2 if "A" <= c <= "Z"
            else base + 3
            for c in text
        ],
        np.int64,
    )


def _sig(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Batches are (windows, length) arrays of character classes with a mask of real characters."""

    def __init__(self, tags: int, seed: int = 7) -> None:
        r, h = np.random.default_rng(seed), HIDDEN
        self.tags = tags
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["h" + d] = r.normal(0, 0.3 / np.sqrt(h), (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = r.normal(0, 0.2, (2 * h, tags))
        self.p["ob"] = np.zeros(tags)
        self.p["t"] = np.zeros((tags, tags))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: bool = True):
        n, length = x.shape
        h, c, keep = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.zeros((n, length, HIDDEN))
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = self.p["x" + d][x[:, t]] + h @ self.p["h" + d] + self.p["c" + d]
            i, f, o = (_sig(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c2 = m * (f * c + i * g)
            tc = np.tanh(c2)
            h2 = m * o * tc
            if kept:
                keep.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[:, t] = h2
        return out, keep

    def emissions(self, x: np.ndarray, mask: np.ndarray, kept: bool = True):
        f, kf = self._run(x, mask, "f", kept)
        b, kb = self._run(x, mask, "b", kept)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kf, kb

    def _back(self, x, keep, dout, d, grad) -> None:
        dh, dc, each = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.eye(CLASSES)
        for t, i, f, o, g, c, tc, h, m in reversed(keep):
            dh = (dh + dout[:, t]) * m
            do = dh * tc
            dc = (dc + dh * o * (1 - tc**2)) * m
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            grad["x" + d] += each[x[:, t]].T @ dz
            grad["h" + d] += h.T @ dz
            grad["c" + d] += dz.sum(0)
            dh = dz @ self.p["h" + d].T
            dc = dc * f

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags and its gradient. Padding stands at the end only."""
        e, both, kf, kb = self.emissions(x, mask)
        n, length = x.shape
        trans, at = self.p["t"], np.arange(n)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        lse = lambda v: (v.max(1) + np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)))
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            new = e[:, t] + lse(alpha[:, t - 1][:, :, None] + trans[None])
            alpha[:, t] = np.where(mask[:, t : t + 1] > 0, new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = (beta[:, t + 1] + e[:, t + 1])[:, None, :] + trans[None]
            new = lse(nxt.transpose(0, 2, 1))
            beta[:, t] = np.where(mask[:, t + 1 : t + 2] > 0, new, 0)
        log_z = lse(alpha[:, -1])
        gold, de = np.zeros(n), np.zeros_like(e)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(length):
            m = mask[:, t]
            gold += m * e[at, t, y[:, t]]
            de[:, t] = np.exp(alpha[:, t] + beta[:, t] - log_z[:, None]) * m[:, None]
            de[at, t, y[:, t]] -= m
            if t:
                gold += m * trans[y[:, t - 1], y[:, t]]
                pair = alpha[:, t - 1][:, :, None] + trans[None] + (e[:, t] + beta[:, t])[:, None, :]
                grad["t"] += (np.exp(pair - log_z[:, None, None]) * m[:, None, None]).sum(0)
                np.subtract.at(grad["t"], (y[:, t - 1], y[:, t]), m)
        de /= n
        grad["t"] /= n
        grad["o"] = np.einsum("nth,ntk->hk", both, de)
        grad["ob"] = de.sum((0, 1))
        dboth = de @ self.p["o"].T
        self._back(x, kf, dboth[:, :, :HIDDEN], "f", grad)
        self._back(x, kb, dboth[:, :, HIDDEN:], "b", grad)
        return float((log_z - gold).mean()), grad

    def fit(self, x, y, mask, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 3) -> float:
        r, step, loss = np.random.default_rng(seed), 0, 0.0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                own = order[a : a + batch]
                loss, grad = self.step(x[own], y[own], mask[own])
                norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g**2
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tag sequence per window; tag 0 on padding."""
        e = self.emissions(x, mask, kept=False)[0]
        n, length = x.shape
        best, back = e[:, 0], np.zeros((n, length, self.tags), np.int64)
        for t in range(1, length):
            all_ = best[:, :, None] + self.p["t"][None]
            back[:, t] = all_.argmax(1)
            real = mask[:, t : t + 1] > 0
            back[:, t] = np.where(real, back[:, t], np.arange(self.tags)[None])
            best = np.where(real, e[:, t] + all_.max(1), best)
        out = np.zeros((n, length), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return np.where(mask > 0, out, 0)
