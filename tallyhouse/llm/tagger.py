"""A character tagger in numpy: bidirectional LSTM with conditional-random-field transitions.

Trained on windows with one label per character by Adam on the exact likelihood. Texts longer than a window are scored in
windows that overlap by half; scores of a character are averaged with weights that fall towards a window's edges, and
one Viterbi path is decoded over all of them.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 64, 32
#: Characters: ASCII as itself, letters and others beyond it as two classes, 0 for padding.
SYMBOLS = 131
EDGE = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes + 1, np.where(codes < 0x2000, 129, 130))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, width: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.p = {"embed": rng.normal(0, 0.3, (SYMBOLS, width)).astype(f)}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, width**-0.5, (width, 4 * hidden)).astype(f)
            self.p["h" + side] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(f)
            self.p["c" + side] = np.zeros(4 * hidden, f)
            self.p["c" + side][hidden : 2 * hidden] = 1
        self.p["out"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags)).astype(f)
        self.p["bias"] = np.zeros(tags, f)
        self.p["step"] = np.zeros((tags, tags), f)

    def lstm(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states; x is batch, time, width. With ``keep``, what the way back needs is added to it."""
        n = self.hidden
        z_all = x @ self.p["x" + side] + self.p["c" + side]
        h = c = np.zeros((len(x), n), np.float32)
        out = np.empty((len(x), x.shape[1], n), np.float32)
        for t in range(x.shape[1]):
            z = z_all[:, t] + h @ self.p["h" + side]
            gates, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, c = c, f * c + i * g
            if keep is not None:
                keep.append((i, f, o, g, before, c, h))
            h = o * np.tanh(c)
            out[:, t] = h
        return out

    def lstm_back(self, x: np.ndarray, side: str, kept: list, up: np.ndarray, grad: dict) -> np.ndarray:
        n, wide = self.hidden, self.p["h" + side]
        dz_all = np.empty((len(x), x.shape[1], 4 * n), np.float32)
        dh = dc = np.zeros((len(x), n), np.float32)
        for t in reversed(range(x.shape[1])):
            i, f, o, g, before, c, h = kept[t]
            dh = dh + up[:, t]
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1
            )
            grad["h" + side] += h.T @ dz
            dz_all[:, t] = dz
            dh, dc = dz @ wide.T, dc * f
        grad["x" + side] += np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grad["c" + side] += dz_all.sum((0, 1))
        return dz_all @ self.p["x" + side].T

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Score of each tag at each place of each window.

        The network of ``lstm``, laid out for speed: a symbol's inputs of the gates are looked up, and one exponential
        serves all gates, with tanh x = 2 sigmoid 2x - 1. Each gate is an array of its own, without gaps between rows.
        """
        n, p = self.hidden, self.p
        count, long = windows.shape
        places = np.ascontiguousarray(windows.T)
        states = np.empty((2, long, count, n), np.float32)
        z, part = np.empty((4, count, n), np.float32), np.empty((4, count, n), np.float32)
        c, d = np.empty((count, n), np.float32), np.empty((count, n), np.float32)
        i, f, o, g = z
        scale = np.where(np.arange(4 * n) < 3 * n, np.float32(-1), np.float32(-2))
        for side, out in zip("fb", states, strict=True):
            table, wide = (p["embed"] @ p["x" + side] + p["c" + side]) * scale, p["h" + side] * scale
            # states are within -1 and 1, so mostly no sum can pass what float32 can hold
            bounded = (np.abs(table).max(0) + np.abs(wide).sum(0)).max() < 80
            tables = [np.ascontiguousarray(table[:, k * n : (k + 1) * n]) for k in range(4)]
            wide = np.ascontiguousarray(wide.reshape(n, 4, n).transpose(1, 0, 2))
            h = np.zeros((count, n), np.float32)
            c[:] = 0
            for t in range(long) if side == "f" else reversed(range(long)):
                for k in range(4):
                    np.take(tables[k], places[t], axis=0, out=z[k], mode="clip")
                z += np.matmul(h, wide, out=part)
                if not bounded:
                    np.minimum(z, np.float32(80), out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                g *= 2
                g -= 1
                c *= f
                c += np.multiply(i, g, out=d)
                h = np.multiply(o, np.tanh(c, out=d), out=out[t])
        return (states[0] @ p["out"][:n] + states[1] @ p["out"][n:] + p["bias"]).transpose(1, 0, 2)

    def learn(self, windows: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of a batch, and its gradient."""
        p, grad = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        x, kf, kb = p["embed"][windows], [], []
        h = np.concatenate([self.lstm(x, "f", kf), self.lstm(x[:, ::-1], "b", kb)[:, ::-1]], axis=2)
        s = h @ p["out"] + p["bias"]
        rows, long = np.arange(len(s)), s.shape[1]
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, long):
            ahead[:, t] = s[:, t] + logsumexp(ahead[:, t - 1, :, None] + p["step"], 1)
        for t in reversed(range(long - 1)):
            behind[:, t] = logsumexp(p["step"] + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = logsumexp(ahead[:, -1], 1)
        d = np.exp(ahead + behind - total[:, None, None])
        likely = -total
        for t in range(long):
            likely = likely + s[rows, t, gold[:, t]]
            d[rows, t, gold[:, t]] -= 1
            if t:
                pair = ahead[:, t - 1, :, None] + p["step"] + (s[:, t] + behind[:, t])[:, None, :]
                grad["step"] += np.exp(pair - total[:, None, None]).sum(0)
                likely = likely + p["step"][gold[:, t - 1], gold[:, t]]
                np.subtract.at(grad["step"], (gold[:, t - 1], gold[:, t]), 1)
        grad["out"] += np.tensordot(h, d, ((0, 1), (0, 1)))
        grad["bias"] += d.sum((0, 1))
        up = d @ p["out"].T
        n = self.hidden
        dx = self.lstm_back(x, "f", kf, up[:, :, :n], grad)
        dx = dx + self.lstm_back(x[:, ::-1], "b", kb, up[:, ::-1, n:], grad)[:, ::-1]
        one_hot = (windows.reshape(-1, 1) == np.arange(SYMBOLS)).astype(np.float32)
        grad["embed"] += one_hot.T @ dx.reshape(-1, dx.shape[2])
        return float(-likely.mean()), {k: v / len(s) for k, v in grad.items()}

    def train(self, windows: np.ndarray, gold: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02) -> None:
        rng = np.random.default_rng(1)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                _, grad = self.learn(windows[at], gold[at])
                step += 1
                scale = min(1.0, 5.0 / (1e-6 + float(np.sqrt(sum((g * g).sum() for g in grad.values())))))
                for k, g in grad.items():
                    g = g * scale
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    up = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-6)
                    self.p[k] -= (rate * (1 - 0.9 * step / steps) * up).astype(np.float32)

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best tags of one sequence of scores."""
        return self.paths([s])[0]

    def paths(self, sequences: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """The best tags of each sequence of scores; sequences of about one length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            size = np.array([len(sequences[i]) for i in some])
            s = np.zeros((size.max(), len(some), len(self.p["step"])), np.float32)
            for j, i in enumerate(some):
                s[: size[j], j] = sequences[i]
            back = np.zeros(s.shape, np.int8)
            best, ended = s[0], s[0].copy()
            for t in range(1, len(s)):
                through = best[:, :, None] + self.p["step"]
                back[t] = through.argmax(1)
                best = through.max(1) + s[t]
                ended[size > t] = best[size > t]
            rows, tag = np.arange(len(some)), ended.argmax(1)
            tags = np.zeros(s.shape[:2], np.int64)
            for t in range(len(s) - 1, -1, -1):
                tags[t] = np.where(t < size, tag, 0)
                tag = np.where(t < size, back[t, rows, tag], tag)
            for j, i in enumerate(some):
                out[i] = tags[: size[j], j]
        return out

    def marginals(self, s: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place of one sequence of scores."""
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[0] = s[0]
        for t in range(1, len(s)):
            ahead[t] = s[t] + logsumexp(ahead[t - 1][:, None] + self.p["step"], 0)
        for t in range(len(s) - 2, -1, -1):
            behind[t] = logsumexp(self.p["step"] + s[t + 1] + behind[t + 1], 1)
        return np.exp(ahead + behind - logsumexp(ahead[-1], 0))
