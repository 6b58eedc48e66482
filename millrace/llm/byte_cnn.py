"""A small convolutional network over bytes, in numpy: filters over chunks, max-pooled, one probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def layout(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, width: int, stride: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with zeros after each text, first window of each chunk, the one after its last, text of each chunk.

    A text has about bytes / stride windows, one at least, which cover it and see no byte of another; each chunk has
    `chunk` of them, the last fewer, and shares width - stride bytes with the next, so that the chunks
    cover the whole text.
    """
    sizes = ends - starts
    room = sizes + width
    room += -room % stride
    base = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(base[-1] + width, np.uint8)
    out[np.arange(len(data)) + np.repeat(base[:-1] - starts, sizes)] = data
    count = room // stride - (width - 1) // stride
    chunks = -(-count // chunk)
    text = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = base[:-1][text] // stride + nth * chunk
    return out, first, first + np.minimum(chunk, count[text] - nth * chunk), text


def spans(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places for reduceat, whose every second value is that of a chunk: the windows between chunks belong to none."""
    return np.stack([first, stop], 1).reshape(-1)


@dataclass
class ByteCnn:
    filters: np.ndarray  # width x 256 x F
    bias: np.ndarray  # F
    out: np.ndarray  # 2F: for the maximum and the mean over the chunks of a text
    out_bias: float
    stride: int = 2
    chunk: int = 512

    @staticmethod
    def new(width: int = 5, n_filters: int = 16, stride: int = 2, chunk: int = 512, seed: int = 1) -> ByteCnn:
        rng = np.random.default_rng(seed)
        f = rng.normal(0, 0.3, (width, 256, n_filters)).astype(np.float32)
        f[:, 0] = 0  # padding
        return ByteCnn(f, np.zeros(n_filters, np.float32), rng.normal(0, 0.1, 2 * n_filters).astype(np.float32), 0.0, stride, chunk)

    def _conv(self, padded: np.ndarray) -> np.ndarray:
        width, s = len(self.filters), self.stride
        n = (len(padded) - width) // s + 1
        total = self.filters[0][padded[0 : n * s : s]]
        for k in range(1, width):
            total += self.filters[k][padded[k : k + n * s : s][:n]]
        return total

    def pooled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of each chunk, text of each chunk."""
        padded, first, stop, text = layout(starts, ends, data, len(self.filters), self.stride, self.chunk)
        return np.maximum.reduceat(self._conv(padded), spans(first, stop), axis=0)[::2], text

    def logits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.float32)
        most, text = self.pooled(data, starts, ends)
        act = np.maximum(most + self.bias, 0)
        at = np.flatnonzero(np.diff(text, prepend=-1))
        count = np.diff(np.append(at, len(text)))[:, None]
        return np.maximum.reduceat(act, at, axis=0) @ self.out[: act.shape[1]] + (np.add.reduceat(act, at, axis=0) / count) @ self.out[act.shape[1] :] + self.out_bias

    def probability(self, *args) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*args).astype(np.float64), -60, 60)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 1, decay: float = 1e-4, steps: int = 0) -> ByteCnn:
        """Adam on the log loss; the gradient passes each maximum to the window that gave it.  Few texts get more epochs, until
        there are `steps` steps."""
        epochs = max(epochs, -(-steps // max(1, -(-len(texts) // batch))))
        rng, width, s, n_f = np.random.default_rng(seed), len(self.filters), self.stride, self.filters.shape[2]
        weights = [self.filters, self.bias, self.out, np.zeros(1, np.float32)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        t, labels = 0, np.asarray(labels, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                sizes = np.array([len(texts[i]) for i in pick])
                ends = np.cumsum(sizes)
                padded, first, stop, text = layout(ends - sizes, ends, np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), width, s, self.chunk)
                conv = self._conv(padded)
                where = np.stack([conv[a:b].argmax(axis=0) + a for a, b in zip(first, stop)])
                most = np.take_along_axis(conv, where, axis=0)
                act = np.maximum(most + self.bias, 0)
                at = np.flatnonzero(np.diff(text, prepend=-1))
                count = np.diff(np.append(at, len(text)))
                top = np.maximum.reduceat(act, at, axis=0)
                mean = np.add.reduceat(act, at, axis=0) / count[:, None]
                z = top @ weights[2][:n_f] + mean @ weights[2][n_f:] + weights[3]
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
                g_out = np.concatenate([g @ top, g @ mean])
                g_act = (g / count)[text][:, None] * weights[2][n_f:]
                g_act += np.where(act == top[text], g[text][:, None] * weights[2][:n_f], 0)
                g_act *= act > 0
                g_filters = np.zeros_like(self.filters)
                f = np.arange(n_f)[None, :]
                for k in range(width):
                    np.add.at(g_filters[k], (padded[where * s + k], f), g_act)
                g_filters[:, 0] = 0
                t += 1
                for w, (m, v), grad in zip(weights, moments, (g_filters, g_act.sum(0), g_out, g.sum(keepdims=True))):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w -= rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * w)
        self.out_bias = float(weights[3][0])
        return self
