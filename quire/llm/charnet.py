"""A small character convolutional network in numpy.

One example is a candidate with the characters around it. Characters are put into
classes and embedded; a convolution of width 5 runs over the whole example, its
outputs are pooled by maximum over the candidate's own characters, and a logistic
output follows, calibrated on held-out examples (Platt scaling). Scoring pools with
``reduceat`` over examples laid end to end, so a candidate of any length is read
whole. Training is seeded and its examples are sorted, so a model depends on its
examples alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, EMBED, FILTERS = 5, 6, 24
PAD = WIDTH // 2


def _classes() -> np.ndarray:
    """Code of each byte: classes of letters and digits, single punctuation marks."""
    code = np.full(256, 1, np.int64)
    for chars, c in ((b"0123456789", 2), (b"abcdef", 3), (b"ghijklmnopqrstuvwxyz", 4), (b"ABCDEF", 5),
                     (b"GHIJKLMNOPQRSTUVWXYZ", 6), (b" \t\n\r", 7), (b"\"'`", 8), (b":", 9), (b"=", 10),
                     (b"-_", 11), (b"+/", 12), (b".,;", 13), (b"@", 14), (b"aeiou", 15), (b"()[]{}<>", 16)):
        code[list(chars)] = c
    code[0x80:] = 17
    return code


CODES = _classes()
N_CODES = 18


def layout(examples: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all examples end to end (padded), and each candidate's bounds."""
    parts, starts, ends, at = [], [], [], 0
    for left, body, right in examples:
        a, b, c = (CODES[np.frombuffer(x.encode(), np.uint8)] for x in (left, body, right))
        row = np.concatenate([np.zeros(PAD, np.int64), a, b + N_CODES, c, np.zeros(PAD, np.int64)])
        starts.append(at + PAD + len(a))
        ends.append(at + PAD + len(a) + max(len(b), 1))
        parts.append(row)
        at += len(row)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return codes, np.array(starts, np.int64), np.array(ends, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CharNet:
    embed: np.ndarray      # (2 * N_CODES, EMBED); the second half for the candidate's own
    kernel: np.ndarray     # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray        # (FILTERS,)
    out_bias: float
    scale: float = 1.0     # calibration
    shift: float = 0.0
    threshold: float = 1.0
    precision: float = 1.0  # at the threshold, on held-out examples

    def _hidden(self, codes):
        e = self.embed[codes]
        z = sum(e[j:len(e) - 2 * PAD + j] @ self.kernel[j * EMBED:(j + 1) * EMBED] for j in range(WIDTH))
        return e, np.maximum(z + self.bias, 0)   # row i stands for position i + PAD

    def logits(self, examples) -> np.ndarray:
        if not examples:
            return np.zeros(0)
        codes, starts, ends = layout(examples)
        _, h = self._hidden(codes)
        at = np.stack([starts, ends], 1).ravel() - PAD
        pooled = np.maximum.reduceat(np.vstack([h, np.zeros((1, FILTERS))]), at, axis=0)[::2]
        return pooled @ self.out + self.out_bias

    def probabilities(self, examples) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(examples) + self.shift)


def train(examples, labels, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> CharNet:
    """Adam over mini-batches of examples."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (2 * N_CODES, EMBED)), "kernel": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)),
         "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.2, FILTERS), "out_bias": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    labels, step = np.asarray(labels, float), 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), 64):
            batch = order[lo:lo + 64]
            grad = _gradients(p, [examples[i] for i in batch], labels[batch])
            step += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return CharNet(p["embed"], p["kernel"], p["bias"], p["out"], float(p["out_bias"][0]))


def _gradients(p, examples, labels):
    net = CharNet(p["embed"], p["kernel"], p["bias"], p["out"], float(p["out_bias"][0]))
    codes, starts, ends = layout(examples)
    e, h = net._hidden(codes)
    spans = [h[a - PAD:b - PAD] for a, b in zip(starts, ends)]
    top = np.stack([x.argmax(0) for x in spans]) + (starts - PAD)[:, None]   # rows of h
    pooled = h[top, np.arange(FILTERS)]
    error = (_sigmoid(pooled @ p["out"] + p["out_bias"][0]) - labels) / len(labels)
    d_pooled = error[:, None] * p["out"] * (pooled > 0)
    dz = np.zeros_like(h)
    np.add.at(dz, (top, np.arange(FILTERS)[None, :]), d_pooled)
    de, kernel = np.zeros_like(e), np.zeros_like(p["kernel"])
    n = len(h)
    for j in range(WIDTH):
        cut = slice(j * EMBED, (j + 1) * EMBED)
        kernel[cut] = e[j:j + n].T @ dz
        de[j:j + n] += dz @ p["kernel"][cut].T
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, codes, de)
    return {"embed": embed, "kernel": kernel, "bias": dz.sum(0), "out": pooled.T @ error, "out_bias": error.sum(keepdims=True)}


def calibrate(net: CharNet, examples, labels, recall: float) -> CharNet:
    """Platt scaling on held-out examples, then the highest threshold that keeps the
    asked recall, with the precision there."""
    x, y = net.logits(examples), np.asarray(labels, float)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):   # Newton steps with a little damping
        q = _sigmoid(a * x + b)
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - target) * x).sum(), (q - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    q = net.probabilities(examples)
    found = np.sort(q[y > 0])
    at = found[int(np.floor((1 - recall) * len(found)))]
    chosen = q >= at
    net.threshold, net.precision = float(at), float(y[chosen].mean())
    return net
