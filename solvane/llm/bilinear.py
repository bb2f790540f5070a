"""A log-bilinear model of word classes in numpy: trained by noise-contrastive estimation, normalised by matrix products.

The vector of a context is a sum of linear maps of the two classes before; a class's score is the product of that vector and its own
plus a bias. Training tells real next classes from noise drawn by their frequency, the noise of a batch being shared, so
that all scores are matrix products. ``normaliser`` adds up all classes' scores for every pair of classes before.
"""

from __future__ import annotations

import numpy as np

WIDTH = 32
BATCH = 1024
NOISE = 64  # noise classes of a batch
RATE = 0.05
NAMES = ("context", "target", "first", "second", "bias")


class Bilinear:
    """Classes are 0 to k - 1; class k stands for the beginning of a text and is only ever a context."""

    def __init__(self, frequency: np.ndarray, seed: int = 7):
        k = len(frequency)
        draw = np.random.default_rng(seed)
        self.noise = frequency / frequency.sum()
        self.context = draw.normal(0, 0.3, (k + 1, WIDTH)).astype(np.float32)
        self.target = np.zeros((k, WIDTH), np.float32)
        self.first, self.second = np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32)
        self.bias = np.log(self.noise).astype(np.float32)  # without contexts, the classes' frequencies

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).reshape(-1) for name in NAMES])

    def load(self, flat: np.ndarray) -> Bilinear:
        at = 0
        for name in NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def normaliser(self, before: np.ndarray) -> np.ndarray:
        """For each class in ``before`` as the last one, a row with the logarithm of all classes' sum by the one before it."""
        second = self.context @ self.second
        out = np.empty((len(before), len(self.context)), np.float32)
        for i, c in enumerate(before.tolist()):
            scores = (self.context[c] @ self.first + second) @ self.target.T + self.bias
            top = scores.max(axis=1)
            out[i] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1, dtype=np.float64))
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """A class's score by the last class (bias included) and by the one before it."""
        return self.context @ self.first @ self.target.T + self.bias, self.context @ self.second @ self.target.T


class Trainer:
    """Steps over the tokens of one task, scaled by the root of each number's squared gradients."""

    def __init__(self, model: Bilinear, seed: int):
        self.model, self.draw = model, np.random.default_rng(seed)
        self.squares = {name: np.full(getattr(model, name).shape, 1e-6, np.float32) for name in NAMES}
        self.steps = np.cumsum(model.noise)
        self.offset = np.log(NOISE * model.noise).astype(np.float32)
        self.seen = 0

    def train(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        for low in range(0, len(target), BATCH):
            self.step(target[low : low + BATCH], last[low : low + BATCH], before[low : low + BATCH])
        self.seen += len(target)

    def step(self, target: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.steps, self.draw.random(NOISE), side="right"), len(self.steps) - 1)
        one, two = m.context[last], m.context[before]
        hidden = one @ m.first + two @ m.second
        own, other = m.target[target], m.target[noise]
        # how far each real and each noise class is from being told right
        real = sigmoid(np.einsum("nd,nd->n", hidden, own) + m.bias[target] - self.offset[target]) - 1
        false = sigmoid(hidden @ other.T + m.bias[noise] - self.offset[noise])
        to_hidden = real[:, None] * own + false @ other
        share = np.float32(1 / len(target))
        told, gradients = by_class(np.concatenate([target, noise]), np.concatenate([real[:, None] * hidden, false.T @ hidden]), np.concatenate([real, false.sum(axis=0)]))
        self.move("target", told, gradients[:, :-1] * share)
        self.move("bias", told, gradients[:, -1] * share)
        told, gradients = by_class(np.concatenate([last, before]), np.concatenate([to_hidden @ m.first.T, to_hidden @ m.second.T]))
        self.move("first", slice(None), one.T @ to_hidden * share)
        self.move("second", slice(None), two.T @ to_hidden * share)
        self.move("context", told, gradients * share)

    def move(self, name: str, which, gradient: np.ndarray) -> None:
        squares = self.squares[name][which] + gradient * gradient
        self.squares[name][which] = squares
        getattr(self.model, name)[which] -= RATE * gradient / np.sqrt(squares)


def by_class(which: np.ndarray, gradients: np.ndarray, further: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes in ``which``, and the sum of the rows of each; ``further`` is one more column."""
    order = np.argsort(which.astype(np.uint16), kind="stable")
    which = which[order]
    heads = np.flatnonzero(np.diff(which, prepend=-1))
    rows = gradients if further is None else np.column_stack([gradients, further])
    return which[heads], np.add.reduceat(rows[order], heads, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def contexts(classes: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token of texts laid end to end the class before it and the one before that; ``start`` beyond the beginning."""
    last, before = np.empty_like(classes), np.empty_like(classes)
    last[1:], before[2:] = classes[:-1], classes[:-2]
    heads = np.cumsum(lengths) - lengths
    heads = heads[lengths > 0]
    last[heads] = start
    before[heads] = start
    heads = heads[lengths[lengths > 0] > 1] + 1
    before[heads] = start
    return last, before
