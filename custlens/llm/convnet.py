"""A small convolutional network over bytes, trained and run in numpy.

An example is one or more chunks of ``chunk`` bytes. Every byte has a learned vector; filters as wide as two blocks of
``stride`` bytes look at each pair of neighbouring blocks; each filter's largest answer in a chunk is kept, and the
largest and the mean over the chunks of an example go through one hidden layer to a single probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class Adam:
    """Steps against gradients, by a rate that falls to nothing in ``steps`` steps."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, steps: int):
        self.rate, self.steps, self.step = rate, steps, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def move(self, weights: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        now, first, second = self.rate * (1 - self.step / (self.steps + 1)), self.first, self.second
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            grown = first[k] / (1 - 0.9**self.step)
            weights[k] = weights[k] - now * grown / (np.sqrt(second[k] / (1 - 0.999**self.step)) + 1e-7)


@dataclass
class ConvNet:
    chunk: int = 256
    stride: int = 4
    width: int = 6
    filters: int = 16
    hidden: int = 12
    seed: int = 5
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    # Slope and offset of the calibration.
    calibration: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self):
        if self.weights:
            return
        rng, block = np.random.default_rng(self.seed), self.stride * self.width
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "bytes": draw(256, self.width, scale=0.5),
            "left": draw(block, self.filters, scale=block**-0.5),
            "right": draw(block, self.filters, scale=block**-0.5),
            "shift": np.zeros(self.filters, np.float32),
            "dense": draw(2 * self.filters, self.hidden, scale=(2 * self.filters) ** -0.5),
            "dense_shift": np.zeros(self.hidden, np.float32),
            "out": draw(self.hidden, scale=self.hidden**-0.5),
            "out_shift": np.zeros(1, np.float32),
        }

    # -- forward ---------------------------------------------------------------------------------------------

    def _answers(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, and the block it begins at."""
        w = self.weights
        n, blocks = len(chunks), self.chunk // self.stride
        vectors = w["bytes"][chunks].reshape(n * blocks, self.stride * self.width)
        left = (vectors @ w["left"]).reshape(n, blocks, self.filters)
        right = (vectors @ w["right"]).reshape(n, blocks, self.filters)
        answers = left[:, :-1]
        answers += right[:, 1:]
        place = answers.argmax(axis=1)
        best = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0] + w["shift"]
        return np.maximum(best, 0), place

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each chunk, without the places."""
        w = self.weights
        n, blocks = len(chunks), self.chunk // self.stride
        vectors = w["bytes"][chunks].reshape(n * blocks, self.stride * self.width)
        both = vectors @ np.concatenate([w["left"], w["right"]], axis=1)
        both = both.reshape(n, blocks, 2 * self.filters)
        answers = both[:, :-1, : self.filters] + both[:, 1:, self.filters :]
        return np.maximum(answers.max(axis=1) + w["shift"], 0)

    def _combine(self, best: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logit of each example, whose chunks begin at ``firsts``; every example has a chunk at least."""
        w = self.weights
        sizes = np.diff(np.append(firsts, len(best)))[:, None]
        features = np.concatenate(
            [np.maximum.reduceat(best, firsts), np.add.reduceat(best, firsts) / sizes], axis=1
        ).astype(np.float32)
        hidden = np.tanh(features @ w["dense"] + w["dense_shift"])
        return hidden @ w["out"] + w["out_shift"], hidden, features

    def scores(self, best: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from the answers of ``pooled``."""
        if not len(firsts):
            return np.zeros(0)
        logits = self._combine(best, firsts)[0].astype(np.float64)
        slope, offset = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * logits + offset, -60, 60)))

    # -- training --------------------------------------------------------------------------------------------

    def gradients(
        self, chunks: np.ndarray, firsts: np.ndarray, labels: np.ndarray, shares: np.ndarray | None = None
    ) -> dict[str, np.ndarray]:
        """Of the cross entropy, in which examples count by their ``shares`` (alike, one in all, without them)."""
        w, f, s = self.weights, self.filters, self.stride
        best, place = self._answers(chunks)
        logits, hidden, features = self._combine(best, firsts)
        sizes = np.diff(np.append(firsts, len(best)))
        error = ((1 / (1 + np.exp(-np.clip(logits, -60, 60)))) - labels).astype(np.float32)[:, None]
        error = error / len(labels) if shares is None else error * shares[:, None].astype(np.float32)
        g = {"out": (hidden * error).sum(axis=0), "out_shift": error.sum(axis=0)}
        back = error * w["out"] * (1 - hidden**2)
        g["dense"], g["dense_shift"] = features.T @ back, back.sum(axis=0)
        down = back @ w["dense"].T
        owner = np.repeat(np.arange(len(firsts)), sizes)
        d_best = (down[:, f:] / sizes[:, None])[owner]
        tops = best == features[owner, :f]
        share = np.add.reduceat(tops, firsts, dtype=np.float32)
        d_best += tops * (down[:, :f] / np.maximum(share, 1))[owner]
        d_best *= best > 0
        g["shift"] = d_best.sum(axis=0)
        at = place[:, :, None] * s + np.arange(2 * s)
        seen = chunks[np.arange(len(chunks))[:, None, None], at]
        vectors = w["bytes"][seen].reshape(len(chunks), f, 2 * s * self.width)
        both = np.einsum("nf,nfk->kf", d_best, vectors)
        g["left"], g["right"] = both[: s * self.width], both[s * self.width :]
        kernel = np.concatenate([w["left"], w["right"]]).T.reshape(f, 2 * s, self.width)
        pushed = d_best[:, :, None, None] * kernel
        flat = seen.reshape(-1)
        g["bytes"] = np.stack(
            [np.bincount(flat, pushed[..., i].reshape(-1), minlength=256) for i in range(self.width)], axis=1
        )
        return {k: v.astype(np.float32) for k, v in g.items()}

    def fit(self, examples: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01):
        """Adam on the cross entropy. ``examples`` holds the chunks of each example, ``(chunks, chunk)`` bytes."""
        rng, labels = np.random.default_rng(self.seed), np.asarray(labels, np.float32)
        adam = Adam(self.weights, rate, max(1, epochs * -(-len(examples) // batch)))
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                sizes = [len(examples[i]) for i in chosen]
                g = self.gradients(
                    np.concatenate([examples[i] for i in chosen]),
                    np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64),
                    labels[chosen],
                )
                adam.move(self.weights, g)
        return self

    def calibrate(self, examples: list[np.ndarray], labels: np.ndarray, rounds: int = 200) -> None:
        """Platt scaling on examples that were not fitted."""
        labels = np.asarray(labels, float)
        if not len(labels) or labels.min() == labels.max():
            return
        best = np.concatenate([self.pooled(e) for e in examples])
        firsts = np.concatenate([[0], np.cumsum([len(e) for e in examples])[:-1]]).astype(np.int64)
        logits = self._combine(best, firsts)[0].astype(float)
        positive, negative = labels.sum(), len(labels) - labels.sum()
        aims = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        slope, offset = 1.0, 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(slope * logits + offset, -60, 60)))
            gap, spread = p - aims, p * (1 - p) + 1e-6
            grad = np.array([gap @ logits, gap.sum()]) + np.array([1e-3 * (slope - 1), 0])
            curve = np.array([[spread @ logits**2 + 1e-3, spread @ logits], [spread @ logits, spread.sum()]])
            move = np.linalg.solve(curve + 1e-6 * np.eye(2), grad)
            slope, offset = slope - move[0], offset - move[1]
            if np.abs(move).max() < 1e-6:
                break
        if slope > 0 and np.isfinite([slope, offset]).all():
            self.calibration = (float(slope), float(offset))


def cut(data: np.ndarray, places: np.ndarray, chunk: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every byte of every text, and each text's first chunk; an empty text has one."""
    sizes = np.diff(places)
    counts = np.maximum(1, -(-np.maximum(sizes - (chunk - hop), 0) // hop))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    begins = (np.arange(firsts[-1]) - firsts[owner]) * hop
    at = begins[:, None] + np.arange(chunk)
    inside = at < sizes[owner][:, None]
    padded = np.append(data, np.uint8(0))
    chunks = padded[np.where(inside, at + places[:-1][owner][:, None], len(data))]
    return chunks, firsts[:-1]
