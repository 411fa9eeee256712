"""Background as an adaptive mixture of Gaussians per pixel, and as the samples of a nearest-neighbour model.

Both follow the published recursions: a mixture keeps a few weighted Gaussians per pixel, moves the one
that explains a value towards it at a rate of one over the frames seen (at most the history) and replaces
the weakest one where none does; the heaviest ones that together reach a share are background. The
sample model calls a pixel background if enough of its remembered values lie within a distance.
"""

from __future__ import annotations

import numpy as np

from frameloom.streaming.background import to_grey


class MixtureModel:
    """Grey Gaussian mixture: `parts` components, history in frames, squared distance of a match in variances.

    rate: a learning rate for every frame; by default one over the frames seen, at most the history.
    """

    def __init__(self, history: int = 500, parts: int = 4, match: float = 16.0, background_share: float = 0.9, variance: float = 15.0, floor: float = 4.0, rate: float | None = None):
        self.history, self.parts, self.match, self.rate = history, parts, match, rate
        self.share, self.start_variance, self.floor = background_share, variance, floor
        self.seen = 0
        self.weight = self.mean = self.variance = None

    def apply(self, frame: np.ndarray, rate: float | None = None) -> np.ndarray:
        """Foreground as 255. rate: learning rate of this frame instead of the model's."""
        grey = to_grey(frame).astype(np.float64)
        if self.weight is None:
            shape = (self.parts, *grey.shape)
            self.weight, self.mean, self.variance = np.zeros(shape), np.zeros(shape), np.full(shape, self.start_variance)
            self.weight[0], self.mean[0] = 1.0, grey
        self.seen += 1
        rate = self.rate if rate is None else rate
        a = rate if rate is not None else 1 / min(2 * self.seen, self.history)
        apart = (grey - self.mean) ** 2
        fits = (apart < self.match * self.variance) & (self.weight > 0)
        is_background = self.ranked_before(self.weight) < self.share
        foreground = ~(fits & is_background).any(axis=0)
        chosen = np.where(fits, self.weight, -1).argmax(axis=0)
        any_fit = fits.any(axis=0)
        own = (np.arange(self.parts)[:, None, None] == chosen) & any_fit
        self.weight += a * (own - self.weight)
        step = np.where(own, a / np.maximum(self.weight, max(a, 1e-9)), 0.0)
        self.mean += step * (grey - self.mean)
        self.variance = np.maximum(self.variance + step * (apart - self.variance), self.floor)
        y, x = np.nonzero(~any_fit)
        if len(y):
            weakest = self.weight[:, y, x].argmin(axis=0)
            self.weight[weakest, y, x], self.mean[weakest, y, x], self.variance[weakest, y, x] = a, grey[y, x], self.start_variance
        self.weight /= self.weight.sum(axis=0)
        return np.where(foreground, 255, 0).astype(np.uint8)

    def ranked_before(self, weight: np.ndarray) -> np.ndarray:
        """The weight of the heavier parts of each pixel, the first of equal ones before the others; only pixels out of order are sorted."""
        before = np.cumsum(weight, axis=0) - weight
        y, x = np.nonzero((weight[1:] > weight[:-1]).any(axis=0))
        if len(y):
            order = np.argsort(-weight[:, y, x], axis=0, kind="stable")
            ranked = np.take_along_axis(weight[:, y, x], order, 0)
            sums = np.empty_like(ranked)
            np.put_along_axis(sums, order, np.cumsum(ranked, axis=0) - ranked, 0)
            before[:, y, x] = sums
        return before


class NeighbourModel:
    """Grey nearest-neighbour model: a ring of past values, refreshed so that it spans the history."""

    def __init__(self, history: int = 500, samples: int = 7, distance: float = 20.0, least: int = 2):
        self.every = max(1, history // samples)
        self.samples, self.distance, self.least = samples, distance, least
        self.ring: np.ndarray | None = None
        self.seen = 0

    def apply(self, frame: np.ndarray) -> np.ndarray:
        grey = to_grey(frame).astype(np.int16)
        if self.ring is None:
            self.ring = np.repeat(grey[None], self.samples, axis=0)
        near = (np.abs(self.ring - grey) < self.distance).sum(axis=0)
        if self.seen % self.every == 0:
            self.ring[self.seen // self.every % self.samples] = grey
        self.seen += 1
        return np.where(near >= self.least, 0, 255).astype(np.uint8)
