"""Per-frame kernels: a sample-based background model, connected components, crops; and their use per video.

The background model keeps samples of each pixel. A pixel is background if enough samples lie near its
value; background pixels now and then replace a random sample of their own and, independently, one of a
random neighbour, so that the model follows slow change and eats into ghosts. Components are found by
runs of foreground pixels and union-find over touching runs, in 8-connectivity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Weights of blue, green and red in a grey value.
GREY = (0.114, 0.587, 0.299)


def image_of(pixels: bytes, height: int, width: int) -> np.ndarray:
    """(height, width) of one byte a pixel, or (height, width, channels) of more."""
    flat = np.frombuffer(pixels, np.uint8)
    return flat.reshape(height, width) if len(flat) == height * width else flat.reshape(height, width, -1)


def to_grey(frame: np.ndarray) -> np.ndarray:
    """Grey values in single precision, blue first, cut off rather than rounded; grey frames pass."""
    if frame.ndim == 2:
        return frame
    blue, green, red = (np.float32(weight) * frame[..., i] for i, weight in enumerate(GREY))
    return (blue + green + red).astype(np.uint8)


def to_grey_value(colour: tuple[int, int, int]) -> int:
    return int(to_grey(np.array([[colour]], np.uint8))[0, 0])


#: Steps to the eight neighbours of a pixel.
AROUND = np.array([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])


class SampleModel:
    """Background model of n samples a pixel: radius of a match, least matches, update chance 1 in `phi`."""

    def __init__(self, seed: int, n: int = 20, radius: int = 20, least: int = 2, phi: int = 16):
        self.rng = np.random.default_rng(seed)
        self.n, self.radius, self.least, self.phi = n, radius, least, phi
        self.samples: np.ndarray | None = None

    def start(self, grey: np.ndarray) -> None:
        """Every sample of every pixel is one of its eight neighbours in the first frame, wrapping at the borders."""
        around = np.stack([np.roll(grey, tuple(step), (0, 1)) for step in AROUND])
        which = self.rng.integers(0, len(AROUND), (self.n, *grey.shape))
        self.samples = np.take_along_axis(around, which, axis=0)

    def saved(self) -> tuple[list[bytes], str]:
        """(the planes of samples, the random generator's state) from which `restore` goes on."""
        return [plane.tobytes() for plane in self.samples], json.dumps(self.rng.bit_generator.state)

    def restore(self, planes: list[bytes], generator: str, height: int, width: int) -> None:
        self.samples = np.stack([np.frombuffer(p, np.uint8).reshape(height, width) for p in planes])
        self.rng.bit_generator.state = json.loads(generator)

    def apply(self, frame: np.ndarray) -> np.ndarray:
        """Foreground as 255; the first frame has none."""
        grey = to_grey(frame)
        if self.samples is None:
            self.start(grey)
            return np.zeros_like(grey)
        near = np.maximum(self.samples, grey) - np.minimum(self.samples, grey) < self.radius
        background = np.add.reduce(near, axis=0, dtype=np.uint8 if self.n < 256 else np.int64) >= self.least
        self.replace(grey, background, neighbours=False)
        self.replace(grey, background, neighbours=True)
        return np.where(background, 0, 255).astype(np.uint8)

    def replace(self, grey: np.ndarray, background: np.ndarray, neighbours: bool) -> None:
        y, x = np.nonzero(background & (self.rng.random(grey.shape) < 1 / self.phi))
        values = grey[y, x]
        if neighbours:  # a step out of the frame changes nothing
            dy, dx = AROUND[self.rng.integers(0, len(AROUND), len(y))].T
            y, x = y + dy, x + dx
            inside = (y >= 0) & (y < grey.shape[0]) & (x >= 0) & (x < grey.shape[1])
            y, x, values = y[inside], x[inside], values[inside]
        self.samples[self.rng.integers(0, self.n, len(y)), y, x] = values


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of the 8-connected parts of a mask, ordered by their first pixel."""
    on = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    on[:, 1:-1] = mask != 0
    edge = np.flatnonzero(on[:, 1:] != on[:, :-1])  # starts and ends of runs alternate
    if not len(edge):
        return []
    line, at = np.divmod(edge, mask.shape[1] + 1)
    row, start, end = line[::2].tolist(), at[::2].tolist(), at[1::2].tolist()
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    i = 0  # the first run that may touch run j from the line above
    for j in range(len(row)):
        while row[i] < row[j] - 1 or (row[i] == row[j] - 1 and end[i] < start[j]):
            i += 1
        k = i
        while row[k] == row[j] - 1 and start[k] <= end[j]:
            a, b = root(k), root(j)
            parent[max(a, b)] = min(a, b)
            k += 1
    parts: dict[int, list[int]] = {}
    for i in range(len(row)):
        parts.setdefault(root(i), []).append(i)
    out = []
    for runs in parts.values():
        x, y = min(start[i] for i in runs), row[runs[0]]
        out.append((x, y, max(end[i] for i in runs) - x, row[runs[-1]] - y + 1, sum(end[i] - start[i] for i in runs)))
    return out


def area_weights(old: int, new: int) -> np.ndarray:
    """(new, old): the share of each old pixel in each new one when a line of pixels shrinks."""
    edge = np.arange(new + 1) * (old / new)
    low, high = edge[:-1, None], edge[1:, None]
    at = np.arange(old)
    return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) * (new / old)


def linear_weights(old: int, new: int) -> np.ndarray:
    """(new, old): weights of linear interpolation between pixel centres, the borders repeated."""
    centre = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
    left = np.minimum(centre.astype(int), max(old - 2, 0))
    out = np.zeros((new, old))
    out[np.arange(new), left] = 1 - (centre - left)
    if old > 1:
        out[np.arange(new), left + 1] += centre - left
    return out


def resized(image: np.ndarray, size: int, method: str = "linear") -> np.ndarray:
    """A square image of size x size, rounded to whole values; "area" averages what a new pixel covers where it shrinks."""
    if image.shape[0] == size:
        return image.copy()
    weights = area_weights if method == "area" and image.shape[0] > size else linear_weights
    w = weights(image.shape[0], size)
    out = np.tensordot(w, np.moveaxis(np.tensordot(w, image.astype(np.float64), (1, 0)), 1, 0), (1, 0))
    return np.floor(np.moveaxis(out, 0, 1) + 0.5).astype(np.uint8)


def square(image: np.ndarray, cx: float, cy: float, side: float, replicate: bool = True) -> tuple[np.ndarray, float]:
    """(square crop in whole pixels, share of it outside the image).

    Outside pixels repeat the border or, without replicate, are zero. A crop wholly outside is all synthetic
    and, with replicate, has the value of the image's pixel nearest to the centre.
    """
    n = max(1, round(side))
    x, y = round(cx - side / 2) + np.arange(n), round(cy - side / 2) + np.arange(n)
    in_x, in_y = (x >= 0) & (x < image.shape[1]), (y >= 0) & (y < image.shape[0])
    share = 1 - float(in_x.sum() * in_y.sum()) / (n * n)
    if share == 1 and replicate:
        x, y = np.full(n, int(cx)), np.full(n, int(cy))
    out = image[np.clip(y, 0, image.shape[0] - 1)][:, np.clip(x, 0, image.shape[1] - 1)]
    if not replicate:
        inside = in_y[:, None] & in_x
        out = np.where(inside if image.ndim == 2 else inside[..., None], out, 0).astype(image.dtype)
    return out, share


def crop(image: np.ndarray, cx: float, cy: float, side: float, size: int, replicate: bool = True, method: str = "linear") -> tuple[np.ndarray, float]:
    """(square crop resized to size, share of it outside the image); see `square` and `resized`."""
    out, share = square(image, cx, cy, side, replicate)
    return resized(out, size, method), share


FOREGROUND = "video string, frame long, x long, y long, w long, h long, area long"


def found_in(model: SampleModel, video: str, frame: int, image: np.ndarray, low: float, high: float) -> list[tuple]:
    """Rows of FOREGROUND of the next frame's components within an area band, inclusive shares of the frame."""
    area = image.shape[0] * image.shape[1]
    return [(video, frame, *c) for c in components(model.apply(image)) if low * area <= c[4] <= high * area]


def foreground(frames: DataFrame, seed: int = 20, low: float = 0.0, high: float = 1.0, model_of: Callable[[], object] | None = None, in_order: bool = False) -> DataFrame:
    """(video, frame, x, y, w, h, area) of every component within an area band, from a fresh model per video.

    frames: (video, frame, height, width, pixels). Videos are dealt over tasks and sorted by frame, unless they
    come in_order (see `sources.painted`); a task streams through its batches and holds one model at a time.
    model_of makes a model with a method `apply` from frames to masks; by default one of samples, from the seed.
    """
    fresh = model_of or (lambda: SampleModel(seed))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, model = None, None
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                if model is None or r.video != video:
                    video, model = r.video, fresh()
                out += found_in(model, video, r.frame, image_of(r.pixels, r.height, r.width), low, high)
            yield pd.DataFrame(out, columns=["video", "frame", "x", "y", "w", "h", "area"])

    return by_video(frames.select("video", "frame", "height", "width", "pixels"), in_order).mapInPandas(run, FOREGROUND)


def by_video(rows: DataFrame, in_order: bool = False) -> DataFrame:
    """Rows with each video in one task, in order of frame; rows that come so already are left as they are."""
    return rows if in_order else rows.repartition("video").sortWithinPartitions("video", "frame")
