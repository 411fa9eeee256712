"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams it holds (ASCII lower case, hashed to BITS bits).
Training counts, per class, in how many texts an n-gram occurs; the log of the ratio of these smoothed,
normalised counts scales the feature, and a logistic regression is fitted on the scaled features. Every
n-gram of the training texts has a weight; none is selected. The objective is convex and is minimised to a
small gradient, so there is no number of rounds to choose. The scores are calibrated for fixed thresholds:
a slope and an offset are fitted on margins of training texts by models that have not seen them, and go
into the weights. The model, a table of 2^BITS weights, is fitted on a bounded sample of labelled rows (see
`labelled.sample`) and sent to the tasks; every text is scored whole, and nothing is shuffled.

Defined results: null and empty texts get the score of a text without features; scores lie in 0 to 1;
equal texts and equal rows get equal scores; without labelled rows of both classes every score is the prior
share; ids are cast to long, as the result holds them. Only the id, the text and the labels' two columns
are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import labelled
from frameloom.llm.frames import keyed_texts, over_batches
from frameloom.llm.text import mix, sorted_unique

ORDERS = (3, 4, 5)
#: Width of the hash of an n-gram; n-grams that meet share a weight.
BITS = 20
#: Penalty of the fit, and what is added to an n-gram's count in the positive class (in the other, in proportion
#: to its texts), which draws the ratios of rare n-grams to nothing. Chosen by cross-validation in the training
#: folds alone, see `choose_settings`.
L2, SMOOTH = 1e-4, 30.0
#: Parts of the sample whose margins calibrate the scores.
PARTS = 3
#: Bound of the training sample: rows of each class, and characters in all.
PER_CLASS = 2500
MAX_CHARS = 12_000_000
CHUNK_CHARS = 1 << 18
THRESHOLD = 0.3

_STEPS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def gram_buckets(texts: list[str | None], orders=ORDERS, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, rows, buckets): distinct (row, bucket) pairs of the n-grams of rows first:last, ascending."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last] or "") <= CHUNK_CHARS):
            total += len(texts[last] or "")
            last += 1
        part = [t or "" for t in texts[first:last]]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
        row = np.repeat(np.arange(first, last), np.diff(ends, prepend=0))
        rows, buckets = [], []
        h = np.full(len(points), 7, np.uint64)
        for n in range(1, max(orders) + 1):
            if len(points) < n:
                break
            h = h[: len(points) - n + 1] + points[n - 1 :] * _STEPS[n]
            if n not in orders:
                continue
            bucket = (mix(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(row[: len(bucket)] == row[n - 1 :])
            rows.append(row[at])
            buckets.append(bucket[at])
        pairs = sorted_unique(np.concatenate(rows) << bits | np.concatenate(buckets)) if rows else np.zeros(0, np.int64)
        yield first, last, pairs >> bits, pairs & ((1 << bits) - 1)
        first = last


class Grams:
    """The distinct n-grams of texts, by text and by n-gram; n-grams that no text holds have no column."""

    def __init__(self, texts: list[str]) -> None:
        buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for first, last, rows, found in gram_buckets(texts):
            buckets.append(found.astype(np.int32))
            sizes.append(np.bincount(rows - first, minlength=last - first))
        self.n_texts, every, size = len(texts), np.concatenate(buckets), np.concatenate(sizes)
        times = np.bincount(every, minlength=1 << BITS)
        self.held = np.flatnonzero(times)
        slot = np.zeros(1 << BITS, np.int32)
        slot[self.held] = np.arange(len(self.held))
        self.cols = slot[every]
        self.full = np.flatnonzero(size)  # texts with n-grams
        self.starts = (np.cumsum(size) - size)[self.full]
        self.col_starts = np.cumsum(times[self.held]) - times[self.held]
        row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        self.rows = row[np.argsort(self.cols, kind="stable")]
        self.room = np.empty(len(every))  # for one value of each entry

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Of each text, bias and the sum of the weights of its columns."""
        z = np.full(self.n_texts, bias)
        if len(self.full):
            z[self.full] += np.add.reduceat(weights.take(self.cols, out=self.room, mode="clip"), self.starts)
        return z

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Of each column, the sum of the values of the texts that hold it."""
        return np.add.reduceat(values.take(self.rows, out=self.room, mode="clip"), self.col_starts) if len(self.held) else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, memory: int = 5, rounds: int = 200, flat: float = 1e-3) -> np.ndarray:
    """x after limited-memory quasi-Newton steps, until the gradient's length is flat times the first one's."""
    value, slope = loss(x)
    enough = flat * np.linalg.norm(slope)
    pairs: deque = deque(maxlen=memory)
    for _ in range(rounds):
        if np.linalg.norm(slope) <= enough:
            break
        way, used = slope.copy(), []
        for s, y in reversed(pairs):
            used.append((s @ way) / (s @ y))
            way -= used[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, y), a in zip(pairs, reversed(used)):
            way += (a - (y @ way) / (s @ y)) * s
        step, fall = 1.0, slope @ way
        new_value, new_slope = loss(x - step * way)
        while new_value > value - 1e-4 * step * fall and step > 1e-9:
            step /= 2
            new_value, new_slope = loss(x - step * way)
        if new_value >= value:
            break
        moved, turned = -step * way, new_slope - slope
        if moved @ turned > 0:
            pairs.append((moved, turned))
        x, value, slope = x + moved, new_value, new_slope
    return x


def fit_grams(grams: Grams, y: np.ndarray, row_weight: np.ndarray, l2: float, smooth: float) -> tuple[np.ndarray, float]:
    """(weight of every column, bias), not calibrated; texts of weight 0 take no part."""
    prior = float(np.clip(np.average(y, weights=row_weight), 1e-3, 1 - 1e-3))
    of = [((y == c) & (row_weight > 0)).astype(float) for c in (0, 1)]
    p, q = grams.totals(of[1]) + smooth, grams.totals(of[0]) + smooth * of[0].sum() / of[1].sum()
    unseen = (1 << BITS) - len(grams.held)
    ratio = np.log(p / (p.sum() + unseen * smooth)) - np.log(q / (q.sum() + unseen * smooth * of[0].sum() / of[1].sum()))
    scale = row_weight / row_weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        z = grams.margins(w * ratio, b)
        miss = (sigmoid(z) - y) * scale
        value = float(scale @ (np.logaddexp(0, z) - y * z)) + 0.5 * l2 * float(w @ w)
        return value, np.append(grams.totals(miss) * ratio + l2 * w, miss.sum())

    x = minimised(loss, np.append(np.zeros(len(grams.held)), np.log(prior / (1 - prior))))
    return x[:-1] * ratio, float(x[-1])


def calibration(z: np.ndarray, y: np.ndarray, row_weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through margins of unseen texts; the targets are smoothed by one text of each class."""
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    scale = row_weight / row_weight.sum()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        curve = x[0] * z + x[1]
        miss = (sigmoid(curve) - target) * scale
        return float(scale @ (np.logaddexp(0, curve) - target * curve)), np.array([miss @ z, miss.sum()])

    a, b = minimised(loss, np.array([1.0, 0.0]), flat=1e-7)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(texts: list[str], labels: list[int], negative_weight: float, l2: float = L2, smooth: float = SMOOTH, parts: int = PARTS) -> tuple[np.ndarray, float]:
    """(weight of every bucket, bias), calibrated on parts of the texts; equal texts are of one part. parts 0: not calibrated."""
    y = np.array(labels, float)
    row_weight = np.where(y == 1, 1.0, negative_weight)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        prior = float(np.clip(np.average(y, weights=row_weight), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return weights, float(np.log(prior / (1 - prior)))
    grams = Grams(texts)
    own, bias = fit_grams(grams, y, row_weight, l2, smooth)
    part = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % max(parts, 1) for t in texts])
    a, b = 1.0, 0.0
    if parts > 1 and all(len(np.unique(y[part != p])) == 2 for p in range(parts)):
        z = np.zeros(len(y))
        for p in range(parts):
            z[part == p] = grams.margins(*fit_grams(grams, y, np.where(part == p, 0.0, row_weight), l2, smooth))[part == p]
        a, b = calibration(z, y, row_weight)
    weights[grams.held] = a * own
    return weights, a * bias + b


def score_texts(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(texts), bias)
    for first, last, rows, buckets in gram_buckets(texts):
        z[first:last] += np.bincount(rows - first, weights[buckets], last - first)
    return sigmoid(z)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    found = labelled.sample(docs, labels, label_col, folds, held_out, per_class, max_chars, id_col, text_col)
    # a table of a fixed size
    model = docs.sparkSession.sparkContext.broadcast(fit(found.texts, found.labels, found.negative_weight))

    def score(batch: pa.RecordBatch) -> dict:
        s = score_texts(batch.column(1).to_pylist(), *model.value)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    rows = keyed_texts(docs, id_col, text_col).withColumn("held_out", labelled.fold(F.col("doc_id"), folds) == held_out)
    return over_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int")
