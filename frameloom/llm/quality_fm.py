"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

A text's fields are its distinct hashed words (value: share of the text's words, square-rooted and scaled
to unit length), a fixed set of structure statistics measured on its bytes, and metadata of the row (its
recorded length against the measured one). The score is a bias, a linear part, and pairwise interactions
of all fields through k-dimensional factors. The interactions of n fields are not summed over pairs: for
each factor they are half of (sum of v x) squared minus the sum of (v x) squared, linear in n.

The model has a fixed size, is fitted on a bounded sample of labelled rows (`labelled.sample`) and goes
to the tasks as one broadcast; every text is scored whole and nothing is shuffled.

Defined results: null and empty texts score as texts whose statistics are all zero; a null or missing
recorded length counts as right; if all lengths of the sample are equally right, the recorded length adds
nothing to any score; equal rows get equal scores; without labelled rows of both classes
every score is the prior share. Only the id, the text, the recorded length and the labels' two columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import labelled
from frameloom.llm.frames import named, numbered, over_batches
from frameloom.llm.text import LOWER, NON_ALNUM, SPACE, chunks, span_hashes, words

BITS = 15
FACTORS = 8
#: Bound of the training sample: rows of each class, and characters in all.
PER_CLASS = 2500
MAX_CHARS = 20_000_000
THRESHOLD = 0.5
#: Chosen by cross-validation in the training folds alone, see `choose_settings`.
EPOCHS, L2 = 16, 1e-4
BATCH = 128

_CLASS = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "stop": np.array([chr(b) in ".?" for b in range(256)]),
    "comma": np.array([chr(b) in ",;:" for b in range(256)]),
    "bang": np.array([chr(b) == "!" for b in range(256)]),
    "pipe": np.array([chr(b) == "|" for b in range(256)]),
    "symbol": np.array([chr(b) in "#$%&*@^~<>{}[]\\/=+_" for b in range(256)]),
    "wide": np.array([b >= 0x80 for b in range(256)]),
    "line": np.array([b == 10 for b in range(256)]),
}
STATISTICS = [*_CLASS, "word_length", "log_words", "distinct", "top_word", "short", "unpunctuated", "repeats_next"]
METADATA = ["recorded_length"]
N_DENSE = len(STATISTICS) + len(METADATA)


def features(texts: pa.Array, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dense statistics of every row; rows, buckets and values of the distinct hashed words)."""
    n = len(texts)
    out = np.zeros((n, N_DENSE))
    rows, buckets, values = [], [], []
    for first, data, offsets in chunks(texts):
        m = len(offsets) - 1
        length = np.maximum(np.diff(offsets), 1)
        block = out[first : first + m]
        for j, table in enumerate(_CLASS.values()):
            total = np.concatenate([[0], np.cumsum(table[data])])
            block[:, j] = np.diff(total[offsets]) / length
        lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
        start, end, bounds = words(data, offsets, SPACE)
        count = np.diff(bounds)
        some = np.maximum(count, 1)
        sizes = np.concatenate([[0], np.cumsum(end - start)])
        h = span_hashes(LOWER[data], start, end)
        row = np.repeat(np.arange(m), count)
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        pairs, times = np.unique(row << BITS | bucket, return_counts=True)
        r, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
        norm = np.sqrt(times / some[r])
        rows.append(r + first)
        buckets.append(b)
        values.append(norm)
        j = len(_CLASS)
        block[:, j] = np.diff(sizes[bounds]) / some / 10
        block[:, j + 1] = np.log1p(count) / 10
        block[:, j + 2] = np.bincount(r, minlength=m) / some
        top = np.zeros(m)
        np.maximum.at(top, r, times)
        block[:, j + 3] = top / some
        block[:, j + 4] = np.bincount(row, end - start <= 3, m) / some
        plain = ~NON_ALNUM[data[end - 1]] if len(end) else np.zeros(0, bool)
        block[:, j + 5] = np.bincount(row, plain, m) / some
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        block[:, j + 6] = np.bincount(row, same, m) / some
        chars = np.diff(offsets) - np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])[offsets])
        said = recorded[first : first + m]
        block[:, j + 7] = np.where(np.isnan(said), 0.0, np.clip(np.log1p(np.maximum(np.nan_to_num(said), 0)) - np.log1p(chars), -3, 3))
        block[:, 8] = np.minimum(lines / some, 1.0)
    empty = np.zeros(0, np.int64)
    return (out, *(np.concatenate(x) if x else empty.astype(t) for x, t in ((rows, int), (buckets, int), (values, float))))


def summed(x: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of x's rows by their ascending group numbers below n."""
    out = np.zeros((n, *x.shape[1:]), x.dtype)
    if len(groups):
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[starts]] = np.add.reduceat(x, starts, axis=0)
    return out


def margins(model: dict, dense: np.ndarray, rows: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw scores, sums of v x per row and factor); rows ascend."""
    x = (dense - model["mean"]) / model["spread"]
    n = len(x)
    v, at = model["v"], N_DENSE + buckets
    part = v[at] * values[:, None]
    total = x @ v[:N_DENSE] + summed(part, rows, n)
    squares = x**2 @ (v[:N_DENSE] ** 2) + summed(part * part, rows, n)
    z = model["bias"] + x @ model["w"][:N_DENSE] + np.bincount(rows, model["w"][at] * values, n)
    return z + 0.5 * (total**2 - squares).sum(axis=1), total


def fit(texts: list[str], recorded: np.ndarray, labels: list[int], negative_weight: float, epochs: int = EPOCHS, l2: float = L2, batch: int = BATCH) -> dict:
    """Adam on the weighted logistic loss, in batches of rows, from a fixed start; buckets that no text has keep no weight."""
    y = np.array(labels, float)
    row_weight = np.where(y == 1, 1.0, negative_weight)
    prior = float(np.clip(np.average(y, weights=row_weight), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    size = N_DENSE + (1 << BITS)
    model = {"bias": float(np.log(prior / (1 - prior))), "w": np.zeros(size), "v": np.zeros((size, FACTORS)), "mean": np.zeros(N_DENSE), "spread": np.ones(N_DENSE)}
    if not len(y) or y.min() == y.max():
        return model
    dense, rows, buckets, values = features(pa.array(texts, pa.string()), recorded)
    model["mean"], model["spread"] = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3) * 2
    seen, local = np.unique(buckets, return_inverse=True)
    used = np.concatenate([np.arange(N_DENSE), N_DENSE + seen])
    v = np.random.default_rng(7).normal(0, 0.02, (size, FACTORS))[used]
    meta = slice(len(STATISTICS), N_DENSE)
    v[meta][dense[:, meta].std(axis=0) == 0] = 0  # nothing to learn: it adds nothing to any score either
    small = model | {"w": np.zeros(len(used)), "v": v}
    state = {k: [np.zeros_like(small[k]), np.zeros_like(small[k])] for k in ("w", "v")}
    bias_state = [0.0, 0.0]
    parts = []  # in half the width, since they are held until the end
    for first in range(0, len(y), batch):
        low, high = np.searchsorted(rows, [first, first + batch])
        own, column, value = (rows[low:high] - first).astype(np.int32), local[low:high].astype(np.int32), values[low:high].astype(np.float32)
        order = np.argsort(column, kind="stable")
        at = slice(first, first + batch)
        parts.append((at, dense[at], own, column, value, own[order], column[order], value[order], row_weight[at] / row_weight[at].sum()))

    def stepped(grad, s, t, rate):
        s[0] = 0.9 * s[0] + 0.1 * grad
        s[1] = 0.99 * s[1] + 0.01 * grad**2
        return rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-6)

    t = 0
    for _ in range(epochs):
        for at, block, own, column, value, own_sorted, column_sorted, value_sorted, scale in parts:
            t += 1
            x = (block - model["mean"]) / model["spread"]
            z, total = margins(small, block, own, column, value)
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * scale
            missed = miss[:, None] * total
            gw = np.concatenate([x.T @ miss, np.bincount(column, miss[own] * value, len(seen))]) + l2 * small["w"]
            squares = np.concatenate([(x**2).T @ miss, np.bincount(column, miss[own] * value**2, len(seen))])
            cross = np.concatenate([x.T @ missed, summed(missed[own_sorted] * value_sorted[:, None], column_sorted, len(seen))])
            gv = l2 * small["v"] + cross - small["v"] * squares[:, None]
            small["w"] = small["w"] - stepped(gw, state["w"], t, 0.05)
            small["v"] = small["v"] - stepped(gv, state["v"], t, 0.01)
            small["bias"] -= float(stepped(miss.sum(), bias_state, t, 0.05))
    model["bias"] = small["bias"]
    model["w"][used], model["v"][used] = small["w"], small["v"]
    return model


def score_texts(model: dict, texts: pa.Array, recorded: np.ndarray) -> np.ndarray:
    z, _ = margins(model, *features(texts, recorded))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> dict:
    """The model from the labelled rows outside the held-out fold, with their recorded lengths."""
    found = labelled.sample(docs, labels, label_col, folds, held_out, per_class, max_chars, id_col, text_col, length_col)
    return fit(found.texts, np.array(found.lengths, float), found.labels, found.negative_weight)


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns named in carry, per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    length = F.col(f"`{length_col}`") if length_col in docs.columns else F.lit(None)
    id_column = F.col(f"`{id_col}`")
    rows = docs.select(id_column.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), length.cast("double").alias("length"), (labelled.fold(id_column, folds) == held_out).alias("held_out"), *(F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)))

    def score(batch: pa.RecordBatch) -> dict:
        s = score_texts(shared.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(float))
        out = {"doc_id": batch.column(0), "held_out": batch.column(3), "score": s, "predicted": (s >= threshold).astype(np.int32)}
        return out | {f"carry_{i}": batch.column(4 + i) for i in range(len(carry))}

    kinds = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = over_batches(rows, score, "doc_id long, held_out boolean, score double, predicted int" + kinds)
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, **how) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col, length_col=length_col, **how)
    return scored(docs, model, id_col, text_col, length_col, folds, held_out, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, length_col=length_col, **how)
    carried, at = numbered(docs)
    rows = scored(carried, model, at[id_col], at[text_col], at.get(length_col, ""), threshold=threshold, carry=tuple(carried.columns))
    return named(rows.where(F.col("predicted") == 1), at)
