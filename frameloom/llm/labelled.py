"""Bounded samples of labelled texts for the classifiers, and the split that keeps held-out rows away."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import staged


class Sample(NamedTuple):
    """Texts with their recorded lengths and labels, and the weight of a negative row against a positive one."""

    texts: list[str]
    lengths: list[float | None]
    labels: list[int]
    negative_weight: float


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", length_col: str = "") -> Sample:
    """Labelled documents outside the held-out fold.

    At most per_class documents of each class in the order of a hash of the id, whole texts. A document
    whose text would go beyond max_chars characters in all is passed over; that is decided on lengths, so
    no text beyond the bound is sent. Rows whose label is neither 0 nor 1, and labels without a document,
    are left out before anything is limited; of conflicting labels of one id the larger counts, and so of
    the recorded lengths of equal rows. The weight restores the share of the classes among all labelled
    documents.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).where(fold(F.col("doc_id"), folds) != held_out)
    length = F.col(f"`{length_col}`") if length_col in docs.columns else F.lit(None)
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), length.cast("double").alias("length"))
    sizes = keyed.select("doc_id", F.length("text").cast("long").alias("chars")).groupBy("doc_id").agg(F.sum("chars").alias("chars"))
    found = staged(known.join(sizes, "doc_id"), "labelled", small=True)
    share = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    # per_class small rows of each class, whatever the size of the tables
    rows = [r for c in (0, 1) for r in found.where(F.col("label") == c).select("doc_id", "label", "chars", order.alias("at")).orderBy(order, "doc_id").limit(per_class).collect()]
    picked, total = [], 0
    for r in sorted(rows, key=lambda r: r["at"]):
        if total + r["chars"] <= max_chars:
            picked.append((r["doc_id"], r["label"]))
            total += r["chars"]
    ids = docs.sparkSession.createDataFrame(picked, found.select("doc_id", "label").schema)
    texts = keyed.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "text").agg(F.max("length").alias("length"))
    got = sorted(texts.select(order.alias("at"), "doc_id", "label", "text", "length").collect(), key=lambda r: (r["at"], r["text"]))
    labels_found = [r["label"] for r in got]
    n = [max(1, labels_found.count(c)) for c in (0, 1)]
    weight = (share.get(0, 1) / n[0]) / (share.get(1, 1) / n[1])
    return Sample([r["text"] for r in got], [r["length"] for r in got], labels_found, weight)


def cross_validated(found: Sample, candidates: list[dict], loss_of, folds: int = 3) -> list[tuple[float, dict]]:
    """(mean weighted log loss on the fold left out, settings) of each candidate, best first; only the sample is used.

    loss_of: a function of (sample to fit, sample to score, settings) that gives the scores of the latter.
    """
    part = np.arange(len(found.texts)) % folds
    take = lambda at: Sample([found.texts[i] for i in at], [found.lengths[i] for i in at], [found.labels[i] for i in at], found.negative_weight)
    out = []
    for settings in candidates:
        losses = []
        for f in range(folds):
            fitted, left = take(np.flatnonzero(part != f)), take(np.flatnonzero(part == f))
            p = np.clip(loss_of(fitted, left, settings), 1e-6, 1 - 1e-6)
            y = np.array(left.labels)
            weights = np.where(y == 1, 1.0, found.negative_weight)
            losses.append(float(np.average(-np.where(y == 1, np.log(p), np.log(1 - p)), weights=weights)))
        out.append((float(np.mean(losses)), settings))
    return sorted(out, key=lambda x: x[0])
