"""Chooses the classifiers' settings by cross-validation inside their training folds.

`python -m frameloom.llm.choose_settings /path/to/tables [toxicity|quality]` prints, for both classifiers or one, the mean log loss of
every candidate on the part of the training sample that was left out. Rows of the held-out folds are never
read, so the figures of those rows stay honest. The constants in `toxicity` and `quality_fm` are the best
candidates of such a run.
"""

from __future__ import annotations

import sys
from itertools import product

import numpy as np
import pyarrow as pa

from frameloom.llm import labelled, quality_fm, toxicity
from frameloom.session import local_session, table

PER_CLASS = 800
#: Calibration moves all scores along one curve, so candidates are compared without it.
TOXICITY = [{"l2": l2, "smooth": n, "parts": 0} for l2, n in product((1e-5, 1e-4, 1e-3, 1e-2), (3.0, 10.0, 30.0, 100.0))]
QUALITY = [{"epochs": n, "l2": l2} for n, l2 in product((4, 8, 16), (1e-4, 1e-3, 1e-2))]


def toxicity_scores(fitted: labelled.Sample, left: labelled.Sample, settings: dict) -> np.ndarray:
    return toxicity.score_texts(left.texts, *toxicity.fit(fitted.texts, fitted.labels, fitted.negative_weight, **settings))


def quality_scores(fitted: labelled.Sample, left: labelled.Sample, settings: dict) -> np.ndarray:
    model = quality_fm.fit(fitted.texts, np.array(fitted.lengths, float), fitted.labels, fitted.negative_weight, **settings)
    return quality_fm.score_texts(model, pa.array(left.texts, pa.string()), np.array(left.lengths, float))


def main(sf_dir: str, which: str = "toxicity quality") -> None:
    spark = local_session(name="choose-settings")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    for name, column, folds, held_out, candidates, scores in (("toxicity", "toxic", 4, 2, TOXICITY, toxicity_scores), ("quality", "quality", 3, 1, QUALITY, quality_scores)):
        if name not in which:
            continue
        found = labelled.sample(docs, labels, column, folds, held_out, PER_CLASS, 10_000_000, length_col="n_chars")
        for loss, settings in labelled.cross_validated(found, candidates, scores):
            print(f"{name} {loss:.5f} {settings}")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])
