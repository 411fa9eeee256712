"""Classifiers: held-out accuracy, the factorisation identity, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import choose_settings, labelled, quality_fm, queries, toxicity
from frameloom.session import table
from tests.llm.data import AWKWARD, docs_frame


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,fold,least", [("op2_toxicity", "toxic", (4, 2), 0.9), ("op10_quality_fm", "quality", (3, 1), 0.95)])
def test_held_out(spark, big, name, label, fold, least):
    rows = queries.queries()[name](spark, big).collect()
    truth = {r.doc_id: r[label] for r in table(spark, big, "labels").collect()}
    assert len(rows) == table(spark, big, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= least


def test_square_identity():
    rng = np.random.default_rng(4)
    texts = pa.array(["a b a c", "d e", ""])
    dense, rows, buckets, values = quality_fm.features(texts, np.full(3, np.nan))
    size = quality_fm.N_DENSE + (1 << quality_fm.BITS)
    model = {"bias": 0.1, "w": rng.normal(size=size), "v": rng.normal(size=(size, 8)), "mean": np.zeros(quality_fm.N_DENSE), "spread": np.ones(quality_fm.N_DENSE)}
    z, _ = quality_fm.margins(model, dense, rows, buckets, values)
    for i in range(3):
        x = [(j, v) for j, v in enumerate(dense[i])] + [(quality_fm.N_DENSE + b, v) for r, b, v in zip(rows, buckets, values) if r == i]
        want = 0.1 + sum(model["w"][j] * v for j, v in x)
        want += sum(model["v"][j] @ model["v"][k] * u * v for a, (j, u) in enumerate(x) for k, v in x[a + 1 :])
        assert z[i] == pytest.approx(want)


TEXTS = ["you idiot, you!", "a calm day", "idiot idiot moron", "calm and clean. It ends.", "what a moron you are", "a day in the sun", "", "moron, idiot"]
LABELS = [1, 0, 1, 0, 1, 0, 0, 1]


def adam(steps, rate, floor, w, grad_of):
    """Plain Adam over a dict of parameters."""
    m, v = ({k: 0.0 for k in w} for _ in range(2))
    for t in range(1, steps + 1):
        for k, g in grad_of(w).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
        for k in w:
            w[k] -= (rate[k] if isinstance(rate, dict) else rate) * (m[k] / (1 - 0.9**t)) / ((v[k] / (1 - 0.99**t)) ** 0.5 + floor)
    return w


def test_toxicity_against_plain_python():
    """Counts, ratios and scores over n-grams as strings; at the fit's minimum the plain gradient vanishes."""
    weight, smooth, l2 = 2.5, 3.0, 1e-2
    grams_of = lambda t: {x[i : i + n] for x in [(t or "").lower()] for n in toxicity.ORDERS for i in range(len(x) - n + 1)}
    grams = [grams_of(t) for t in TEXTS]
    every = sorted(set().union(*grams))
    bucket = {g: int(next(toxicity.gram_buckets([g], orders=(len(g),)))[3][0]) for g in every}
    assert len(set(bucket.values())) == len(every)
    size = 1 << toxicity.BITS
    count = {c: {g: sum(g in x for x, y in zip(grams, LABELS) if y == c) for g in every} for c in (0, 1)}
    total = {c: sum(count[c].values()) + smooth * size for c in (0, 1)}
    ratio = {g: np.log((count[1][g] + smooth) / total[1]) - np.log((count[0][g] + smooth) / total[0]) for g in every}
    weights, bias = toxicity.fit(TEXTS, LABELS, weight, l2=l2, smooth=smooth, parts=0)
    assert set(np.flatnonzero(weights)) <= set(bucket.values())

    def margin(t):
        return bias + sum(float(weights[bucket[g]]) for g in grams_of(t) if g in bucket)

    scale = [(1.0 if y else weight) / (4 + 4 * weight) for y in LABELS]
    miss = [(1 / (1 + np.exp(-margin(t))) - y) * s for t, y, s in zip(TEXTS, LABELS, scale)]
    first = [(0.5 - y) * s for y, s in zip(LABELS, scale)]
    slope = lambda m, w: np.array([sum(a for a, x in zip(m, grams) if g in x) * ratio[g] + l2 * w(g) for g in every] + [sum(m)])
    own = lambda g: float(weights[bucket[g]]) / ratio[g] if ratio[g] else 0.0
    assert np.linalg.norm(slope(miss, own)) < 2e-3 * np.linalg.norm(slope(first, lambda g: 0.0))
    new = [*TEXTS, None, "IDIOT", "x" * 50]
    assert toxicity.score_texts(new, weights, bias) == pytest.approx([1 / (1 + np.exp(-margin(t))) for t in new], abs=1e-5)


def test_every_ngram_of_training_has_a_weight():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnop"), 400)) for _ in range(60)]
    labels = [i % 3 == 0 for i in range(60)]
    weights, _ = toxicity.fit(texts, labels, 1.0, smooth=1.0)
    seen = {int(b) for _, _, _, buckets in toxicity.gram_buckets(texts) for b in buckets}
    assert len(seen) > 20_000 and len(seen - set(np.flatnonzero(weights).tolist())) < 0.01 * len(seen)


def test_calibration_fits_unseen_margins():
    rng = np.random.default_rng(5)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = toxicity.calibration(z, y, np.ones(4000))
    assert a == pytest.approx(0.5, abs=0.05) and b == pytest.approx(-1, abs=0.1)
    assert toxicity.calibration(-z, y, np.ones(4000)) == (1.0, 0.0)  # a falling curve would turn the order round


def test_minimum_of_a_quadratic():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(30, 30))
    m = m @ m.T + np.eye(30)
    want = rng.normal(size=30)
    got = toxicity.minimised(lambda x: (0.5 * (x - want) @ m @ (x - want), m @ (x - want)), np.zeros(30), flat=1e-9)
    assert got == pytest.approx(want, abs=1e-5)


def test_quality_against_plain_python():
    """Statistics by hand, and the fit of all pairwise interactions without the square identity."""
    recorded = np.array([5.0, 10, 17, 24, np.nan, 16, 0, 12])
    dense, rows, buckets, values = quality_fm.features(pa.array(TEXTS), recorded)
    names = [*quality_fm.STATISTICS, *quality_fm.METADATA]
    for i, t in enumerate(TEXTS):
        w = t.split()
        n = max(1, len(w))
        want = {
            "upper": sum(c.isupper() for c in t) / max(1, len(t)), "stop": sum(c in ".?" for c in t) / max(1, len(t)), "comma": sum(c in ",;:" for c in t) / max(1, len(t)),
            "bang": t.count("!") / max(1, len(t)), "line": min(1 / n, 1.0), "word_length": sum(map(len, w)) / n / 10, "log_words": np.log1p(len(w)) / 10, "distinct": len({x.lower() for x in w}) / n,
            "top_word": max((w.count(x) for x in w), default=0) / n, "short": sum(len(x) <= 3 for x in w) / n, "unpunctuated": sum(x[-1].isalnum() for x in w) / n,
            "repeats_next": sum(a == b for a, b in zip(w, w[1:])) / n, "recorded_length": 0.0 if np.isnan(recorded[i]) else np.clip(np.log1p(recorded[i]) - np.log1p(len(t)), -3, 3),
        }
        for name, value in want.items():
            assert dense[i, names.index(name)] == pytest.approx(value), (t, name)
        own = sorted(values[rows == i])
        assert own == pytest.approx(sorted((w.count(x) / n) ** 0.5 for x in set(w)))
    rounds, l2, weight = 3, 1e-2, 2.0
    model = quality_fm.fit(TEXTS, recorded, LABELS, weight, epochs=rounds, l2=l2)
    x = (dense - dense.mean(axis=0)) / (np.maximum(dense.std(axis=0), 1e-3) * 2)
    fields = [{j: x[i, j] for j in range(quality_fm.N_DENSE)} | {quality_fm.N_DENSE + b: v for r, b, v in zip(rows, buckets, values) if r == i} for i in range(8)]
    used = sorted(set().union(*fields))
    start = np.random.default_rng(7).normal(0, 0.02, (quality_fm.N_DENSE + (1 << quality_fm.BITS), quality_fm.FACTORS))
    scale = [(1.0 if y else weight) / (4 + 4 * weight) for y in LABELS]
    prior = 4 / (4 + 4 * weight)
    params = {("w", j): 0.0 for j in used} | {("v", j, f): start[j, f] for j in used for f in range(quality_fm.FACTORS)} | {"bias": float(np.log(prior / (1 - prior)))}

    def margin(p, x):
        own = [(j, u, np.array([p["v", j, f] for f in range(quality_fm.FACTORS)])) for j, u in x.items()]
        return p["bias"] + sum(p["w", j] * u for j, u, _ in own) + sum(a[2] @ b[2] * a[1] * b[1] for k, a in enumerate(own) for b in own[k + 1 :])

    def grad(p):
        g = {k: 0.0 if k == "bias" else l2 * v for k, v in p.items()}
        for x, y, s in zip(fields, LABELS, scale):
            miss = (1 / (1 + np.exp(-margin(p, x))) - y) * s
            g["bias"] += miss
            for j, u in x.items():
                g["w", j] += miss * u
                for f in range(quality_fm.FACTORS):
                    g["v", j, f] += miss * u * sum(p["v", k, f] * o for k, o in x.items() if k != j)
        return g

    rate = {k: 0.01 if k[0] == "v" else 0.05 for k in params}
    p = adam(rounds, rate, 1e-6, params, grad)
    assert model["bias"] == pytest.approx(p["bias"], abs=1e-4)
    assert [model["w"][j] for j in used] == pytest.approx([p["w", j] for j in used], abs=2e-3)
    assert [model["v"][j, 0] for j in used] == pytest.approx([p["v", j, 0] for j in used], abs=2e-3)
    assert quality_fm.score_texts(model, pa.array(TEXTS), recorded) == pytest.approx([1 / (1 + np.exp(-margin(p, x))) for x in fields], abs=2e-3)


def test_labels_without_documents_and_giant_texts_take_no_place(spark):
    docs = docs_frame(spark, ["text %d" % i for i in range(20)] + ["giant " * 2000], range(21))
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)] + [(1000 + i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", 4, 2, per_class=20, max_chars=1000)
    own = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(found.texts) == sorted("text %d" % i for i in own)
    assert sorted(found.labels) == sorted(i % 2 for i in own)
    assert labelled.sample(docs, labels, "toxic", 4, 2, per_class=2, max_chars=1000).labels.count(1) == 2
    twice = labelled.sample(docs.unionByName(docs), labels, "toxic", 4, 2, per_class=20, max_chars=1000)
    assert sorted(twice.texts) == sorted(found.texts)


def test_settings_are_chosen_without_held_out_rows():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd"), 30)) + (" idiot" if i % 2 else " a calm") for i in range(60)]
    found = labelled.Sample(texts, [None] * 60, [i % 2 for i in range(60)], 1.0)
    best = labelled.cross_validated(found, [{"l2": 1e-3, "smooth": 3.0, "parts": 0}, {"l2": 1e3, "smooth": 3.0, "parts": 0}], choose_settings.toxicity_scores)
    assert best[0][1]["l2"] == 1e-3 and best[0][0] < 0.3 < best[1][0]


@pytest.mark.parametrize("report,label", [(toxicity.toxicity_report, "toxic"), (quality_fm.quality_report, "quality")])
def test_repeated_rows_and_ties_score_alike(spark, report, label):
    texts = ["you idiot moron " * 3] * 6 + ["a calm and clean text. It ends here."] * 6
    docs = docs_frame(spark, texts * 2, [*range(12), *[3] * 6, *[None] * 6])
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)] * 2, f"doc_id long, {label} int")
    got = report(docs, labels).collect()
    assert len(got) == 24 and len({round(r.score, 12) for r in got}) == 2


def test_gram_buckets_are_distinct_grams():
    texts = [None, "", "ab", "abc abc", "IDIOT idiot", "é日本"]
    seen: dict = {}
    for first, _, rows, buckets in toxicity.gram_buckets(texts):
        for r in set(rows.tolist()):
            seen[r] = set(buckets[rows == r].tolist())
    grams = lambda t: {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    assert {i: len(seen.get(i, ())) for i in range(6)} == {i: len(grams((t or "").lower())) for i, t in enumerate(texts)}


@pytest.mark.parametrize("report,label", [(toxicity.toxicity_report, "toxic"), (quality_fm.quality_report, "quality")])
def test_awkward_rows(spark, report, label):
    texts = AWKWARD + ["you idiot moron " * 3] * 6 + ["a calm and clean text. It ends here."] * 6
    labels = spark.createDataFrame([(i, int(i >= len(AWKWARD) + 6), 1) for i in range(len(texts))] + [(None, 1, 1), (999, 0, 1), (0, 5, 1)], f"doc_id long, {label} int, text int")
    got = report(docs_frame(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    none = report(docs_frame(spark, texts), labels.limit(0)).collect()
    assert len({round(r.score, 9) for r in none}) == 1
    assert report(docs_frame(spark, []), labels).count() == 0


def test_recorded_length_is_fitted(spark):
    texts = [" ".join("w%d" % (i * j % 17) for j in range(30 + i % 7)) for i in range(60)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")
    stale = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") * 5).otherwise(F.col("n_chars")))
    at = len(quality_fm.STATISTICS)
    assert quality_fm.train(stale, labels)["w"][at] < -0.1
    right = quality_fm.train(docs, labels)
    a, b = ({r.doc_id: r.score for r in quality_fm.scored(d, right).collect()} for d in (docs, stale))
    assert a == pytest.approx(b)


def test_keep_good(spark, big):
    docs = table(spark, big, "documents")
    kept = quality_fm.keep_good(docs, table(spark, big, "labels"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.join(docs, docs.columns, "left_anti").count() == 0
