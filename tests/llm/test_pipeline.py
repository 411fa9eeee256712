"""The stages of the pipeline, each on its own input, against plain definitions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from frameloom.llm import pieces, quality_fm, queries
from frameloom.session import staged, table
from tests.llm.data import docs_frame, lowered
from tests.llm.test_exact import joined_by_hand, kept_by_hand, tiled_by_hand


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = table(spark, sf, "documents"), []
    for name, stage in P.STAGES:
        made = staged(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return sf, out


def test_columns(stages, spark):
    sf, out = stages
    names = table(spark, sf, "documents").columns
    assert [made.columns for _, _, made in out[:-1]] == [names] * 4
    assert [n for n, _, _ in out] == ["quality", "line_dedup", "near_duplicates", "decontamination", "pieces"]
    assert P.run(spark, sf).count() == out[-1][2].count()


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_against_all_pairs(stages, spark):
    """The decision of the stage's own model, with every pair of fields multiplied out."""
    sf, out = stages
    docs, kept = rows_of(out[0][1]), rows_of(out[0][2])
    model = quality_fm.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    short = [r for r in docs.values() if r.text and len(set(r.text.lower().split())) <= 150]
    assert len(short) > 50
    dense, rows, buckets, values = quality_fm.features(pa.array([r.text for r in short]), np.array([r.n_chars for r in short], float))
    for i, r in enumerate(short):
        x = [(k, (dense[i, k] - model["mean"][k]) / model["spread"][k]) for k in range(quality_fm.N_DENSE)] + [(quality_fm.N_DENSE + b, v) for b, v in zip(buckets[rows == i], values[rows == i])]
        at, v = np.array([k for k, _ in x]), np.array([u for _, u in x])
        scaled = model["v"][at] * v[:, None]
        z = model["bias"] + model["w"][at] @ v + np.triu(scaled @ scaled.T, 1).sum()
        if abs(z) > 1e-6:
            assert (r.doc_id in kept) == (z >= 0), r.doc_id
    assert all(kept[i] == docs[i] for i in kept)


def test_lines_by_hand(stages):
    _, out = stages
    before, after = rows_of(out[1][1]), rows_of(out[1][2])
    want = kept_by_hand([(i, r.text) for i, r in before.items()], 10)
    assert {i: hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in after.items()} == {i: w[2] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in after.items())


def test_near_duplicates_by_hand(stages):
    _, out = stages
    before, after = rows_of(out[2][1]), rows_of(out[2][2])
    ids = sorted(before)
    components = joined_by_hand([before[i].text for i in ids])
    assert set(after) == {ids[c] for _, c, _ in components.values()} and all(after[i] == before[i] for i in after)
    assert len(after) < len(before)


def test_leaks_by_hand(stages, spark):
    sf, out = stages
    before, after = rows_of(out[3][1]), rows_of(out[3][2])
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered(t))
    runs = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    items = [words(r.text) for r in table(spark, sf, "benchmark").collect()]
    for i, r in before.items():
        text = words(r.text)
        shared = [x for x in items if runs(x) & runs(text)]
        leaked = any(tiled_by_hand(text, x, 5) >= 0.5 * len(x) for x in shared)
        assert leaked == (i not in after), i
    assert all(after[i] == before[i] for i in after)


def test_pieces_give_the_texts_back(stages, spark):
    _, out = stages
    path = queries.tokenizer_file("piece_bpe_32k.model")
    before = rows_of(out[4][1])
    assert {r.doc_id: r.text for r in pieces.decode(out[4][2], path).collect()} == {i: r.text or "" for i, r in before.items()}


def test_last_stage_decodes(spark):
    texts = ["a  plain text", "", None, "\u65e5\u672c\nlast", "mark \u2581 inside"]
    got = {r.doc_id: r for r in P.coded(spark, docs_frame(spark, texts), "").collect()}
    back = [(t or "").replace("\u2581", " ") for t in texts]
    assert [got[i].decoded_sha256 for i in range(5)] == [hashlib.sha256(t.encode()).hexdigest() for t in back]
    assert [got[i].round_trip for i in range(5)] == [True] * 4 + [False]
