from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import text as T
from tests.llm.data import AWKWARD, lowered, shingles

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab A\n\té.,7", max_size=40)), max_size=8)


def hashed_words(texts, separators):
    out = []
    for _, data, offsets in T.chunks(pa.array(texts, pa.string())):
        low = T.LOWER[data]
        start, end, bounds = T.words(low, offsets, separators)
        spans = [bytes(low[a:b]).decode() for a, b in zip(start, end)]
        out += [spans[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)]
    return out


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words(texts):
    assert hashed_words(texts, T.SPACE) == [[w for w in re.split(r"[\x20\x09-\x0D]+", lowered(t)) if w] for t in texts]
    assert hashed_words(texts, T.NON_ALNUM) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) for t in texts]


def test_sets_match_plain_shingles():
    texts = AWKWARD + ["a b c d e f a b c d e f", "A B C D E", "b a c d e"]
    sets = dict(T.word_sets(pa.array(texts, pa.string())))
    assert [len(sets[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(t) & shingles(u)), (i, j)


def test_sliced_arrays():
    column = pa.array(["x", None, "a b c d e", "f"]).slice(1, 2)
    assert [len(s) for _, s in T.word_sets(column)] == [0, 1]
