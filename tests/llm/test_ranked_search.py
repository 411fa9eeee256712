"""Ranked lexical search against a plain scorer, for any blocks, ties, repeated rows and nulls."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import ranked_search
from tests.llm.data import AWKWARD, docs_frame, lowered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best(docs, items, k):
    """(item, rank, doc, score) by the definition; docs and items are lists of (id, text)."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    N, L = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lowered(text))) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [(2048, 4_000_000), (3, 4_000_000), (2048, 60)])
def test_against_the_definition(spark, monkeypatch, blocks):
    rng = np.random.default_rng(4)
    word = lambda: "abcdefghij"[int(rng.zipf(1.6)) % 10] * int(rng.integers(1, 3))
    texts = AWKWARD + [" ".join(word() for _ in range(int(rng.integers(1, 30)))) for _ in range(150)] + ["a b c"] * 25 + ["Ünï Code-ñ 1a2"]
    ids = [None if i % 40 == 7 else int(x) for i, x in enumerate(rng.integers(-20, 120, len(texts)))]
    items = [(1, "a b c"), (2, "A aa, b!"), (2, "A aa, b!"), (None, "j i h"), (4, None), (5, ""), (6, "ünï ÜNÏ code"), (7, "zzz"), (8, "a")]
    docs = docs_frame(spark, texts, ids)
    asked = spark.createDataFrame([(i, t, 0.5, "q") for i, t in items], "item_id long, text string, score double, query string")
    for postings in (1 << 20, 40):
        monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
        got = ranked_search.top_documents(docs.repartition(3), asked, k=10, block_items=blocks[0], block_chars=blocks[1]).collect()
        assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == best(list(zip(ids, texts)), items, 10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 5), st.integers(0, 4), max_size=6), max_size=25), st.sets(st.integers(0, 5), min_size=1), st.integers(1, 4), st.integers(0, 9))
def test_a_block_finds_its_best(docs, asked, k, least):
    """Whatever the impacts and the score that others have: no document is missed, and every score is whole."""
    lengths = np.array([len(d) for d in docs], np.int64)
    terms = np.array([t for d in docs for t in sorted(d)], np.int64)
    impact = np.array([d[t] for d in docs for t in sorted(d)], np.int64)
    block = ranked_search.Block(lengths, terms, impact, 6)
    want = {i: s for i, d in enumerate(docs) if (s := sum(d.get(t, 0) for t in asked)) > 0}
    found, scores = block.search(np.array(sorted(asked)), k, least)
    assert all(want.get(int(i)) == int(s) for i, s in zip(found, scores))
    floor = max([least, *sorted(want.values())[-k:][:1]]) if len(want) >= k else least
    assert {i for i, s in want.items() if s >= floor} <= set(found.tolist())


def test_reading_stops_early():
    """With rare high impacts the common low ones are never read."""
    rng = np.random.default_rng(1)
    n = 20_000
    lengths = np.ones(n, np.int64)
    terms = np.ones(n, np.int64)
    impact = rng.integers(1, 50, n)
    lengths[:20], terms, impact = 2, np.concatenate([np.tile([0, 1], 20), terms[20:]]), np.concatenate([np.tile([9000, 7], 20) + np.repeat(np.arange(20), 2), impact[20:]])
    block = ranked_search.Block(lengths, terms, impact, 2)
    read = []
    plain = block.postings
    block.postings = lambda a, b: (read.append(int((b - a).sum())), plain(a, b))[1]
    found, scores = block.search(np.array([0, 1]), 10, 0)
    assert found.tolist() == list(range(10, 20)) and scores.tolist() == [9007 + 2 * i for i in range(10, 20)]
    assert sum(read) < 60


def test_awkward_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.top_documents(docs_frame(spark, []), items).count() == 0
    assert ranked_search.top_documents(docs_frame(spark, [None, "", "."]), items).count() == 0
    assert ranked_search.top_documents(docs_frame(spark, ["a", "b"]), items.limit(0)).count() == 0
    assert [found.to_pylist() for _, found, _ in ranked_search.terms_of(pa.array(["Ab-c", None, "é1 Z"]))] == [[b"ab", b"c", "é1".encode(), b"z"]]
