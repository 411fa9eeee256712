"""Prefix trie against a plain trie; rounds stay few however deep it is."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plain(rows):
    """The contract by sorting and dictionaries; rows are (conv, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, md5(md5(role or "") + md5(text or "")), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    below = defaultdict(lambda: [0, 0])
    children = defaultdict(int)
    for v in members:
        if v:
            children[v[:-1]] += 1
    for v, cs in members.items():
        saved = (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0
        for d in range(len(v) + 1):
            below[v[:d]][0] += not children[v]
            below[v[:d]][1] += saved
    ends = defaultdict(list)
    for c, v in whole.items():
        ends[v].append(c)
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()
    return sorted((min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), children[v], *below[v], sha(v)) for v, cs in members.items())


def report(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie.trie_report(df)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def random_rows(seed, n, alphabet, longest, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-50, 400), n, replace=False):
        for t in range(int(rng.integers(0, longest)) + 1):
            text = " ".join(alphabet[int(x)] for x in rng.integers(0, len(alphabet), int(rng.integers(0, 3))))
            rows.append((int(c), t if rng.random() < 0.95 else None, ["user", "assistant", None, ""][t % 4], text if rng.random() < 0.95 else None))
    return rows + rows[:copies]


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 20)])
def test_against_a_plain_trie(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = random_rows(seed, 120, ["a", "b\tc", "é"], 7, 9) + [(None, 0, "user", "x"), (None, None, None, None)]
    rows += [(c, t, "user", "same text") for c in range(1000, 1100) for t in range(5)]
    assert report(spark, rows) == plain(rows)


def test_awkward_tables(spark):
    assert report(spark, []) == []
    assert report(spark, [(None, 1, "user", "x")]) == []
    # no base, so conversations of few turns have none left; one of them is the root's only conversation
    alone = [(c, 0, "user", "x y") for c in range(1, 9)]
    assert report(spark, alone) == plain(alone)
    tied = [(20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a"), (20, None, None, None), (20, 1, None, "a"), (21, 0, "user", "z" * 50_000 + " q"), (40, 5, "x", "\n")]
    assert report(spark, tied) == plain(tied)


def growing(n):
    """Conversation i has i turns, all of them first turns of the longest, none shared from a base."""
    texts = [f"t{t} w" for t in range(n + 4)]
    ids = [i for i in range(1, 40 * n) if i % 20 and zlib.crc32(str(i).encode()) % 4 == 0][:n]
    return [(c, t, "user", texts[t]) for i, c in enumerate(ids) for t in range(i + 1)]


def test_deep_tries_need_few_rounds(spark, monkeypatch):
    rounds = []
    peel = prefix_trie.peeled
    monkeypatch.setattr(prefix_trie, "peeled", lambda paths: (lambda out: (rounds.append(out[1]), out)[1])(peel(paths)))
    deep = [(20, t, "user", f"{t}") for t in range(3000)] + [(c, t, "user", f"{t}") for c in (21, 22) for t in range(1500)]
    for rows in (growing(60), deep):
        got = report(spark, rows)
        assert len(got) > 59 and rounds.pop() <= 16
        if len(rows) < 3000:
            assert got == plain(rows)
        else:
            assert sum(r[3] for r in got) == sum(map(lambda c: c.n + 1, spark.createDataFrame(rows, "c long, t long, r string, x string").groupBy("c").agg(F.count("*").alias("n")).collect()))


def test_order_of_ids_does_not_matter(spark):
    rows = growing(25)
    turned = [(10_000 - c + c % 20 * 2, t, r, x) for c, t, r, x in rows]
    assert report(spark, turned) == plain(turned)
